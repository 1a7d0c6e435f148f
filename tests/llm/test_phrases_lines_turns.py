"""Phrase mining, conversation repair and line removal against brute force, and on odd rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
import xxhash

from larder.llm import conversation_repair as repair
from larder.llm import line_dedup, phrases

DOCS = "doc_id long, text string, lang string, lines int, line1 string, found int, a long, size int, key string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "x", 2, 3, 4, "k") for i, t, lang in rows], DOCS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.fixture(scope="module")
def odd(spark):
    shared = "Shared line here"
    rows = [(i, f" {shared.upper()}\t\nown {i}\n\nshared LINE here\n é{i % 3}", "en" if i % 2 else None) for i in range(12)]
    rows += [(12, None, None), (13, "", "en"), (14, "\n\n", "en"), (None, shared, "en"), (None, shared, "fr"), (None, f"{shared}\nz", None)]
    rows += [(15, f"{shared}\r\nlast", "de")] * 3 + [(16, "x y. " * 30_000, "en"), (17, f"{shared}\n" * 3000, "und")]
    return documents(spark, rows)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# line dedup


def brute_lines(rows, min_chars, min_docs):
    def key(line):
        return lower(line.strip(" \t\n\x0b\x0c\r"))

    seen = collections.defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            seen[key(line)].add(("id", doc_id) if doc_id is not None else ("text", text))
    gone = {k for k, docs in seen.items() if len(k) >= min_chars and len(docs) >= min_docs}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if key(line) not in gone]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return collections.Counter(out)


def test_line_dedup_equals_brute_force(odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    for min_chars, min_docs, heavy_of in ((1, 10, 10_000), (1, 3, 1), (2, 3, 5), (1, 12, 10_000), (0, 4, 10_000)):
        got = line_dedup.line_dedup(odd, min_chars=min_chars, min_docs=min_docs, heavy_of=heavy_of)
        assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
        assert collections.Counter(tuple(r) for r in got.collect()) == brute_lines(rows, min_chars, min_docs)


def test_line_dedup_carries_columns_of_any_name(odd, nothing):
    found, name = line_dedup.drop_common_lines(odd.withColumnRenamed("found", "line_dedup"))
    assert found.columns == [*odd.withColumnRenamed("found", "line_dedup").columns, name] and name != "line_dedup"
    assert found.count() == odd.count()
    assert line_dedup.line_dedup(nothing).count() == 0


# phrases


def brute_phrases(rows, longest, least, top):
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
            words = re.findall(r"[^ \t]+", piece)
            total[lang or "und"] += len(words)
            for n in range(1, longest + 1):
                counts[lang or "und"].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, found in counts.items():
        candidates = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            cuts = [(1_000_000 * a * a // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = any(
                len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items()
            )
            if not inside:
                kept.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def zipf_rows(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" if i % 7 else f"é{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, weights, k=rng.randrange(0, 80))
        text = "".join(w + rng.choices([" ", "  ", "\t", ". ", "\n", ","], [12, 1, 1, 1, 1, 1])[0] for w in words)
        rows.append((text, [None, "en", "und", "fr"][i % 4]))
    return rows + [(rows[0][0], "en")] * 5


@pytest.mark.parametrize(("shards", "bits", "longest"), [(4, None, 3), (3, 6, 3), (1, 8, 2), (2, 10, 4)])
def test_collocations_equal_brute_force(spark, shards, bits, longest):
    rows = zipf_rows(shards)
    docs = documents(spark, [(i, t, lang) for i, (t, lang) in enumerate(rows)]).repartition(3)
    got = phrases.collocations(docs, longest=longest, least=5, top=25, shards=shards, bits=bits)
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, longest, 5, 25)


def test_a_phrase_is_counted_for_exactly_one_cycle_from_when_its_parts_are_frequent(spark):
    rows = zipf_rows(9)
    docs = documents(spark, [(i, t, lang) for i, (t, lang) in enumerate(rows)]).coalesce(1)
    counted, steps = phrases.count_phrases(phrases.Shards(docs, "lang", "text", 4), 3, 5, 24)
    exact = collections.Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower(text)):
            words = re.findall(r"[^ \t]+", piece)
            exact.update((lang or "und", *words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1))
    frequent = {p: n for p, n in exact.items() if n >= 5}
    got = counted.filter("size > 0 AND c >= 5").collect()
    assert collections.Counter(r.size for r in got) == collections.Counter(len(p) - 1 for p in frequent)
    assert collections.Counter(r.c for r in got) == collections.Counter(frequent.values())
    assert 4 < steps <= 12
    # of the rest only phrases whose cycle may still run are held
    assert counted.filter("size > 0 AND c < 5").count() < len(exact) - len(frequent)


def test_lengths_interleave(spark):
    docs = documents(spark, [(i, "a b c d. " * 10, "en") for i in range(8)]).coalesce(1)
    counted, steps = phrases.count_phrases(phrases.Shards(docs, "lang", "text", 4), 3, 5, 24)
    # words reach the threshold in step 0, pairs run from 1 to 4, triples from 2 to 5: half of three cycles
    assert steps == 6
    assert {r.c for r in counted.filter("size > 0").collect()} == {80}


def test_long_texts_are_cut_between_pieces(spark, odd, nothing, monkeypatch):
    text = "a b c. " * 400 + "d " * 500
    import pyarrow as pa

    monkeypatch.setattr(phrases, "SLICE", 100)
    parts = [(t.to_pylist()[0], langs) for t, langs in phrases._slices(pa.RecordBatch.from_pydict({"t": [text.encode()], "l": ["en"]}))]
    assert len(parts) > 20 and b"".join(p for p, _ in parts) == text.encode()
    assert all(p.startswith((b".", b"a")) for p, _ in parts)
    assert parts[-1][0].count(b"d") == 500
    monkeypatch.undo()
    rows = [(r.text, r.lang) for r in odd.select("text", "lang").collect()]
    assert sorted(tuple(r) for r in phrases.collocations(odd).collect()) == brute_phrases(rows, 3, 10, 2000)
    assert phrases.collocations(nothing).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    cases = [(10**12, 10**12, 10**12), (3, 7, 5), (999_999_999_999, 10**12, 999_999_999_999), (10**9 + 7, 10**10 + 1, 10**11 + 3), (1, 10**12, 10**12)]
    got = spark.createDataFrame(cases, "a long, l long, r long").select(phrases.floor_quotient(*(phrases.F.col(c) for c in "alr"))).collect()
    assert [r[0] for r in got] == [1_000_000 * a * a // (l * r) for a, l, r in cases]


# conversations


def best_edits(rows):
    """(cost, audit, repaired) by trying all ways over the four states of the role grammar."""
    moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    names = {"u": "user", "a": "assistant"}

    def inserted(tops):
        left = list(tops)
        while left:
            state = left.pop()
            cost, audit, out = tops[state]
            for (f, x), t in moves.items():
                if f == state and x != "s":
                    new = (cost + 2, audit + "I", (*out, f"{names[x]}:"))
                    if t not in tops or new[:2] < tops[t][:2]:
                        tops[t] = new
                        left.append(t)
        return tops

    tops = inserted({0: (0, "", ())})
    for role, text, must_go, cut in rows:
        new = {}
        for state, (cost, audit, out) in tops.items():
            ways = [(state, (cost + 3, audit + "D", out))]
            if not must_go:
                for (f, x), t in moves.items():
                    if f == state and x == role[:1]:
                        ways.append((t, (cost + cut, audit + "K", (*out, f"{role}:{text}"))))
                    if f == state and x != "s":
                        ways.append((t, (cost + 2 + cut, audit + "R", (*out, f"{names[x]}:{text}"))))
            for t, way in ways:
                if t not in new or way[:2] < new[t][:2]:
                    new[t] = way
        tops = inserted(new)
    return min(tops[s] for s in (0, 3) if s in tops)


def digest(role, text):
    """The digest that orders rows of equal turn and role."""
    h = 42
    for value in (role, "\n", text):
        h = xxhash.xxh64_intdigest(value.encode(), seed=h)
    return h - (1 << 64) if h >> 63 else h


def brute_repair(conversations, damage=True):
    out, rows = {}, collections.defaultdict(list)
    for conv, turn, role, text in conversations:
        out[conv] = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, held in rows.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[1], r[2])))
        seen, faults, counts = set(), [], collections.Counter()
        for _, role, text in held:
            solid = text.rstrip(" \t\n\x0b\x0c\r")
            blank, again, cut = not solid, (role, text) in seen, solid[-1:] not in (".", "!", "?")
            seen.add((role, text))
            counts["blank" if blank else "duplicate" if again else "truncated" if cut else "fine"] += 1
            faults.append((role, text, blank or again, int(cut)))
        turns = [t for t, _, _ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(held))
        cost, audit, said = best_edits(faults)
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def random_conversations(seed, n=60):
    rng = random.Random(seed)
    texts = ["Yes.", "No", " \n", "", "Why?", "ok ", "é!", None, "a. \t"]
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(0, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            # texts of one turn differ in role, so that their order needs no digest
            rows.append((conv, rng.choice([turn, turn, turn, turn * 2, None if turn == 0 else turn]), role, rng.choice(texts) if turn % 2 else f"Turn {turn}."))
    unique = {}
    for row in rows:
        unique.setdefault((row[0], row[1], row[2] or " "), row)
    return list(unique.values())


CONVERSATIONS = "conv_id long, turn long, role string, text string, chunk int, at int, n string, cost long"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], CONVERSATIONS)


def test_repair_equals_brute_force(spark):
    rows = random_conversations(1) + [(100, 5, "user", "Again."), (100, 5, "user", "Again."), (None, None, None, None), (None, 3, "assistant", "Hm.")]
    rows += [(101, t, "user" if t % 2 else "assistant", f"Line {t}{'.' if t % 5 else ''}") for t in range(3000)]
    got = {r.conv_id: tuple(r)[1:] for r in repair.conversation_repair(conversations(spark, rows)).collect()}
    want = brute_repair(rows)
    assert got.keys() == want.keys()
    assert {k: v for k, v in got.items() if v != want[k]} == {}


def test_repair_in_small_chunks_gives_the_same(spark):
    rows = random_conversations(2) + [(200, 1, "user", "Same.")] * 25 + [(200, t, "assistant", "Same") for t in range(2, 30)]
    want = brute_repair(rows, damage=False)
    for chunk in (1, 3, 1000):
        turns, report = repair.repair(conversations(spark, rows), chunk)
        got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in report.collect()}
        assert got == {k: v[:-1] for k, v in want.items()}
        said = collections.defaultdict(list)
        for r in sorted(turns.collect(), key=lambda r: (r.conv_id, r.chunk, r.at)):
            said[r.conv_id].append(f"{r.role}:{r.text}")
        assert {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in said.items()} == {k: want[k][-1] for k in said}
        assert all(re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines)) for lines in said.values())


def test_repair_of_nothing(spark):
    assert repair.conversation_repair(spark.createDataFrame([], CONVERSATIONS)).count() == 0


def test_tables_of_the_role_grammar_accept_it_and_share_stacks():
    graph = repair.StackGraph()
    for n in range(7):
        for word in map("".join, itertools.product("sua", repeat=n)):
            tops = {0}
            for symbol in word:
                tops = {t for top in tops for t in graph.after(top, symbol)}
            assert any(graph.accepts(t) for t in tops) == bool(re.fullmatch("(s?(ua)+)?", word))
    assert len(graph.entries()) <= 8 and len(graph.state) < 30


def test_other_grammars_also_with_conflicts_and_unbounded_stacks():
    nested = repair.StackGraph(repair.RoleTables((("C", "uCa"), ("C", ""))))
    tops = {0}
    for symbol in "uuaa":
        tops = {t for top in tops for t in nested.after(top, symbol)}
    assert any(nested.accepts(t) for t in tops)
    with pytest.raises(ValueError):
        nested.entries()
    # a reduce-reduce conflict: both stacks are kept until one fails
    either = repair.StackGraph(repair.RoleTables((("C", "Xu"), ("C", "Ys"), ("X", "a"), ("Y", "a"), ("X", "Za"), ("Z", "u"))))
    (top,) = either.after(0, "a")
    assert either.after(top, "u") and either.after(top, "s") and not either.after(top, "a")
