"""The training-data operators against brute force, and on nulls, empties, ties, repeats and clashing names."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from larder.llm import catalog, chat, components, decontaminate, grace_dedup, jaccard_join, language_id, mixing, quality, repeated_strings, token_files, warc, words
from larder.llm.suffix_array import suffix_array
from larder.session import scratch_path

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int, hits int, copies int"
PASSAGE = "one two three four five six seven eight nine ten eleven twelve"


def rows(spark, texts, schema=DOCS):
    """Documents with columns whose names the operators use themselves."""
    data = [(i, t, None, None, None, "x", 1, 2, 3) for i, t in texts]
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    texts = [
        (1, "Alpha  beta\tgamma"),
        (2, "Alpha beta gamma"),
        (3, None),
        (4, ""),
        (5, " \n "),
        (6, long),
        (7, long + " end"),
        (2, "Alpha beta gamma"),
        (None, "Alpha beta gamma"),
        (8, f"Intro. {PASSAGE.upper()}, {PASSAGE}"),
        (9, "é" * 300),
    ]
    return rows(spark, texts)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def texts_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# exact dedup


def test_grace_dedup_keeps_one_row_of_equal_texts(odd, nothing):
    for options in ({}, {"local_bytes": 200, "bucket_bytes": 150, "ids_per_row": 1}):
        got = grace_dedup.grace_dedup(odd, **options).collect()
        groups = collections.defaultdict(list)
        for doc_id, text in texts_of(odd):
            groups[re.sub(r"[\x20\x09-\x0d]+", " ", text or "")].append(doc_id)
        assert len(got) == odd.count()
        by_sha = collections.defaultdict(list)
        for r in got:
            by_sha[r.text_sha256].append(r)
        for text, ids in groups.items():
            mine = by_sha[hashlib.sha256(text.encode()).hexdigest()]
            least = min((i for i in ids if i is not None), default=None)
            assert [r.kept for r in mine].count(True) == 1
            assert {(r.keep_id, r.group_size) for r in mine} == {(least, len(ids))}
        assert len(by_sha) == len(groups)
    assert grace_dedup.grace_dedup(nothing).count() == 0


def test_grace_buckets_split_and_tell_equal_hashes_apart(spark):
    from larder.llm.common import make_folder

    folder = make_folder(scratch_path(spark, "test-spill"))
    records = [(i, hashlib.sha256(b"%d" % (i % 50)).digest(), b"%d" % (i % 50), i, 1) for i in range(300)]
    got = {g: (k, n) for g, _, k, n in grace_dedup.bucket_classes(iter(records), folder, 500)}
    assert got == {i: (i % 50, 6) for i in range(300)}
    table = grace_dedup.ContentTable(4)
    for content in (b"a", b"b", b"c", b"d", b"e"):
        table.entry(bytes(32), content).append(content)
    assert table.entry(bytes(32), b"d") == [b"d"] and len(table.contents) == 5


# decontamination


def brute_hits(text, windows):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, items = set(), set()
    for size in {len(w) for w in windows}:
        for i in range(len(found) - size + 1):
            if (key := tuple(found[i : i + size])) in windows:
                hit.update(range(i, i + size))
                items |= windows[key]
    return len(found), len(hit), sorted(items)


def test_decontamination_finds_every_window(spark, odd, nothing, monkeypatch):
    items = spark.createDataFrame([(1, PASSAGE), (2, "beta gamma"), (10, "Beta, GAMMA"), (2, "beta gamma"), (None, "alpha"), (4, None), (5, "..")], "item_id long, text string")
    windows = collections.defaultdict(set)
    for item, text in ((1, PASSAGE), (2, "beta gamma"), (10, "beta gamma")):
        w = text.split()
        for i in range(max(1, len(w) - 9)):
            windows[tuple(w[i : i + 10])].add(str(item))
    for block in (decontaminate.BLOCK_PATTERNS, 2):
        base = odd.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        hits = decontaminate.with_hits(base, decontaminate.pattern_blocks(items, block_patterns=block), "hits")
        for r in hits.collect():
            n, hit, found = brute_hits(r.text, windows)
            assert (r.hits.n_words, r.hits.n_hit, r.hits.items) == (n, hit, found)
    kept = decontaminate.without_contaminated(odd, items)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7, 9]
    assert decontaminate.contamination(nothing, items).count() == 0
    assert decontaminate.contamination(odd, items.limit(0)).filter("contaminated").count() == 0


def test_wu_manber_equals_plain_search():
    rng = random.Random(3)
    for _ in range(200):
        m = rng.choice([1, 2, 3, 5])
        patterns = [list(p) for p in {tuple(rng.choice([b"a", b"b", b"c"]) for _ in range(m)) for _ in range(4)}]
        text = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(30)]
        want = {(i, k) for k, p in enumerate(patterns) for i in range(len(text) - m + 1) if text[i : i + m] == p}
        assert set(decontaminate.WuManber(patterns).search(text)) == want


# token files


def test_token_files_round_trip(spark, odd, nothing):
    plain = token_files.WordEncoder(token_files.default_tokenizer())
    extra = rows(spark, [(20, "It's 0 10, <|endoftext|>x é word..."), (21, "don't!? 'll a0b 0")])
    both = odd.unionByName(extra)
    got = sorted(token_files.token_files(both).collect(), key=lambda r: r.start)
    texts = sorted(texts_of(both), key=lambda x: (x[0] is not None, x[0] or 0))
    at = 0
    assert [r.doc_id for r in got] == [i for i, _ in texts]
    for r, (_, text) in zip(got, texts, strict=True):
        ids = np.array([*plain.tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.token_files(nothing).count() == 0


@pytest.mark.parametrize("n", [1, 5, 64, 1000, 5000])
def test_blocks_decode_from_any_checkpoint(n):
    ids = np.random.default_rng(n).zipf(1.3, n).clip(0, 999).astype(np.uint32)
    table = token_files.FrequencyTable.from_counts(np.bincount(ids, minlength=1000), 14)
    data = token_files.encode_block(ids, table, lanes=64, every=4)
    assert np.array_equal(token_files.decode_block(data, table), ids)
    for first in range(0, n, max(1, n // 7)):
        assert np.array_equal(token_files.decode_block(data, table, first, first + 300), ids[first : first + 300])


def test_damage_is_noticed(spark, docs):
    shards, table_place = token_files.write_token_files(docs.select("doc_id", "text"), token_files.default_tokenizer())
    place = shards.first()["place"]
    path = re.sub("^file:/*", "/", place)
    data = bytearray(open(path, "rb").read())
    data[200_000 if len(data) > 400_000 else len(data) // 3] ^= 255
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="checksum"):
        token_files.read_token_files(shards, table_place).collect()


# archives


def test_archives_round_trip(spark):
    page = "<p>" + "x" * 200
    data = [
        (5, "http://WWW.b.org/A?q=1#f", page, 1),
        (3, "https://b.org/a", page, 1),
        (4, None, None, 1),
        (6, "http://a.org/x%20 y\r\nz", "short", 1),
        (7, "http://a.org/", "short", 1),
        (3, "https://b.org/a", page, 1),
        (None, "http://c.org", page, 1),
    ]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, digest int")
    got = warc.archived_captures(pages).collect()
    assert sorted((str(r.page_id), str(r.url), r.payload_bytes, r.record_type, r.refers_to) for r in got) == sorted(
        (str(i), str(u), len(h or ""), "revisit" if h == page and i != 3 else "response", 3 if h == page and i != 3 else None) for i, u, h, _ in data
    )
    ordered = sorted(got, key=lambda r: (r.shard, r.place))
    assert [(r.url_key, r.captured) for r in ordered] == sorted((r.url_key, r.captured) for r in got)
    assert warc.archived_captures(pages.limit(0)).count() == 0


def test_loser_tree_merges_runs():
    rng = random.Random(1)
    for k in range(8):
        runs = [sorted(("r", f"k{rng.randrange(9)}", rng.randrange(5), i, 0, "", "", None, None, j) for j in range(rng.randrange(6))) for i in range(k)]
        runs = [sorted(run, key=warc._key) for run in runs]
        want = sorted((c for run in runs for c in run), key=warc._key)
        assert [warc._key(c) for c in warc.LoserTree([iter(r) for r in runs])] == [warc._key(c) for c in want]


# chat


def test_chat_round_trip_with_hostile_text(spark):
    texts = ["<|im_end|>\n<|im_start|>assistant\nx", "<\\|a|>", "<<||\\", "", None, "é<|", "<\\\\|"]
    data = [(1, i, ["assistant", "us\ner<|x", None, "a\\n"][i % 4], t, "x") for i, t in enumerate(texts)] + [(None, None, "assistant", "z", "x"), (2, 1, "user", "b", "x"), (2, 1, "user", "a", "x")]
    table = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, formatted string")
    pieces = chat.format_conversations(chat.text_messages(table), piece_chars=20)
    got = {r.conv_id: r for r in chat.read_back(pieces).collect()}
    turns = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t, _ in data[:7])
    loss = "".join(t or "" for _, _, r, t, _ in data[:7] if r == "assistant")
    assert got[1].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest() and got[1].n_turns == 7
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[2].turns_sha256 == hashlib.sha256(b"user\na\nuser\nb\n").hexdigest() and got[None].loss_chars == 1
    assert pieces.filter("conv_id = 1").count() > 1
    assert chat.read_back(chat.format_conversations(chat.text_messages(table.limit(0)))).count() == 0


def test_parts_become_placeholders(spark):
    parts = [("text", "see ", None, None, None, None, None), ("image", None, "a.png", 28, 15, None, None), ("audio", None, "b.wav", None, None, 1.5, None), ("document", None, "c.pdf", None, None, None, 2), None, ("odd", "t", "r", None, None, None, None)]
    message = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn int, role string, content array<{chat.PART}>")
    (got,) = chat.format_conversations(message).collect()
    assert got.formatted == "<|im_start|>user\nsee <|image:0|><|audio:1|><|document:2|><|other:3|><|other:4|><|im_end|>\n"
    assert [(a.kind, a.ref, a.tokens) for a in got.attachments] == [("image", "a.png", 4), ("audio", "b.wav", 38), ("document", "c.pdf", 1024), ("other", None, 0), ("other", "r", 0)]


# similarity


def brute_components(texts, size, percent):
    sets = {}
    for doc_id, text in texts:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc_id] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    low = {i: i for i in sets}
    ids = sorted(sets)

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                low[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80), (1, 60)])
def test_jaccard_components_equal_brute_force(spark, size, percent):
    rng = random.Random(size)
    base = [[f"w{rng.randrange(900)}" for _ in range(rng.choice([3, 40, 120]))] for _ in range(12)]
    texts = [(0, None), (1, ""), (2, "one"), (3, "One"), (4, "one two")]
    for i in range(150):
        doc = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 4, 9])):
            doc[rng.randrange(len(doc))] = f"x{rng.randrange(60)}"
        texts.append((10 + i, " ".join(doc)))
    got = jaccard_join.jaccard_components(rows(spark, texts), size=size, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts, size, percent)


def test_near_duplicates_leave_one(odd, nothing):
    kept = jaccard_join.without_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id IS NOT NULL").collect()) == [1, 3, 4, 5, 6, 8, 9]
    assert jaccard_join.without_near_duplicates(nothing).count() == 0


def test_near_duplicates_leave_one_row_with_null_and_repeated_ids(spark):
    copied, other, third = (" ".join(f"{w}{i}" for i in range(30)) for w in "abc")
    data = [(7, copied), (None, copied), (None, copied + " x"), (7, copied), (7, other), (9, other), (None, third), (None, third), (7, "alone"), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(data)], "doc_id long, text string, kept_row int")
    kept = jaccard_join.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    groups = brute_components([(k, t) for k, (_, t) in enumerate(data)], 5, 80)
    found = kept.collect()
    assert collections.Counter(groups[r.kept_row][1] for r in found) == dict.fromkeys((g for _, g in groups.values()), 1)
    assert sorted((r.doc_id or 0, r.text or "") for r in found) == sorted([(7, copied), (7, other), (0, third), (7, "alone"), (0, ""), (0, "")])


def test_pipeline_leaves_one_of_each_group(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = docs.unionByName(docs.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.limit(20))
    good = corpus_pipeline.quality(spark, docs, SMALL)
    texts = [(k, r.text) for k, r in enumerate(good.select("text").distinct().collect())]
    groups = {t: g for (_, t), (_, g) in zip(texts, (brute_components(texts, 5, 80)[k] for k, _ in texts), strict=True)}
    left = collections.Counter(groups[r.text] for r in corpus_pipeline.near_duplicates(spark, good, SMALL).collect())
    assert max(left.values()) == 1 and set(left) == set(groups.values())


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 51), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {50: 50, 51: 50}


# words


def test_word_hashes_follow_words():
    texts = [b"a bb  a", None, b"", b"bb\x0ba", " é bb".encode(), b"A"]
    got = words.words_of(pa.array(texts, pa.binary()), lower=True)
    flat = [w.lower() for t in texts for w in (t or b"").split()]
    assert got.counts.tolist() == [3, 0, 0, 2, 2, 1] and [got.word(i).lower() for i in range(len(flat))] == flat
    assert len({(w, h) for w, h in zip(flat, got.hashes.tolist(), strict=True)}) == len(set(flat)) == len(set(got.hashes.tolist()))


# language, quality


def test_language_of_held_out_documents(docs):
    got = {r.doc_id: r for r in language_id.language_id(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in held) for i in truth)
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.95 * len(held)


def test_language_edges(spark, odd, nothing):
    assert {r.lang_pred for r in language_id.language_id(odd).collect()} == {"und"}  # nothing to learn from
    taught = odd.withColumn("lang", F.lit("xx"))
    got = {r.doc_id: r for r in language_id.language_id(taught).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (3, 4, 5)) and got[6].lang_pred == "xx" and 0 <= got[6].score <= 1
    assert language_id.language_id(nothing).count() == 0


def test_grams_of_a_sliced_text_are_those_of_the_whole(monkeypatch):
    texts = ["Ab", "", "x" * 49 + " Hello wörld, " * 30, "abc", "y" * 150]
    column = pa.array([t.encode() for t in texts], pa.binary())

    def grams():
        found = collections.defaultdict(list)
        for first, last, keys, ends in language_id._parts(column):
            for i in range(first, last):
                found[i] += keys[ends[i - first] : ends[i - first + 1]].tolist()
        return [found[i] for i in range(len(texts))]

    whole = grams()
    for size in (4, 7, 50):
        monkeypatch.setattr(language_id, "_SLICE", size)
        assert grams() == whole
    text = " ab "
    assert whole[0] == [int.from_bytes(text.encode(), "little")]


def test_language_equals_brute_force_over_all_grams(docs, monkeypatch):
    """The stored filter contains exactly the n-grams that the rule names, and predicts from their number."""
    monkeypatch.setattr(language_id, "SEGMENT_SLOTS", 1 << 12)
    rows = docs.select("doc_id", "text", "lang").collect()

    def grams(text):
        data = re.sub("[A-Z]", lambda m: m[0].lower(), f" {text} ").encode()
        return [data[i : i + 4] for i in range(len(data) - 3)]

    counts = collections.defaultdict(collections.Counter)
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None and r.text is not None:
            counts[r.lang].update(grams(r.text))
    totals = {lang: sum(c.values()) for lang, c in counts.items()}
    rates = {lang: {g: n / totals[lang] for g, n in c.items() if n >= 3} for lang, c in counts.items()}
    highest = collections.Counter()
    for found in rates.values():
        for g, rate in found.items():
            highest[g] = max(highest[g], rate)
    owned = {lang: {g for g, rate in found.items() if rate >= 0.3 * highest[g]} for lang, found in rates.items()}
    model = language_id.train(docs.filter(~language_id.held_out()).select(F.col("text").cast("binary").alias("text"), "lang")).load()
    assert model.languages == sorted(totals, key=lambda lang: (-totals[lang], lang))
    for i, lang in enumerate(model.languages):
        keys = np.array([int.from_bytes(g, "little") for g in owned[lang]], np.uint64)
        assert (model.containing(keys) >> np.uint64(i) & np.uint64(1)).all()
    got = {r.doc_id: r for r in language_id.language_id(docs).collect()}
    for r in rows:
        found = grams(r.text or "")
        exact = [sum(g in owned[lang] for g in found) for lang in model.languages]
        best = sorted(exact, reverse=True)
        if r.text and re.search(r"[^\W\d_]", r.text) and best[0] > best[1] + 0.02 * len(found):
            assert got[r.doc_id].lang_pred == model.languages[int(np.argmax(exact))]
            assert got[r.doc_id].score == pytest.approx(best[0] / len(found), abs=0.02)


def test_filter_returns_all_languages_of_a_gram():
    grams = np.arange(200, dtype=np.uint64)
    model = language_id.LanguageFilter.of([f"l{i}" for i in range(70)], np.concatenate([grams, grams[:100]]), np.concatenate([np.full(200, 1), np.full(100, 69)]))
    assert (model.containing(grams) >> np.uint64(1) & np.uint64(1)).all() and (model.containing(grams[:100], 1) >> np.uint64(5) & np.uint64(1)).all()


def brute_kneser_ney(texts, order):
    """Interpolated modified Kneser-Ney over bytes, straight from its definition."""
    counts = {n: collections.Counter() for n in range(1, order + 1)}
    for t in texts:
        for i in range(len(t) - order + 1):
            counts[order][t[i : i + order]] += 1
    for n in range(order - 1, 0, -1):
        for g in counts[n + 1]:
            counts[n][g[1:]] += 1
        for g in {t[:n] for t in texts if len(t) >= n}:
            counts[n][g] += 1
    cut = {n: quality.discounts(*(sum(v == c for v in counts[n].values()) for c in (1, 2, 3, 4))) for n in counts}

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / 256
        same = {k: v for k, v in counts[n].items() if k[:-1] == g[:-1]}
        if not same:
            return p(g[1:])
        d = {k: cut[n][min(v, 3) - 1] for k, v in same.items()}
        total = sum(same.values())
        return (same.get(g, 0) - d.get(g, 0)) / total + sum(d.values()) / total * p(g[1:])

    return lambda t: sum(np.log(p(t[max(0, i - order + 1) : i + 1])) for i in range(len(t)))


def test_kneser_ney_equals_its_definition(spark):
    texts = [b"the cat sat on the mat", b"the dog sat", b"a", b"abababab", "zwölf".encode()]
    model = quality.train(spark.createDataFrame([(t,) for t in texts], "text binary"), order=3)
    want = brute_kneser_ney(texts, 3)
    probes = [b"the cat", b"qqq", b"", b"ab", b"x the mat sat", bytes(range(256))]
    for shard_grams in (10_000, 20):
        scorer = quality.Scorer(quality.shards_of(model, shard_grams), order=3)
        got = scorer.texts(pa.array(probes, pa.binary()))
        assert np.allclose(got, [want(t) for t in probes])


def test_quality_rejects_junk_and_keeps_clean_text(spark, docs, odd, nothing):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    got = quality.document_quality(docs, labels).join(labels, "doc_id").toPandas()
    assert len(quality.document_quality(docs, labels).collect()) == docs.count()
    assert got[(got.quality == 1) & (got.toxic == 0)].accepted.mean() >= 0.97
    assert got[got.quality == 0].accepted.mean() <= 0.5
    kept = quality.accepted_documents(odd, labels.limit(0))  # no trusted text: all with text stay
    assert kept.columns == odd.columns and kept.count() == odd.filter("text <> ''").count()
    assert quality.accepted_documents(nothing, labels).count() == 0


def test_thresholds_are_quantiles_of_their_language(spark):
    rng = np.random.default_rng(3)
    sizes, values = rng.integers(1, 5000, 800), rng.exponential(1.0, 800)
    langs = ["aa" if i < 500 else None if i < 790 else "few" for i in range(800)]
    got = {r.key: r for r in quality.thresholds(spark.createDataFrame(list(zip(langs, sizes.tolist(), values.tolist())), "lang string, size int, log_ppl double")).collect()}
    assert set(got) == {"=aa", "", "all"}  # a null language is its own; too small a one uses that of all
    for key, part in (("=aa", slice(0, 500)), ("", slice(500, 790)), ("all", slice(0, 800))):
        median = np.median(values[part])
        excess = (values[part] - median) * sizes[part] / (sizes[part] + quality.PRIOR_BYTES)
        assert np.isclose(got[key].median, median) and np.isclose(got[key].excess, np.quantile(excess, quality.LEVEL))


def test_quality_rejects_bad_and_toxic_documents_and_keeps_held_out_ones(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = quality.trusted_ids(labels).filter("held_out").toPandas().trusted_id
    got = quality.document_quality(spark.read.parquet(f"{folder}/documents.parquet"), labels).join(labels, "doc_id").toPandas()
    assert got[got.doc_id.isin(held)].accepted.mean() >= 0.95
    assert got[(got.quality == 1) & (got.toxic == 0)].accepted.mean() >= 0.985
    assert got[got.quality == 0].accepted.mean() <= 0.03
    assert got[got.toxic == 1].accepted.mean() <= 0.5


# mixing


def test_water_filling_caps_and_shares(spark):
    sizes = {"a": 100, "b": 1000, "c": 1000, "d": 10, None: 500}
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.water_fill(table).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True))
    free, left, want = set(sizes), 1.5 * sum(sizes.values()), {}
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s], left = 2.0 * sizes[s], left - 2 * sizes[s]
        free -= over
    want |= {s: level * weight[s] for s in free}
    assert got == pytest.approx(want)


def test_mix_meets_targets_and_repeats_itself(docs, odd, nothing):
    first, again = mixing.mix(docs).toPandas(), mixing.mix(docs).toPandas()
    key = ["doc_id", "source"]
    assert first.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    assert (first.taken <= 2 * first["size"]).all() and len(first) == docs.count()
    by = first.groupby("source", dropna=False).agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((by.taken - by.target).abs() <= 0.05 * by.target + 300).all()
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == first.copies.sum()
    assert mixing.mixed_documents(odd).columns == odd.columns and mixing.mix(odd).count() == odd.count()
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


# repeated strings


def test_suffix_array_equals_sorting():
    rng = random.Random(7)
    for _ in range(1500):
        text = bytes(rng.randrange(rng.choice([1, 2, 4, 256])) for _ in range(rng.randrange(40))) * rng.choice([1, 1, 3])
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_repeats_equal_brute_force(spark, nothing, monkeypatch):
    rng = random.Random(5)
    words_ = [bytes(rng.randrange(97, 110) for _ in range(rng.randrange(1, 9))).decode() for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words_) for _ in range(n))
    shared = [text(20), text(40), text(30)]
    docs = [(0, None), (1, ""), (2, "short"), (3, "Orre " * 90), (4, "x" * 350), (5, text(9) + "Orre " * 40), (6, "é" * 120)]
    for i in range(60):
        docs.append((10 + i, text(rng.randrange(30)) + rng.choice([" ", ""]) + rng.choice(shared) + text(rng.randrange(20)) + rng.choice(shared)[rng.randrange(30) :]))
    docs += [(100, docs[9][1]), (101, shared[1][:99]), (102, shared[1][3:]), (103, text(15) + docs[12][1])]
    seen, want = set(), {}
    for doc_id, value in docs:
        data = (value or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(data[i : i + 100])
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        want[doc_id] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    for held in (repeated_strings.HELD_SURROUNDINGS, 3):  # the second by digests too
        monkeypatch.setattr(repeated_strings, "HELD_SURROUNDINGS", held)
        got = repeated_strings.remove_repeats(rows(spark, docs)).collect()
        assert {r.doc_id: tuple(r)[1:] for r in got} == want
    assert repeated_strings.remove_repeats(nothing).count() == 0


def test_repeats_with_equal_and_null_ids(spark):
    a, b = "".join(f"a{i} " for i in range(80)), "".join(f"b{i} " for i in range(80))
    got = repeated_strings.remove_repeats(rows(spark, [(1, a), (1, b), (None, a), (2, a + b)])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == sorted([("1", 0), ("1", 0), ("None", len(a)), ("2", len(a) + len(b))])


# pipeline


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_pipeline_stages_work_on_what_the_one_before_kept(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns, name
        path = scratch_path(spark, "test-stage")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0
    sets = brute_components([(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()], 5, 80)
    kept = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    groups = collections.Counter(sets[i][1] for i in kept)
    assert max(groups.values()) == 1 or counts[1] < counts[0]
    assert corpus_pipeline.run(spark, SMALL).count() == counts[-1]
