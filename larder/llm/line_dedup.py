r"""Removal of lines that many documents share.

1. Texts are exploded into lines. A line's key is the line without ASCII white space
   at its ends and with A-Z in lower case; a line goes on as two 64-bit hashes of its
   key, its document's key and its position, and is stored: 40 bytes a line.
2. Distinct documents are counted per hash. Spark counts (hash, document) pairs first
   and hashes then, both with partial sums, so a line of every document is spread.
3. Lines whose hash is in ``min_docs`` documents or more are marked. The hashes that
   make up a ten-thousandth of all lines or more are at most ten thousand; these are
   broadcast. All others are joined by hash, where no key is large any more.
4. Marked positions are collected per document, joined to the texts by the document's
   key (always a sort-merge join, so texts go through one shuffle at any size), and the
   other lines are put together again by position.

Nulls and ties: a null or empty text is one empty line. Rows of equal non-null id are
one document when documents are counted, rows without id are one where their texts
are equal; each row is cleaned on its own. Repeated rows get equal results. Lines
whose key has fewer than ``min_chars`` code points always stay. An empty table gives
no rows. Other columns are carried and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import fresh, prepare
from larder.session import materialise

MIN_CHARS, MIN_DOCS = 1, 10
#: Hashes with at least one of so many lines are broadcast: so many at most.
HEAVY_OF = 10_000
_ENDS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _hashes(name: str, *values: Column) -> list[Column]:
    """Two independent 64-bit hashes."""
    return [F.xxhash64(*values).alias(f"{name}1"), F.xxhash64(F.lit(name), *values).alias(f"{name}2")]


def _row_key(doc_id: Column, text: Column) -> list[Column]:
    # a flag for a null, which the hash passes over
    return _hashes("row", doc_id.isNull(), doc_id, text.isNull(), text)


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Per line with a key: hashes of its row, of its document and of its key, and its position from 0."""
    doc_id, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    document = _hashes("doc", doc_id.isNull(), F.when(doc_id.isNull(), text).otherwise(doc_id.cast("string")))
    lines = docs.select(*_row_key(doc_id, text), *document, F.posexplode(F.split(lowered, "\n", -1)).alias("pos", "line"))
    key = F.btrim("line", F.lit(_ENDS))
    return lines.withColumn("line", key).filter(F.char_length("line") >= min_chars).select("row1", "row2", "doc1", "doc2", "pos", *_hashes("line", F.col("line")))


def common_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Hashes of lines in at least ``min_docs`` documents, with their documents and places."""
    counted = lines.groupBy("line1", "line2").agg(F.countDistinct("doc1", "doc2").alias("documents"), F.count("*").alias("places"))
    return counted.filter(F.col("documents") >= min_docs)


def drop_common_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, heavy_of: int = HEAVY_OF
) -> tuple[DataFrame, str]:
    """``docs`` with a struct of n_lines, n_dropped and kept (the text that stays); and that struct's name."""
    prepare(docs.sparkSession)
    lines = materialise(line_hashes(docs, id_col, text_col, min_chars), "lines")
    common = materialise(common_lines(lines, min_docs), "common-lines")
    total = lines.count()
    is_heavy = F.col("places") * heavy_of >= total
    heavy = F.broadcast(common.filter(is_heavy).select("line1", "line2"))
    others = common.filter(~is_heavy).select("line1", "line2").hint("merge")
    keys = ["line1", "line2"]
    marked = lines.join(heavy, keys, "left_semi").unionByName(lines.join(heavy, keys, "left_anti").join(others, keys, "left_semi"))
    dropped = marked.groupBy("row1", "row2").agg(F.collect_set("pos").alias("gone"))

    doc_id, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    split = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *_row_key(doc_id, text), split.alias("lines"))
    joined = held.join(dropped.hint("merge"), ["row1", "row2"], "left")
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), gone), lambda at: F.get("lines", at))
    name = fresh(docs, "line_dedup")
    found = F.struct(F.size("lines").cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("kept"))
    return joined.select("doc", found.alias("found")).select(*[F.col(f"doc.`{c}`") for c in docs.columns], F.col("found").alias(name)), name


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: doc_id, its lines, how many are dropped, digest of the text that stays."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found, name = drop_common_lines(rows, **options)
    return found.select("doc_id", f"{name}.n_lines", f"{name}.n_dropped", F.sha2(F.col(f"{name}.kept").cast("binary"), 256).alias("kept_sha256"))
