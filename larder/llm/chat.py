r"""Chat formatting with typed content parts.

A message's content is a list of parts. A visitor flattens them in order: text is
escaped and kept, an image, an audio clip or a document becomes a placeholder of
its own number, its reference is recorded, and so is the number of tokens it will
expand to. Turns are marked ``<|im_start|>role\n ... <|im_end|>\n``.

Escaping is reversible: ``<``, any backslashes and ``|`` get one more backslash, so
no control string can arise inside a text; roles also escape line ends.

A conversation is written as pieces of bounded length, in order; usual ones are one
piece. Rows are put in order by range of (conversation, turn), so a conversation of
any length is never gathered. Its digest is made by streaming over the pieces.

Nulls and ties: a null text or role is empty, a null part or part of unknown type is
an ``other`` placeholder, null conversations are one conversation, a null turn comes
last. Turns with equal number are ordered by role, then text. Repeated rows are
turns of their own. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import batches_of, prepare, rows_of
from larder.session import materialise

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"
PIECE_CHARS = 1 << 20
#: Expansion: image patches of so many pixels a side, audio frames a second, tokens a page.
PATCH, FRAMES, PAGE_TOKENS = 14, 25.0, 512

PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
_LIKE_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _LIKE_CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.DOTALL)


@dataclass
class Flattened:
    """Text of a message, and its attachments as (kind, ref, placeholder number, tokens)."""

    chunks: list[str] = field(default_factory=list)
    attachments: list[tuple[str, str | None, int, int]] = field(default_factory=list)


class PartVisitor:
    """Flattens parts in order; one method per type of part."""

    def __init__(self, first_number: int = 0):
        self.out = Flattened()
        self.number = first_number

    def visit(self, part: dict | None) -> None:
        kind = (part or {}).get("type")
        getattr(self, f"visit_{kind}" if kind in ("text", "image", "audio", "document") else "visit_other")(part or {})

    def visit_text(self, part: dict) -> None:
        self.out.chunks.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        across, down = (math.ceil(max(0, part.get(side) or 0) / PATCH) for side in ("width", "height"))
        self._attach("image", part, across * down)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil(max(0.0, part.get("seconds") or 0.0) * FRAMES))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(0, part.get("pages") or 0) * PAGE_TOKENS)

    def visit_other(self, part: dict) -> None:
        self._attach("other", part, 0)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.out.chunks.append(f"<|{kind}:{self.number}|>")
        self.out.attachments.append((kind, part.get("ref"), self.number, tokens))
        self.number += 1


_ATTACHMENT = pa.struct([("kind", pa.string()), ("ref", pa.string()), ("number", pa.int64()), ("tokens", pa.int64())])
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_PIECE = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("shard", pa.int64()),
        ("piece", pa.int64()),
        ("formatted", pa.string()),
        ("loss_spans", pa.list_(_SPAN)),
        ("attachments", pa.list_(_ATTACHMENT)),
    ]
)
_PIECE_DDL = (
    "conv_id long, shard long, piece long, formatted string, loss_spans array<struct<start: long, end: long>>, "
    "attachments array<struct<kind: string, ref: string, number: long, tokens: long>>"
)
_DIGEST = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)


def pieces(rows: Iterator[tuple], shard: int, piece_chars: int) -> Iterator[tuple]:
    """Pieces of conversations from ordered rows (conv_id, role, parts).

    Numbers of placeholders count within a piece; spans are in characters of it.
    """
    conv, chunks, size, spans, attached, number, begun = None, [], 0, [], [], 0, False

    def out():
        return (
            conv,
            shard,
            number,
            "".join(chunks),
            [{"start": a, "end": b} for a, b in spans],
            [dict(zip(("kind", "ref", "number", "tokens"), a, strict=True)) for a in attached],
        )

    for conv_id, role, parts in rows:
        if begun and (conv_id != conv or size >= piece_chars):
            yield out()
            number = number + 1 if conv_id == conv else 0
            chunks, size, spans, attached = [], 0, [], []
        conv, begun = conv_id, True
        visitor = PartVisitor(len(attached))
        for part in parts or []:
            visitor.visit(part)
        head, body = f"{START}{escape_role(role or '')}\n", "".join(visitor.out.chunks)
        if role == TRAINED_ROLE:
            spans.append((size + len(head), size + len(head) + len(body)))
        chunks += [head, body, END, "\n"]
        size += len(head) + len(body) + len(END) + 1
        attached += visitor.out.attachments
    if begun:
        yield out()


def format_conversations(messages: DataFrame, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Format rows (conv_id, turn, role, content: array of parts) and store the pieces."""
    prepare(messages.sparkSession)

    def write(batches):
        yield from batches_of(pieces(rows_of(batches), TaskContext.get().partitionId(), piece_chars), _PIECE)

    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("_first").asc_nulls_first()]
    content = F.expr(f"CAST(content AS array<{PART}>)")
    ordered = (
        messages.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", content.alias("content"))
        .withColumn("_first", F.to_json("content"))
        .repartitionByRange(int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order)
        .sortWithinPartitions(*order)
    )
    return materialise(ordered.select("conv_id", "role", "content").mapInArrow(write, _PIECE_DDL), "chat")


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of formatted text."""
    for turn in formatted.split(START)[1:]:
        head, _, body = turn.partition("\n")
        yield unescape_role(head), unescape(body[: body.rindex(END)])


def _digests(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Digests from ordered rows (conv_id, formatted, loss_spans)."""
    conv, begun = None, False
    n = chars = size = 0
    turns, loss = hashlib.sha256(), hashlib.sha256()
    for conv_id, formatted, spans in rows:
        if begun and conv_id != conv:
            yield conv, n, turns.hexdigest(), chars, loss.hexdigest(), size
            n = chars = size = 0
            turns, loss = hashlib.sha256(), hashlib.sha256()
        conv, begun = conv_id, True
        size += len(formatted)
        for role, text in parse(formatted):
            turns.update(f"{role}\n{text}\n".encode())
            n += 1
        for span in spans:
            text = unescape(formatted[span["start"] : span["end"]])
            chars += len(text)
            loss.update(text.encode())
    if begun:
        yield conv, n, turns.hexdigest(), chars, loss.hexdigest(), size


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the stored pieces: turns, text under the loss mask, sizes."""

    def digest(batches):
        yield from batches_of(_digests(rows_of(batches)), _DIGEST)

    return (
        formatted.repartition("conv_id")
        .sortWithinPartitions("conv_id", "shard", "piece")
        .select("conv_id", "formatted", "loss_spans")
        .mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    )


def text_messages(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with the text as their only part."""
    part = "array(named_struct('type', 'text', 'text', text, 'ref', CAST(NULL AS string), 'width', CAST(NULL AS int), 'height', CAST(NULL AS int), 'seconds', CAST(NULL AS double), 'pages', CAST(NULL AS int)))"
    return rows.select("conv_id", "turn", "role", F.expr(part).alias("content"))
