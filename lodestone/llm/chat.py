"""Chat formatting of conversations whose turns have typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor goes through the parts of a
conversation in order and flattens them: text stays, every other part becomes a numbered placeholder
(``<|image_1|>``), its reference is recorded with the place of the placeholder, and it counts as many tokens as it
expands to: an image ``85 + 170`` for each tile of 512 x 512, audio 25 a second, a document 600 a page; of text, as
many as the tokenizer gives. Each turn is ``<|role|>\\ncontent<|end|>\\n``, whose two marks count one token each.

Placeholders and turn marks that stand in a text are escaped (``<|`` becomes ``<\\u200b|``), so none can be forged.

Turns of a conversation are brought together by one shuffle and streamed in order; only one conversation is held at a
time. Defined cases: each row with a null conversation id is a conversation of its own; a null turn comes first; equal turns are
ordered by role, then content; a null role is ``unknown``; null or empty content gives an empty turn; null parts are
left out and a part of another type is a placeholder of its type's name; negative or null measures count as 0; rows
that repeat are kept; other columns aren't read; an empty table gives no rows. A conversation's text is one value of one
row, so a conversation has to fit a task; rows without an id aren't shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import column
from lodestone.llm.sentencepiece_codec import codec

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
OUT = "conv_id bigint, text string, n_turns int, n_tokens bigint, attachments array<struct<kind:string,number:int,ref:string,turn:int,at:int,tokens:bigint>>"
TILE, TILE_TOKENS, IMAGE_TOKENS, SECOND_TOKENS, PAGE_TOKENS = 512, 170, 85, 25, 600


class Visitor:
    """Flattens parts; one for each conversation."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.length = 0
        self.last = ""
        self.numbers: dict[str, int] = {}
        self.attachments: list[dict] = []
        self.texts: list[str] = []
        self.tokens = 0
        self.turns = 0

    def put(self, text: str) -> None:
        if text:
            self.out.append(text)
            self.length += len(text)
            self.last = text[-1]

    def turn(self, role: str | None, parts: list[dict | None] | None) -> None:
        self.put(f"<|{(role or 'unknown').replace('|', '')}|>\n")
        for part in parts or []:
            if part is not None:
                kind = (part["type"] or "text").lower()
                getattr(self, f"visit_{kind}", self.visit_other)(part)
        self.put("<|end|>\n")
        self.tokens += 2
        self.turns += 1

    def visit_text(self, part: dict) -> None:
        text = part["text"] or ""
        if self.last == "<" and text[:1] == "|":
            text = "\u200b" + text
        text = text.replace("<|", "<\u200b|")
        self.texts.append(text)
        self.put(text)

    def visit_image(self, part: dict) -> None:
        tiles = [math.ceil(max(0, part[side] or 0) / TILE) for side in ("width", "height")]
        self.attach("image", part, IMAGE_TOKENS + TILE_TOKENS * tiles[0] * tiles[1])

    def visit_audio(self, part: dict) -> None:
        seconds = part["seconds"] or 0
        self.attach("audio", part, math.ceil(seconds * SECOND_TOKENS) if 0 < seconds < math.inf else 0)

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, max(0, part["pages"] or 0) * PAGE_TOKENS)

    def visit_other(self, part: dict) -> None:
        self.attach("".join(x for x in part["type"].lower() if x.isalnum()) or "other", part, 1)

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        number = self.numbers[kind] = self.numbers.get(kind, 0) + 1
        self.attachments.append({"kind": kind, "number": number, "ref": part["ref"], "turn": self.turns, "at": self.length, "tokens": tokens})
        self.tokens += tokens
        self.put(f"<|{kind}_{number}|>")


def format_chats(turns: DataFrame, model: bytes, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """One row a conversation: its text, tokens and attachments (``at``: where the placeholder starts in the text, in characters)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        ready: list[tuple[int | None, Visitor]] = []
        now: int | None = None
        visitor: Visitor | None = None

        def close() -> pa.RecordBatch:
            texts = [x for _, v in ready for x in v.texts]
            _, offsets = c.encode(pa.array(texts, pa.large_string()))
            counts = (offsets[1:] - offsets[:-1]).tolist()
            totals, at = [], 0
            for _, v in ready:
                totals.append(v.tokens + sum(counts[at : at + len(v.texts)]))
                at += len(v.texts)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("number", pa.int32()), ("ref", pa.string()), ("turn", pa.int32()), ("at", pa.int32()), ("tokens", pa.int64())]))
            arrays = [pa.array([i for i, _ in ready], pa.int64()), pa.array(["".join(v.out) for _, v in ready], pa.string()), pa.array([v.turns for _, v in ready], pa.int32()), pa.array(totals, pa.int64()), pa.array([v.attachments for _, v in ready], kind)]
            ready.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["conv_id", "text", "n_turns", "n_tokens", "attachments"])

        for b in batches:
            for conv, role, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if visitor is None or conv is None or conv != now:
                    if visitor is not None:
                        ready.append((now, visitor))
                    visitor, now = Visitor(), conv
                visitor.turn(role, parts)
            if sum(v.length for _, v in ready) > 4 << 20:
                yield close()
        if visitor is not None:
            ready.append((now, visitor))
        if ready:
            yield close()

    source = turns.select(column(conv_col).cast("bigint").alias("conv"), column(turn_col).cast("bigint").alias("turn"), column(role_col).cast("string").alias("role"), column(parts_col).cast(f"array<{PART}>").alias("parts"))
    columns = ("conv", "role", "parts")
    ordered = source.where("conv is not null").repartition("conv").sortWithinPartitions("conv", "turn", "role", F.to_json("parts"))
    return ordered.select(*columns).union(source.where("conv is null").select(*columns)).mapInArrow(run, OUT)


def text_part(text) -> F.Column:
    """A list of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))))


def other_part(kind: str, ref, width=None, height=None, seconds=None, pages=None) -> F.Column:
    values = (("width", width, "int"), ("height", height, "int"), ("seconds", seconds, "double"), ("pages", pages, "int"))
    return F.array(F.struct(F.lit(kind).alias("type"), F.lit(None).cast("string").alias("text"), ref.cast("string").alias("ref"), *((v if v is not None else F.lit(None)).cast(t).alias(n) for n, v, t in values)))


def transcript(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, text, n_turns) of conversations of text alone, by Spark's own operators."""
    role = F.regexp_replace(F.coalesce(F.nullif(role_col, F.lit("")), F.lit("unknown")), r"\|", "")
    body = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"<\|", "<\u200b|")
    line = F.concat(F.lit("<|"), role, F.lit("|>\n"), body, F.lit("<|end|>\n"))
    rows = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(turn_col), F.lit(-(1 << 62))).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), line.alias("line"))))
    grouped = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(rows.alias("rows"))
    return grouped.select("conv_id", F.array_join(F.col("rows.line"), "").alias("text"), F.size("rows").alias("n_turns"))
