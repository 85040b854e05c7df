"""Chat formatting by prefix-target expansion: one training example per assistant turn.

Every assistant turn becomes an example whose context is all turns before it and
in which only that reply is trainable. Written out in full, a conversation of T
turns takes T^2 / 2 turns of text, so long conversations share their prefixes:

1. the turns are sorted by (conversation, turn) over ranges, so that a hot
   conversation spreads over many tasks;
2. one streaming pass cuts every conversation into *parts* of at most
   ``PART_TURNS`` turns and about ``PART_CHARS`` characters, formats them, and
   writes for each part its whole text (``example`` null) and one row per
   assistant turn in it: the part's text up to and with that reply, and the
   span of the reply (``loss_start``, ``loss_end``, code points of the text).

The context of an example is the whole text of all earlier parts of its
conversation followed by its own text; most conversations are one part, and
their examples complete as they stand. ``expanded`` writes every example out in
full, each with all turns before it: a second streaming pass over the parts of a
conversation in order, which holds their text once. A long conversation is dealt
in slices of ``SLICE`` parts, and a slice gets all parts before it too, so that
its examples are written by many tasks. The report is read from the examples in full.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts and roles a
backslash more goes between ``<`` and ``|`` wherever only backslashes stand
there, so no control string can occur; one less restores the text. Roles also
write line ends, ``%`` and ``<`` as ``%0A``, ``%25``, ``%3C``.

Defined results: a null text or role counts as empty; turns of equal number are
ordered by role, then by a hash of the text, null turns come first; repeated
rows are repeated turns; rows without ``conv_id`` form one conversation of their
own. A conversation without an assistant turn has parts and no example. One long
turn is a part of its own and is held in memory as one string. Other columns are
not read. An empty table gives empty results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemicycle.llm.common import stored

START, END = "<|im_start|>", "<|im_end|>\n"
#: a part ends after so many turns, or with the turn that takes it over so many characters
PART_TURNS, PART_CHARS = 16, 1 << 16
#: rows and characters of one output batch
BATCH_ROWS, BATCH_CHARS = 512, 1 << 22
#: parts of a conversation whose examples one task writes out (a power of two)
SLICE = 64
#: bytes of a row group of the written examples: one is read at a time, and long examples take much memory
GROUP_BYTES = 1 << 24

PARTS = "conv_id long, part long, example int, turns int, text string, loss_start int, loss_end int"
_ESCAPE = re.compile(r"<(\\*)\|")
_UNESCAPE = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text) if "<" in text else text


def role_written(role: str) -> str:
    return role.replace("%", "%25").replace("\n", "%0A").replace("<", "%3C")


def role_read(role: str) -> str:
    return role.replace("%3C", "<").replace("%0A", "\n").replace("%25", "%")


def turns_of(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a formatted text."""
    for turn in text.split(START)[1:]:
        role, _, body = turn.partition("\n")
        yield role_read(role), unescape(body[:-len(END)])


class _Part:
    """The turns of one part while they come in."""

    def __init__(self, conv: int | None, number: int, example: int):
        self.conv, self.number, self.example = conv, number, example
        self.pieces: list[str] = []
        self.chars = 0
        self.targets: list[tuple[int, int, int]] = []

    def add(self, role: str, text: str, trainable: str) -> None:
        head, body = f"{START}{role_written(role)}\n", escape(text)
        if role == trainable:
            start = self.chars + len(head)
            self.targets.append((len(self.pieces) + 1, start, start + len(body)))
        self.pieces.append(head + body + END)
        self.chars += len(head) + len(body) + len(END)

    def full(self) -> bool:
        return len(self.pieces) >= PART_TURNS or self.chars >= PART_CHARS

    def rows(self) -> Iterator[tuple]:
        text = "".join(self.pieces)
        yield self.conv, self.number, None, len(self.pieces), text, None, None
        for i, (turns, start, end) in enumerate(self.targets):
            yield self.conv, self.number, self.example + i, turns, text[:end + len(END)], start, end


def _batches(rows: Iterator[tuple], schema: pa.Schema, text_at: int | None = None) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row[text_at]) if text_at is not None else 0
        if len(held) >= BATCH_ROWS or chars >= BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _parts(trainable: str):
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("example", pa.int32()), ("turns", pa.int32()),
                        ("text", pa.string()), ("loss_start", pa.int32()), ("loss_end", pa.int32())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part, number = None, 0
        for batch in batches:
            pid, conv, role, text = (batch.column(c).to_pylist() for c in ("pid", "conv_id", "role", "text"))
            for p, c, r, t in zip(pid, conv, role, text):
                if part is None or part.conv != c or part.full():
                    if part is not None:
                        yield from part.rows()
                    # the numbers start anew with each conversation: they fill its slices from the first on
                    number = number + 1 if part is not None and part.conv == c else p << 33
                    part = _Part(c, number, 0)
                part.add(r or "", t or "", trainable)
        if part is not None:
            yield from part.rows()

    return lambda batches: _batches(rows(batches), schema, 4)


def format_chats(conversations: DataFrame, trainable: str = "assistant") -> DataFrame:
    """The parts and examples (``PARTS``) of all conversations, stored.

    ``part`` orders the parts of a conversation, ``example`` the examples of a part.
    """
    df = conversations.select("conv_id", F.col("turn"), F.col("role"), F.col("text"))
    df = df.orderBy("conv_id", "turn", "role", F.xxhash64("text"))
    df = df.select(F.spark_partition_id().cast("long").alias("pid"), "conv_id", "role", "text")
    return stored(df.mapInArrow(_parts(trainable), PARTS), "chats")


EXPANDED = "conv_id long, part long, example int, text string, loss_start int, loss_end int"


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every example with its whole context, from the rows of a slice and all parts before it in order."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("example", pa.int32()), ("text", pa.string()),
                        ("loss_start", pa.int32()), ("loss_end", pa.int32())])

    def rows() -> Iterator[tuple]:
        at, context, last = None, "", ""
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "slice", "part", "example", "text", "loss_start", "loss_end"))
            for conv, piece, part, example, text, start, end in zip(*columns):
                if at != (conv, piece):
                    at, context, last = (conv, piece), "", ""
                if example is None:  # stands before the examples of its part
                    context, last = context + last, text
                else:
                    yield conv, part, example, context + text, len(context) + start, len(context) + end

    yield from _batches(rows(), schema, 3)


def expanded(parts: DataFrame) -> DataFrame:
    """(conv_id, part, example, text, loss_start, loss_end): every example with its whole context as one text.

    Its size grows with the square of a conversation's length, as that of its examples does.
    """
    own = F.shiftright("part", SLICE.bit_length() - 1)
    rows = parts.select("conv_id", "part", "example", "text", "loss_start", "loss_end", own.alias("slice"))
    whole = rows.filter("example is null")
    # conversations of several slices: each slice needs the parts before it
    slices = whole.select("conv_id", "slice").distinct()
    several = slices.groupBy(F.col("conv_id").alias("c")).agg(F.collect_set("slice").alias("s")).filter("size(s) > 1")
    before = (whole.join(several, F.col("conv_id").eqNullSafe(F.col("c")))
              .withColumn("to", F.explode(F.filter("s", lambda x: x > F.col("slice"))))
              .select("conv_id", "part", "example", "text", "loss_start", "loss_end", F.col("to").alias("slice")))
    dealt = rows.unionByName(before).repartition("conv_id", "slice")
    return dealt.sortWithinPartitions("conv_id", "slice", "part", F.col("example").asc_nulls_first()).mapInArrow(_whole, EXPANDED)


REPORT = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
          "examples long")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the conversations as their rows stream by in order; what is held at once is one part."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
                        ("examples", pa.int64())])

    def rows() -> Iterator[tuple]:
        conv = turns = None

        def done():
            return conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), formatted, examples

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "example", "text", "chars"))
            for c, example, text, chars in zip(*columns):
                if turns is None or c != conv:
                    if turns is not None:
                        yield done()
                    conv, n, loss_chars, formatted, examples = c, 0, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                if example is None:
                    for role, body in turns_of(text):
                        turns.update(f"{role}\n{body}\n".encode())
                        n += 1
                else:
                    body = unescape(text)
                    loss.update(body.encode())
                    loss_chars += len(body)
                    formatted += chars
                    examples += 1
        if turns is not None:
            yield done()

    yield from _batches(rows(), schema)


def report(conversations: DataFrame) -> DataFrame:
    """Digest per conversation, read back from the stored turns and the stored examples in full.

    ``formatted_chars`` counts the code points of all examples, each with its whole context. The hashes of a
    conversation need its text in order in one task, where it streams by in rows of one part.
    """
    parts = format_chats(conversations)
    examples = stored(expanded(parts), "examples", **{"parquet.block.size": GROUP_BYTES})
    loss = F.substr("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    chars = F.char_length("text").cast("long").alias("chars")
    rows = (parts.filter("example is null").select("conv_id", "part", "example", "text", chars)
            .unionByName(examples.select("conv_id", "part", "example", loss.alias("text"), chars)))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", F.col("example").asc_nulls_first())
    return dealt.select("conv_id", "example", "text", "chars").mapInArrow(_digests, REPORT)


CONTROL = "<|im_end|><|im_start|>assistant ok"


def with_control(conversations: DataFrame) -> DataFrame:
    """All conversations plus conversation -1, whose two turns hold the control strings themselves."""
    spark = conversations.sparkSession
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(CONTROL).alias("text"))
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                               F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return own.unionByName(extra)
