"""Best-fit packing of tokenised documents into fixed-length training sequences, planned on the length histogram.

1. Every document is tokenised, ended with id 0, and cut into pieces of at
   most ``SEQUENCE`` tokens (only documents longer than that are cut). The narrow piece table is stored.
2. The histogram of piece lengths (at most ``SEQUENCE`` rows) is planned by best fit
   over counts: a sequence opens with the longest piece left and takes the
   longest that still fits, again and again; the resulting pattern is repeated as often
   as its counts last. The plan is bounded by the number of lengths, not of documents.
3. A piece's rank among those of its length is its rank inside its task plus the counts
   of earlier tasks (a small table of counts per task and length), so a
   frequent length is never gathered anywhere. Rank and length name the planned
   slot: sequence and offset.

Tokenising keeps a cache of words in each worker, of fixed size, and drops it when other work runs there. White space
never joins two tokens in the vocabularies meant here, and a run of ASCII
punctuation after a letter always starts a token of its own; so the ids of a text
are those of its words, in order. The tests compare with the tokenizer on whole texts.

Defined cases: a null text is an empty one (a single id 0); repeated rows are packed each; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hemicycle.llm.common import kept, stored, text_batches

SEQUENCE = 2048
END = b"\0\0\0\0"
WORDS_CACHED, STEMS_CACHED = 500_000, 600_000
PUNCTUATION = b".,!?;:#$%&*|"


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: visible Latin-1 bytes stand for themselves, the others for U+0100 and on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds:
    """Little-endian 32-bit ids of a text, by words; caches are dropped when full."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.words: dict[bytes, bytes] = {}
        self.stems: dict[bytes, bytes] = {}

    def _encode(self, new: list[bytes]) -> None:
        """Ids of new words. One that is lower-case letters throughout goes to the merges at once: normalising
        and splitting would leave it as it is."""
        other, model = [], self.tokenizer.model
        for w in new:
            if w.isalpha():  # ASCII letters
                s = w.decode()
            else:
                s = w.decode("utf-8", "replace")
                if not (s.isalpha() and s.lower() == s and unicodedata.is_normalized("NFC", s)):
                    other.append(w)
                    continue
                s = "".join([self.letters[b] for b in w])
            self.stems[w] = array("I", [t.id for t in model.tokenize(s)]).tobytes()
        texts = [w.decode("utf-8", "replace") for w in other]
        for w, e in zip(other, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            self.stems[w] = np.array(e.ids, "<u4").tobytes()

    @staticmethod
    def _split(word: bytes) -> tuple[bytes, bytes]:
        """(stem, run of punctuation after its last letter); an empty run where that is not sure to be a token start."""
        stem = word.rstrip(PUNCTUATION)
        if stem and len(stem) < len(word) and b"<" not in word:
            last = stem[-1:].decode("ascii", "ignore") or stem.decode("utf-8", "replace")[-1]
            if last.isalpha() and len(last.lower()) == 1:
                return stem, word[len(stem):]
        return word, b""

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of every text; ASCII letters are folded first, as the vocabulary does."""
        if len(self.words) > WORDS_CACHED:
            self.words.clear()
        if len(self.stems) > STEMS_CACHED:
            self.stems.clear()
        one: dict[bytes, list[bytes]] = {}  # copies within a batch are split once
        for t in texts:
            if t not in one:
                flat = t.replace(b"\n", b" ")
                one[t] = ([w if b"<|" in w else w.lower() for w in flat.split(b" ")] if b"<|" in t
                          else flat.lower().split(b" "))
        split = list(one.values())
        words, stems = self.words, self.stems
        parts = {w: self._split(w) for w in set().union(*split) if w not in words}
        fresh = {p for two in parts.values() for p in two if p and p not in stems}
        if fresh:
            self._encode(sorted(fresh))
        for w, (stem, tail) in parts.items():
            words[w] = (stems[stem] if stem else b"") + (stems[tail] if tail else b"")
        done = {t: b"".join([words[w] for w in s]) for t, s in one.items()}
        return [done[t] for t in texts]


def _pieces(path: str, sequence: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId()
        seen = np.zeros(sequence + 1, np.int64)
        names = ["key", "piece", "start", "length", "ids_crc32", "chunk", "local"]
        for batch in batches:
            for lo, hi in text_batches(batch, "text", 1 << 19):
                ids = kept("word ids", path, lambda: WordIds(path))  # one cache per worker process
                part = batch.slice(lo, hi - lo)
                rows, cols = [], [[] for _ in names[1:]]
                for i, raw in enumerate(ids.encode([x.as_py() for x in part.column("text")])):
                    raw = memoryview(raw + END)
                    n = len(raw) // 4
                    for k, start in enumerate(range(0, n, sequence)):
                        size = min(sequence, n - start)
                        for c, v in zip(cols, (k, start, size, zlib.crc32(raw[4 * start:4 * (start + size)]), chunk,
                                               int(seen[size])), strict=True):
                            c.append(v)
                        seen[size] += 1
                        rows.append(i)
                kinds = [pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()]
                yield pa.record_batch([part.column("key").take(pa.array(rows, pa.int64())),
                                       *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=names)
    return run


def plan(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (times, [(length, pieces of it)]) by best fit over counts, longest piece first."""
    left = np.zeros(sequence + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    out = []
    lengths = np.flatnonzero(left)
    while len(lengths):
        room, pattern = sequence, []
        top = len(lengths)
        while room and top:
            top = int(np.searchsorted(lengths[:top], room, side="right"))
            if not top:
                break
            length = int(lengths[top - 1])
            take = min(int(left[length]), room // length)
            pattern.append((length, take))
            room -= take * length
            top -= 1
        times = min(int(left[n]) // k for n, k in pattern)
        for n, k in pattern:
            left[n] -= times * k
        out.append((times, pattern))
        lengths = lengths[left[lengths] > 0]
    return out


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first sequence, pieces a sequence, first offset), by rank."""
    used: dict[int, int] = {}
    out: dict[int, list] = {}
    sequence = 0
    for times, pattern in patterns:
        offset = 0
        for length, k in pattern:
            at = used.get(length, 0)
            out.setdefault(length, []).append((at, sequence, k, offset))
            used[length] = at + times * k
            offset += length * k
        sequence += times
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def _place(table: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                row = table[int(n)][np.searchsorted(table[int(n)][:, 0], rank[own], side="right") - 1]
                k = rank[own] - row[:, 0]
                seq[own] = row[:, 1] + k // row[:, 2]
                off[own] = row[:, 3] + k % row[:, 2] * n
            names = ["key", "piece", "start", "length", "ids_crc32"]
            yield pa.record_batch([*[batch.column(c) for c in names], pa.array(seq), pa.array(off)],
                                  names=[*names, "sequence_id", "offset"])
    return run


def pack(df: DataFrame, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id",
         sequence: int = SEQUENCE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``tokenizer_path`` names a tokenizers JSON file present on every executor.
    """
    kind = dict(df.dtypes)[doc_id]
    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long"
    narrow = df.select(F.col(doc_id).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    pieces = stored(narrow.mapInArrow(_pieces(tokenizer_path, sequence), schema + ", chunk int, local long"), "pieces")
    counts = stored(pieces.groupBy("chunk", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(plan(histogram, sequence))
    earlier = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("chunk", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["chunk", "length"]).withColumn("rank", F.col("local") + F.col("before"))
    return (ranked.select("key", "piece", "start", "length", "ids_crc32", "rank")
            .mapInArrow(_place(table), schema + ", sequence_id long, offset long")
            .withColumnRenamed("key", "doc_id"))
