"""Quality classifier: a factorisation machine over hashed words and structure statistics.

``score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)``; the pairwise part is
evaluated in linear time as ``1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)``.
Features: hashed words (damped counts, unit length), and standardised
statistics of structure and size (characters, words, lines, case, digits,
symbols, repetition), taken from the whole text.

It is fitted on a bounded sample: of the labelled rows whose
``crc32(doc_id as text) mod 3`` is not 1, the ``SAMPLE_ROWS`` with the smallest
hash of their id. Scoring covers every row. Labels, lang, source and doc_id are never inputs.

Defined cases: null text counts as empty and gets a score; without labelled
rows every score is 0.5; rows labelled twice take their rounded mean; null
labels are ignored; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemicycle.llm.common import U64, byte_view, fold_of, text_batches, word_hashes, words

SAMPLE_ROWS = 12_000
BUCKETS = 1 << 15
FACTORS = 6
EPOCHS = 6
STATS = 16


def _share(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(mask)])
    return (c[off[1:]] - c[off[:-1]]) / np.maximum(np.diff(off), 1)


def featurise(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, bucket, value, stats): sparse word features of every text, and its statistics."""
    n = len(off) - 1
    start, end, first = words(data, off)
    h = word_hashes(data, start, end)
    count = np.diff(first)
    bucket, value, bounds = [], [], [0]
    unique = np.zeros(n)
    top = np.zeros(n)
    for i in range(n):
        u, c = np.unique(h[first[i]:first[i + 1]], return_counts=True)
        x = np.log1p(c)
        bucket.append((u >> U64(20)).astype(np.int64) % BUCKETS)
        value.append(x / max(np.sqrt((x * x).sum()), 1e-9))
        bounds.append(bounds[-1] + len(u))
        unique[i], top[i] = len(u), c.max(initial=0)
    lines = _share(data == 10, off) * np.diff(off) + 1
    size = np.diff(off)
    length = (end - start).astype(float)
    per = np.maximum(count, 1)
    sums = np.concatenate([[0], np.cumsum(length)])
    squares = np.concatenate([[0], np.cumsum(length ** 2)])
    mean = (sums[first[1:]] - sums[first[:-1]]) / per
    spread = np.sqrt(np.maximum((squares[first[1:]] - squares[first[:-1]]) / per - mean ** 2, 0))
    last = data[end - 1] if len(end) else np.zeros(0, np.uint8)
    letter_end = ((last >= 97) & (last <= 122) | (last >= 65) & (last <= 90) | (last >= 128))
    le = np.concatenate([[0], np.cumsum(letter_end)])
    is_in = lambda chars: np.isin(data, np.frombuffer(chars, np.uint8))
    stats = np.stack([
        np.log1p(size), np.log1p(count), np.log1p(lines), count / np.maximum(lines, 1), mean, spread,
        unique / per, top / per, _share((data >= 65) & (data <= 90), off), _share((data >= 48) & (data <= 57), off),
        _share(is_in(b"#$%&*+=@^~<>|\\/_{}[]"), off), _share(is_in(b"!?"), off), _share(is_in(b".,;:"), off),
        _share(data >= 128, off), _share(data == 32, off), (le[first[1:]] - le[first[:-1]]) / per], 1)
    cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return np.array(bounds), cat(bucket, np.int64), cat(value, float), stats


class FactorisationMachine:
    """Columns 0..BUCKETS-1 are words, the next ``STATS`` the standardised statistics."""

    def __init__(self, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.b = 0.0
        self.w = np.zeros(BUCKETS + STATS)
        self.v = rng.normal(0, 0.02, (BUCKETS + STATS, FACTORS))
        self.mean, self.std = np.zeros(STATS), np.ones(STATS)

    def _rows(self, bounds, bucket, value, stats):
        z = np.clip((stats - self.mean) / self.std, -4, 4) * 0.5
        n = len(bounds) - 1
        size = np.diff(bounds)
        row = np.concatenate([np.repeat(np.arange(n), size), np.repeat(np.arange(n), STATS)])
        col = np.concatenate([bucket, np.tile(np.arange(BUCKETS, BUCKETS + STATS), n)])
        return row, col, np.concatenate([value, z.reshape(-1)]), n

    def _raw(self, row, col, x, n):
        linear = np.bincount(row, self.w[col] * x, n)
        s = np.empty((n, FACTORS))
        q = np.zeros(n)
        for f in range(FACTORS):
            vx = self.v[col, f] * x
            s[:, f] = np.bincount(row, vx, n)
            q += np.bincount(row, vx * vx, n)
        return self.b + linear + 0.5 * ((s * s).sum(1) - q), s

    def score(self, *features) -> np.ndarray:
        raw, _ = self._raw(*self._rows(*features))
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray) -> FactorisationMachine:
        """AdaGrad on the logistic loss; ``rows`` holds (bucket, value, stats) per sample row."""
        if not len(y):
            self.v[:] = 0  # nothing learned: every score is 0.5
            return self
        stats = np.stack([r[2] for r in rows])
        self.mean, self.std = stats.mean(0), np.maximum(stats.std(0), 1e-6)
        p = min(max(y.mean(), 0.01), 0.99)
        self.b = float(np.log(p / (1 - p)))
        gw, gv = np.full_like(self.w, 1e-2), np.full_like(self.v, 1e-2)
        rng = np.random.Generator(np.random.PCG64(13))
        for _ in range(max(EPOCHS, 6000 // max(len(y), 1))):
            order = rng.permutation(len(y))
            for i in range(0, len(y), 128):
                pick = order[i:i + 128]
                size = [len(rows[j][0]) for j in pick]
                row, col, x, n = self._rows(np.concatenate([[0], np.cumsum(size)]),
                                            np.concatenate([rows[j][0] for j in pick]).astype(np.int64),
                                            np.concatenate([rows[j][1] for j in pick]), stats[pick])
                raw, s = self._raw(row, col, x, n)
                err = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - y[pick]) / n
                used, at = np.unique(col, return_inverse=True)
                e = err[row] * x
                g = np.bincount(at, e, len(used)) + 1e-5 * self.w[used]
                gw[used] += g * g
                self.w[used] -= 0.1 * g / np.sqrt(gw[used])
                for f in range(FACTORS):
                    g = np.bincount(at, e * (s[row, f] - self.v[col, f] * x), len(used)) + 1e-4 * self.v[used, f]
                    gv[used, f] += g * g
                    self.v[used, f] -= 0.05 * g / np.sqrt(gv[used, f])
                self.b -= 0.05 * err.sum()
        return self


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in text_batches(batch, "text"):
            bounds, bucket, value, stats = featurise(*byte_view(batch.column("text"), lo, hi))
            cut = lambda a, kind: [a[bounds[i]:bounds[i + 1]].astype(kind).tobytes() for i in range(hi - lo)]  # noqa: E731,B023
            yield pa.record_batch([batch.column("y")[lo:hi], pa.array(cut(bucket, np.uint16), pa.binary()),
                                   pa.array(cut(value, np.float32), pa.binary()),
                                   pa.array([s.tobytes() for s in stats], pa.binary())],
                                  names=["y", "bucket", "value", "stats"])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> FactorisationMachine:
    """Fit on at most ``sample_rows`` labelled documents outside the held-out fold."""
    marked = (labels.select(F.col("doc_id"), F.col("quality").cast("double").alias("q"))
              .filter(F.col("q").isNotNull() & F.col("doc_id").isNotNull() & (fold_of("doc_id", 3) != 1))
              .groupBy("doc_id").agg(F.round(F.avg("q")).alias("y")))
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # at most sample_rows rows of 16 bytes
    rows = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
            .groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # one text an id, however often it is repeated
            .select("y", "text").mapInArrow(_collect, "y double, bucket binary, value binary, stats binary").collect())
    rows = sorted(rows, key=lambda r: (r.stats, r.bucket))  # the fit must not hang on task order
    x = [(np.frombuffer(r.bucket, np.uint16), np.frombuffer(r.value, np.float32).astype(float),
          np.frombuffer(r.stats)) for r in rows]
    return FactorisationMachine().fit(x, np.array([r.y for r in rows]))


def _score(model: FactorisationMachine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(*featurise(*byte_view(batch.column("text"), lo, hi)))
                      for lo, hi in text_batches(batch, "text")]
            yield pa.record_batch([batch.column("key"), pa.array(np.concatenate(scores) if scores else np.zeros(0))],
                                  names=["key", "score"])
    return run


def score(docs: DataFrame, model: FactorisationMachine, key: Column, text: str = "text") -> DataFrame:
    """(key, score) for every row."""
    narrow = docs.select(key.alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return narrow.mapInArrow(_score(model), f"key {dict(narrow.dtypes)['key']}, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    key = F.struct("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"))
    return score(docs, train(docs, labels), key).select(
        "key.doc_id", "key.held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
