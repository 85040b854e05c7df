"""Language identification as multilingual mixture inference.

Each language is a distribution over hashed byte trigrams (letters folded,
other ASCII as space), counted over all labelled documents of the training
fold. For every document, expectation maximisation estimates its language
proportions from the trigram likelihoods. The language set is then chosen by
penalised likelihood among the nested sets of its most probable languages, which grow until
``PATIENCE`` larger sets bring nothing more; the largest language of the chosen set is the prediction.

Training sums at most (languages x ``BUCKETS``) counts in Spark, over every
row of the fold. ``lang``, ``source`` and ``doc_id`` never enter a prediction.

Defined cases: null text, or text without any letter: ``und`` with score 0; no
labelled row to learn from: ``und`` everywhere, and ``accept`` keeps every text with a letter; null ids belong to the fold of the empty text;
whole texts are read in bounded chunks of rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemicycle.llm.common import byte_view, fold_of, text_batches

UNKNOWN = "und"
BUCKETS = 4096
#: a set grows on while one of so many next larger sets still raises the penalised likelihood
PATIENCE = 2
ITERATIONS = 12
#: nats per additional language and log(trigram): trigrams overlap, so more than the 0.5 of independent draws
PENALTY = 3.0
#: a text is rejected when its fit is so many deviations below the labelled rows of its language
DEVIATIONS = 9.0
#: spread of the fit (nats) assumed with the weight of so many rows, for few labelled rows
PRIOR_SPREAD, PRIOR_ROWS = 0.5, 10
_ROWS = 64

_FOLD = np.full(256, 32, np.uint32)
_FOLD[128:] = np.arange(128, 256)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def trigram_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts x BUCKETS) counts of hashed trigrams; those with two spaces or across texts do not count."""
    n = len(off) - 1
    b = _FOLD[data]
    if len(b) < 3:
        return np.zeros((n, BUCKETS), np.float32)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    bucket = ((h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(20)).astype(np.int64)
    space = (b == 32).astype(np.int8)
    use = space[:-2] + space[1:-1] + space[2:] < 2
    row = np.repeat(np.arange(n), np.diff(off))
    use &= row[:-2] == row[2:]
    at = row[:-2][use] * BUCKETS + bucket[use]
    return np.bincount(at, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi in text_batches(batch, "text"):
        for a in range(lo, hi, _ROWS):
            b = min(a + _ROWS, hi)
            yield (a, b, *byte_view(batch.column("text"), a, b))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for a, b, data, off in _pieces(batch):
            c = trigram_counts(data, off)
            names = langs[a:b]
            for name in set(names):
                own = c[[i for i, x in enumerate(names) if x == name]].sum(0, dtype=np.float64)
                total[name] = total.get(name, 0) + own
    for name, c in total.items():
        at = np.flatnonzero(c)
        yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()),
                               pa.array(c[at].astype(np.int64))], names=["lang", "at", "n"])


def train(df: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, their trigram distributions) from all rows with a text and a language."""
    rows = (df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
            .select(F.col(text).alias("text"), F.col(lang).alias("lang"))
            .mapInArrow(_count, "lang string, at int, n long").groupBy("lang", "at").sum("n").collect())
    langs = sorted({r[0] for r in rows})
    counts = np.zeros((len(langs), BUCKETS))
    for name, at, n in rows:  # at most languages x BUCKETS sums
        counts[langs.index(name), at] = n
    counts += 0.5
    return langs, (counts / counts.sum(1, keepdims=True)).astype(np.float32)


def _expectation_maximisation(c: np.ndarray, p: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log-likelihood) of every row of counts ``c``, over its allowed languages."""
    share = allowed / np.maximum(allowed.sum(1, keepdims=True), 1)
    total = np.maximum(c.sum(1, keepdims=True), 1)
    for _ in range(rounds):
        share = share * ((c / np.maximum(share @ p, 1e-20)) @ p.T) / total
    return share, (c * np.log(np.maximum(share @ p, 1e-20))).sum(1)


def infer(c: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, its share, size of the language set) per row of trigram counts."""
    return _chosen(c, p)[:3]


def _chosen(c: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``infer``, and the fit: log-likelihood per trigram of the chosen set, without what mixing languages costs."""
    c = c.astype(np.float32)
    full, _ = _expectation_maximisation(c, p, np.ones((len(c), len(p)), np.float32), ITERATIONS)
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
    n = np.maximum(c.sum(1), 2)
    best = np.full(len(c), -np.inf)
    out, share, size, fit = np.zeros(len(c), int), np.zeros(len(c)), np.ones(len(c), int), np.zeros(len(c))
    total = np.maximum(c.sum(1), 1)
    for k in range(1, len(p) + 1):
        rows = np.flatnonzero(k - size <= PATIENCE)
        if not len(rows):
            break
        pi, ll = _expectation_maximisation(c[rows], p, (rank[rows] < k).astype(np.float32), 1 if k == 1 else ITERATIONS // 2)
        score = ll - PENALTY * (k - 1) * np.log(n[rows])
        better = score > best[rows]
        rows, pi, ll = rows[better], pi[better], ll[better]
        best[rows], size[rows] = score[better], k
        out[rows] = pi.argmax(1)
        mixing = -(pi * np.log(np.maximum(pi, 1e-20))).sum(1)
        fit[rows] = ll / total[rows] + mixing
    share = full[np.arange(len(c)), out]
    return out, np.clip(share, 0, 1), size, fit


def _fits(model: tuple[list[str], np.ndarray]):
    langs, p = model
    log_p = np.log(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), 4))
        for batch in batches:
            names = batch.column("lang").to_pylist()
            for a, b, data, off in _pieces(batch):
                c = trigram_counts(data, off)
                n = c.sum(1)
                at = np.array([langs.index(x) if x in langs else -1 for x in names[a:b]])
                use = (n > 0) & (at >= 0)
                c, n, at = c[use], n[use], at[use]
                fit = (c * log_p[at]).sum(1) / n
                inner = (c * (log_p[at] - fit[:, None]) ** 2).sum(1) / n
                np.add.at(total, at, np.stack([np.ones(len(n)), fit, fit * fit, inner], 1))
        yield pa.record_batch([pa.array(range(len(langs)), pa.int32()), *[pa.array(v) for v in total.T]],
                              names=["at", "rows", "fit", "square", "inner"])
    return run


def limits(df: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", lang: str = "lang") -> np.ndarray:
    """(languages x 3) mean fit of the labelled rows, its variance between rows, variance of a trigram within rows."""
    langs = model[0]
    if not langs:
        return np.zeros((0, 3))
    rows = (df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
            .select(F.col(text).alias("text"), F.col(lang).alias("lang"))
            .mapInArrow(_fits(model), "at int, rows double, fit double, square double, inner double")
            .groupBy("at").sum("rows", "fit", "square", "inner").collect())
    n, fit, square, inner = np.array([r[1:] for r in sorted(rows)]).reshape(-1, 4).T  # one sum per language
    mean = fit / np.maximum(n, 1)
    spread = (np.maximum(square - n * mean * mean, 0) + PRIOR_ROWS * PRIOR_SPREAD ** 2) / (n + PRIOR_ROWS)
    return np.stack([mean, spread, inner / np.maximum(n, 1)], 1)


def has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    out = np.zeros(len(off) - 1, bool)
    ascii_letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    out |= ascii_letters[off[1:]] > ascii_letters[off[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(ch.isalpha() for ch in data[off[i]:off[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def _predict(model: tuple[list[str], np.ndarray]):
    langs, p = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, sizes = [], [], []
            for a, b, data, off in _pieces(batch):
                if not langs:
                    names += [UNKNOWN] * (b - a)
                    scores += [0.0] * (b - a)
                    sizes += [0] * (b - a)
                    continue
                ok = has_letter(data, off)
                best, share, size = infer(trigram_counts(data, off), p)
                names += [langs[i] if x else UNKNOWN for i, x in zip(best, ok, strict=True)]
                scores += np.where(ok, share, 0.0).tolist()
                sizes += np.where(ok, size, 0).tolist()
            rest = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"]
            keep = [n for n in batch.schema.names if n != "text"]
            yield pa.record_batch([*rest, pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                                   pa.array(sizes, pa.int32())], names=[*keep, "lang_pred", "score", "languages"])
    return run


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], key: Column, text: str = "text") -> DataFrame:
    """(key, lang_pred, score, languages) per row; ``languages`` is the size of the chosen set."""
    narrow = df.select(key.alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = dict(narrow.dtypes)["key"]
    return narrow.mapInArrow(_predict(model), f"key {kind}, lang_pred string, score double, languages int")


def _accepted(model: tuple[list[str], np.ndarray], limit: np.ndarray | None):
    langs, p = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for a, b, data, off in _pieces(batch):
                keep[a:b] = has_letter(data, off)
                if langs and limit is not None:
                    c = trigram_counts(data, off)
                    n = c.sum(1)
                    best, _, _, fit = _chosen(c, p)
                    mean, spread, inner = limit[best].T
                    # trigrams overlap: their sum varies like that of a third as many
                    keep[a:b] &= (n == 0) | (fit >= mean - DEVIATIONS * np.sqrt(spread + 3 * inner / np.maximum(n, 1)))
            yield batch.filter(pa.array(keep))
    return run


def accept(df: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", limit: np.ndarray | None = None) -> DataFrame:
    """The rows of ``df`` in a recognised language, with all their columns.

    Rows without a letter go, and with ``limits`` those that fit no learned language. Without a learned
    language every row with a letter stays.
    """
    # each column passes once; a name of its own keeps clashing names apart from the text's
    own = [F.col(f"`{c}`").alias("text" if c == text else f"c{i}") for i, c in enumerate(df.columns)]
    found = df.select(*own)
    return found.mapInArrow(_accepted(model, limit), found.schema).toDF(*df.columns)


def report(df: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    fold = fold_of("doc_id", 4)
    model = train(df.filter(fold != 2))
    key = F.struct("doc_id", (fold == 2).alias("held_out"))
    return predict(df, model, key).select("key.doc_id", "key.held_out", "lang_pred", "score")
