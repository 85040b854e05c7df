"""Benchmark decontamination by latent semantic retrieval.

1. *Corpus statistics*: document frequencies of hashed words over the passages
   (``PASSAGE`` words) of all documents.
2. *Distributed randomised SVD* of the TF-IDF passage matrix A: every task
   multiplies its passages with the same random matrix, Y = A W, and sums A'Y and
   Y'Y. With R'R = Y'Y, the rows of B = R^-T (A'Y)' are Q'A for an orthonormal basis Q of
   Y's range; the SVD of the small B gives the term vectors. One pass, and
   sums of fixed size (``FEATURES`` x ``RANK``) whatever the input.
3. *Cosine candidate search*: all windows of all texts (half overlapping, in
   widths matched to the item lengths) against the items, in the whitened latent space. Windows that hold too few
   rare words of any item to pass step 4 are not projected.
4. *Verification* of candidates in the same task, on the words themselves: the
   longest common subsequence of the item with the best span near the window
   must reach ``LCS`` of the item, and its rarest words (the answer words, where the
   benchmark has an ``answer`` column) must be there to ``ANSWER``.

The benchmark is read in blocks of at most ``BLOCK_ITEMS`` items, each one
scan of the corpus. Words are runs of letters and digits, case folded by Unicode; each letter of a
script without spaces is a word.

Defined cases: null or empty texts match nothing; items of fewer than
``MIN_WORDS`` words match where they stand word for word, unless all their words are common; items without a word match nothing; repeated items and rows match each; empty
tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemicycle.llm.common import U64, byte_view, mix, seeded, stored, text_batches, word_hashes, words

FEATURES, RANK = 2048, 64
PASSAGE = 48
STEP = 12
WIDTHS = (24, 48, 96)
COSINE, LCS, ANSWER = 0.2, 0.7, 0.6
RARE_SHARE = 0.25
MIN_WORDS = 5
#: a word in this share of the passages or more is common: short items of common words alone are no evidence
COMMON = 0.1
BLOCK_ITEMS = 2000
_ROWS = 512
_CHUNKS = 32

_INSIDE = np.zeros(256, bool)
_INSIDE[128:] = True
for _r in ((48, 58), (65, 91), (97, 123)):
    _INSIDE[slice(*_r)] = True


#: letters of scripts written without spaces: each is a word
_ALONE = ((0x0E01, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3041, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF),
          (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9D), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF))


def _kinds() -> np.ndarray:
    """By code point: 1 parts words (punctuation, symbols, spaces beyond ASCII), 2 is a word of its own, 0 is inside a word."""
    kind = np.zeros(0x40001, np.uint8)
    for a, b in _ALONE:
        kind[a:b + 1] = 2
    kind[128:0x20000][[unicodedata.category(chr(c))[0] in "PSZ" for c in range(128, 0x20000)]] = 1
    return kind


_KIND = _kinds()


def _plain(raw: bytes) -> bytes:
    """UTF-8 with case folded by Unicode, spaces for punctuation beyond ASCII, and letters without spaces set apart."""
    text = raw.decode("utf-8", "replace").casefold()
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    kind = _KIND[np.minimum(code, len(_KIND) - 1)]
    alone = kind == 2
    out = np.full(len(code) + 2 * int(alone.sum()), 32, np.uint32)
    out[np.arange(len(code)) + 2 * np.cumsum(alone) - alone] = np.where(kind == 1, 32, code)
    return out.tobytes().decode("utf-32-le").encode()


def folded_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of every text)."""
    inside = None
    if len(data):
        # beyond Latin-1, and for its letters that do not fold to one of the same block, whole texts are rewritten
        odd = data >= 0xC4
        odd[:-1] |= (data[:-1] == 0xC3) & (data[1:] == 0x9F) | (data[:-1] == 0xC2) & (data[1:] == 0xB5)
        total = np.concatenate([[0], np.cumsum(odd)])
        change = total[off[1:]] > total[off[:-1]]
        if change.any():
            parts = [data[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)]
            parts = [_plain(x) if c else x for x, c in zip(parts, change, strict=True)]
            data = np.frombuffer(b"".join(parts), np.uint8)
            off = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
        data = data.copy()
        lead = np.flatnonzero(data[:-1] == 0xC3) + 1  # capitals of Latin-1: U+00C0..U+00DE
        up = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E) & (data[lead] != 0x97)]
        inside = _INSIDE[data]
        sign = lead[(data[lead] == 0x97) | (data[lead] == 0xB7)]
        data[up] += 0x20
        lead = np.flatnonzero(data[:-1] == 0xC2) + 1  # signs of Latin-1: U+0080..U+00BF but three letters
        sign = np.concatenate([sign, lead[(data[lead] != 0xAA) & (data[lead] != 0xB5) & (data[lead] != 0xBA)]])
        inside[sign] = inside[sign - 1] = False
    start, end, first = words(data, off, inside)
    return word_hashes(data, start, end), first


def _feature(h: np.ndarray) -> np.ndarray:
    return (h >> U64(40)).astype(np.int64) % FEATURES


def _cut(first: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, text) of consecutive runs of ``step`` words in every text."""
    n = -(-np.diff(first) // step)
    text = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(text)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    return first[text] + within * step, text


def _chunks(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for lo, hi in text_batches(batch, "text"):
            h, first = folded_words(*byte_view(batch.column("text"), lo, hi))
            yield batch, lo, hi, h, first


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages holding each feature; the row ``FEATURES`` counts the passages."""
    df = np.zeros(FEATURES + 1, np.int64)
    for _, _, _, h, first in _chunks(batches):
        starts, _ = _cut(first, PASSAGE)
        if len(starts):
            row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(h))))
            df[:-1] += np.bincount(np.unique(row * FEATURES + _feature(h)) % FEATURES, minlength=FEATURES)
            df[-1] += len(starts)
    at = np.flatnonzero(df)
    yield pa.record_batch([pa.array(at, pa.int32()), pa.array(df[at])], names=["feature", "n"])


def idf_weights(docs: DataFrame) -> np.ndarray:
    rows = docs.mapInArrow(_frequencies, "feature int, n long").groupBy("feature").sum("n").collect()
    df = np.zeros(FEATURES + 1)
    for feature, n in rows:  # FEATURES + 1 sums
        df[feature] = n
    return np.log((1 + df[-1]) / (1 + df[:-1])).astype(np.float32) + 1e-3


def _tfidf(feature: np.ndarray, row: np.ndarray, rows: int, idf: np.ndarray, out: np.ndarray) -> np.ndarray:
    a = out[:rows]
    a[:] = 0
    np.add.at(a.reshape(-1), row * FEATURES + feature, idf[feature])
    a /= np.maximum(np.sqrt((a * a).sum(1, keepdims=True)), 1e-9)
    return a


def _range_finder(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omega = np.random.Generator(np.random.PCG64(21)).normal(size=(FEATURES, RANK)).astype(np.float32)
        g, s = np.zeros((FEATURES, RANK)), np.zeros((RANK, RANK))
        dense = np.empty((_ROWS, FEATURES), np.float32)
        for _, _, _, h, first in _chunks(batches):
            starts, _ = _cut(first, PASSAGE)
            ends = np.append(starts, len(h))
            feature = _feature(h)
            for i in range(0, len(starts), _ROWS):
                lo, hi = ends[i], ends[min(i + _ROWS, len(starts))]
                n = min(_ROWS, len(starts) - i)
                row = np.repeat(np.arange(n), np.diff(ends[i:i + n + 1]))
                a = _tfidf(feature[lo:hi], row, n, idf, dense)
                y = a @ omega
                g += a.T @ y
                s += y.T @ y
        both = np.concatenate([g, s]).astype(np.float32)
        parts = np.array_split(both, _CHUNKS)
        yield pa.record_batch([pa.array(range(_CHUNKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())],
                              names=["chunk", "data"])
    return run


def _sum_chunks(key, table):  # no annotations: Spark reads them
    total = None
    for x in table.column("data"):
        v = np.frombuffer(x.as_buffer(), np.float32).astype(np.float64)
        total = v if total is None else total + v
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "sum": pa.array([total.tobytes()], pa.binary())})


def term_vectors(docs: DataFrame, idf: np.ndarray) -> np.ndarray:
    """(FEATURES x RANK) whitened right singular vectors, weighted by idf: the latent code of a word."""
    rows = (docs.mapInArrow(_range_finder(idf), "chunk int, data binary").groupBy("chunk")
            .applyInArrow(_sum_chunks, "chunk int, sum binary").collect())
    if not rows:
        return np.zeros((FEATURES, RANK), np.float32)
    both = np.concatenate([np.frombuffer(r["sum"]).reshape(-1, RANK) for r in sorted(rows)])
    g, s = both[:FEATURES], both[FEATURES:]
    # Y = QR with R'R = Y'Y (eigenvalues instead of Cholesky: a small corpus has less than full rank)
    value, vector = np.linalg.eigh((s + s.T) / 2)
    ok = value > 1e-9 * max(value.max(), 1e-9)
    b = (vector[:, ok] / np.sqrt(value[ok])).T @ g.T
    _, sigma, vt = np.linalg.svd(b, full_matrices=False)
    good = sigma > 1e-6 * max(sigma.max(initial=0), 1e-9)
    out = np.zeros((FEATURES, RANK), np.float32)
    out[:, :good.sum()] = (vt[good] / sigma[good, None]).T * idf[:, None]
    return out


def _phrase_keys(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words."""
    weight = seeded(MIN_WORDS, 31) | U64(1)
    size = max(len(h) - n + 1, 0)
    key = np.zeros(size, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            key += h[j:j + size] * weight[j]
    return mix(key)


class Items:
    """A block of benchmark items, coded for search and verification."""

    def __init__(self, rows: list[tuple], code: np.ndarray, idf: np.ndarray):
        self.ids, self.words, self.rare, self.masks = [], [], [], []
        latent, short = [], []
        for item_id, text, answer in rows:
            raw = (text or "").encode("utf-8", "replace")
            h, _ = folded_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            if len(h) < MIN_WORDS:
                if len(h) and idf[_feature(h)].max() >= -np.log(COMMON):
                    short.append((item_id, h))
                continue
            if answer:
                raw = answer.encode("utf-8", "replace")
                rare, _ = folded_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            else:
                distinct = np.unique(h)
                weight = idf[_feature(distinct)]
                rare = distinct[np.argsort(-weight, kind="stable")[:max(2, int(RARE_SHARE * len(distinct)))]]
            mask: dict[int, int] = {}
            for i, w in enumerate(h.tolist()):
                mask[w] = mask.get(w, 0) | 1 << i
            self.ids.append(item_id)
            self.words.append(h)
            self.rare.append(rare)
            self.masks.append(mask)
            latent.append(code[_feature(h)].sum(0))
        # phrases by their number of words: (sorted keys, items)
        self.phrases = []
        for n in sorted({len(h) for _, h in short}):
            mine = [(int(_phrase_keys(h, n)[0]), len(self.ids) + k) for k, (_, h) in enumerate(short) if len(h) == n]
            keys, items = zip(*sorted(mine), strict=True)
            self.phrases.append((n, np.array(keys, np.uint64), items))
        self.ids += [i for i, _ in short]
        self.all_rare = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.rare]))
        self.need = np.array([int(np.ceil(ANSWER * len(np.unique(r)))) for r in self.rare], int)
        # rare word -> items that hold it
        pairs = sorted({(int(np.searchsorted(self.all_rare, w)), i) for i, r in enumerate(self.rare) for w in r})
        self.holder = np.array([i for _, i in pairs], np.int64)
        self.held = np.searchsorted(np.array([s for s, _ in pairs]), np.arange(len(self.all_rare) + 1))
        latent = np.array(latent, np.float32).reshape(-1, RANK)
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
        size = np.array([len(w) for w in self.words], int)
        width = np.searchsorted(WIDTHS[:-1], size)
        self.groups = [(WIDTHS[k], np.flatnonzero(width == k), latent[width == k]) for k in range(len(WIDTHS))
                       if (width == k).any()]

    def lcs(self, item: int, span: np.ndarray) -> int:
        """Length of the longest common subsequence, by bit-parallel dynamic programming."""
        mask, n = self.masks[item], len(self.words[item])
        full = (1 << n) - 1
        v = full
        for w in span.tolist():
            m = mask.get(w)
            if m:
                u = v & m
                v = ((v + u) | (v - u)) & full
        return n - v.bit_count()

    def verify(self, item: int, text: np.ndarray, lo: int, hi: int) -> tuple[int, int, float] | None:
        """(first word, end word, LCS share) of the best span of ``text`` near ``lo:hi``, if it holds the item."""
        n = len(self.words[item])
        lo, hi = max(0, lo - n), min(len(text), hi + n)
        region = np.sort(text[lo:hi])
        at = np.minimum(np.searchsorted(region, self.rare[item]), len(region) - 1)
        if (region[at] == self.rare[item]).mean() < ANSWER:
            return None
        hit = np.isin(text[lo:hi], self.words[item])
        need = LCS * n
        if hit.sum() < need:
            return None
        width = n + n // 2
        total = np.concatenate([[0], np.cumsum(hit)])
        best = int(np.argmax(total[np.minimum(np.arange(len(hit)) + width, len(hit))] - total[:-1]))
        span = text[lo + best:min(lo + best + width, hi)]
        if np.isin(self.rare[item], span).mean() < ANSWER:
            return None
        share = self.lcs(item, span) / n
        if share < LCS:
            return None
        at = np.flatnonzero(np.isin(span, self.words[item]))
        return lo + best + int(at[0]), lo + best + int(at[-1]) + 1, share


def _find_phrases(h: np.ndarray, first: np.ndarray, items: Items) -> list[tuple[int, int, int, int, float, float]]:
    """Verbatim matches of the items of fewer than ``MIN_WORDS`` words, in the form of ``find``."""
    out = []
    for n, keys, owner in items.phrases:
        key = _phrase_keys(h, n)
        lo, hi = np.searchsorted(keys, key, side="left"), np.searchsorted(keys, key, side="right")
        after: dict[tuple[int, int], int] = {}
        for at in np.flatnonzero(hi > lo).tolist():
            t = int(np.searchsorted(first, at, side="right")) - 1
            if at + n > first[t + 1]:
                continue
            for item in owner[lo[at]:hi[at]]:
                if at >= after.get((t, item), 0):
                    after[t, item] = at + n
                    out.append((t, item, int(at - first[t]), int(at - first[t]) + n, 1.0, 1.0))
    return out


def find(h: np.ndarray, first: np.ndarray, code: np.ndarray, items: Items) -> list[tuple[int, int, int, int, float, float]]:
    """(text, item, first word, end word, LCS share, cosine) of the verified matches, one per item and disjoint span."""
    starts, text = _cut(first, STEP)
    phrases = _find_phrases(h, first, items)
    if not len(starts) or not items.groups:
        return phrases
    feature = _feature(h)
    code = np.concatenate([code, np.zeros((1, RANK), np.float32)])
    # a window without enough rare words of any item cannot be verified: it is not even projected
    slot = np.minimum(np.searchsorted(items.all_rare, h), len(items.all_rare) - 1)
    hit = np.flatnonzero(items.all_rare[slot] == h)
    rare = np.zeros(len(h) + 1, np.int64)
    rare[hit + 1] = 1
    rare = np.cumsum(rare)
    # places of every item's own rare words, as one sorted key (item, place)
    n = np.diff(items.held)[slot[hit]]
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    base = len(h) + 1
    own = np.sort(items.holder[np.repeat(items.held[slot[hit]], n) + nth] * base + np.repeat(hit, n))
    size = np.array([len(w) for w in items.words])
    place = starts - first[text]
    found: dict[tuple[int, int], list] = {}
    for width, index, latent in items.groups:
        at = np.flatnonzero(place % (width // 2) == 0)
        near = size[index].max()
        lo = np.maximum(starts[at] - near, first[text[at]])
        hi = np.minimum(starts[at] + width + near, first[text[at] + 1])
        at = at[rare[hi] - rare[lo] >= items.need[index].min()]
        if not len(at):
            continue
        stop = np.minimum(starts[at] + width, first[text[at] + 1])
        n = stop - starts[at]
        # places past the end of a text read a zero row, so all windows have one shape
        x = np.empty((len(at), RANK), np.float32)
        for i in range(0, len(at), 128):
            step = np.arange(width)
            word = np.minimum(starts[at[i:i + 128], None] + step, len(h) - 1)
            x[i:i + 128] = code[np.where(step < n[i:i + 128, None], feature[word], FEATURES)].sum(1)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        cosine = x @ latent.T
        a, j = np.nonzero(cosine >= COSINE)
        item = index[j]
        lo = np.maximum(starts[at[a]] - size[item], first[text[at[a]]])
        hi = np.minimum(starts[at[a]] + width + size[item], first[text[at[a]] + 1])
        ok = np.searchsorted(own, item * base + hi) - np.searchsorted(own, item * base + lo) >= items.need[item]
        for a, j in zip(a[ok], j[ok], strict=True):  # noqa: PLW2901,B020
            t, item = int(text[at[a]]), int(index[j])
            body = h[first[t]:first[t + 1]]
            lo = int(starts[at[a]] - first[t])
            done = found.setdefault((t, item), [])
            match = items.verify(item, body, lo, lo + width)
            if match and not any(match[0] < d[1] and d[0] < match[1] for d in done):
                done.append((*match, float(cosine[a, j])))
    return phrases + [(t, item, *d) for (t, item), spans in found.items() for d in spans]


def _search(code: np.ndarray, items: Items, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, _, h, first in _chunks(batches):
            rows = find(h, first, code, items)
            key = batch.column("key").take(pa.array([lo + r[0] for r in rows], pa.int64()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.record_batch([key, pa.array([items.ids[i] for i in cols[1]], item_type), pa.array(cols[2], pa.int64()),
                                   pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.float64()),
                                   pa.array(cols[5], pa.float64())],
                                  names=["key", "item_id", "start_word", "end_word", "lcs", "cosine"])
    return run


def _flag(code: np.ndarray, items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, hi, h, first in _chunks(batches):
            clean = np.ones(hi - lo, bool)
            clean[[r[0] for r in find(h, first, code, items)]] = False
            yield batch.slice(lo, hi - lo).filter(pa.array(clean))
    return run


class Retrieval:
    """Fitted latent space of a corpus, and the benchmark in blocks."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                 item_text: str = "text"):
        texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
        self.text = text
        self.idf = idf_weights(texts)
        self.code = term_vectors(texts, self.idf)
        answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
        self.items = stored(benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"),
                                             answer.alias("answer")).filter("text is not null"), "items")
        self.blocks = -(-self.items.count() // BLOCK_ITEMS)
        self.item_type = dict(self.items.dtypes)["item_id"]

    def _block(self, k: int) -> Items:
        mine = self.items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(self.blocks)) == k)
        return Items(sorted(map(tuple, mine.collect()), key=str), self.code, self.idf)

    def matches(self, docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
        """(doc_id, item_id, start_word, end_word, lcs, cosine) of every contaminated passage."""
        narrow = docs.select(F.col(doc_id).alias("key"), F.coalesce(F.col(self.text), F.lit("")).alias("text"))
        schema = (f"key {dict(narrow.dtypes)['key']}, item_id {self.item_type}, start_word long, end_word long, "
                  "lcs double, cosine double")
        out = narrow.sparkSession.createDataFrame([], schema)
        kind = pa.int64() if self.item_type == "bigint" else pa.int32() if self.item_type == "int" else pa.string()
        for k in range(self.blocks):
            found = narrow.mapInArrow(_search(self.code, self._block(k), kind), schema)
            out = found if k == 0 else out.unionByName(found)
        return out.withColumnRenamed("key", "doc_id")

    def clean(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs`` without any match, with all their columns."""
        body = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("body")
        out = docs.select(body, F.coalesce(F.col(self.text), F.lit("")).alias("text"))
        schema = out.schema
        for k in range(self.blocks):
            out = out.mapInArrow(_flag(self.code, self._block(k)), schema)
        return out.select("body.*")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return Retrieval(docs, benchmark).matches(docs)
