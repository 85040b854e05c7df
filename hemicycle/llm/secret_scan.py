"""Secret scan: base patterns, plus character Markov models compared by log-likelihood ratio.

Two families of first-order Markov models over the 66 characters of tokens
(``[A-Za-z0-9+/_=-]``) and a boundary symbol:

* *ordinary identifiers*: transitions of all tokens of the whole corpus outside
  the base spans (label 0), extended by the joints of identifiers (words joined
  by ``_ - /``, camel case, upper case, trailing digits);
* *random strings*, one model per alphabet (hex, base32, base62, base64): the
  values of base spans found in the corpus (label 1) and seeded random samples,
  mixed in fixed shares (``CORPUS_SHARE``), so that a table twice as long gives the same model.

A token of ``MIN_LENGTH`` characters or more, holding a letter and a digit and
touching no base span, is reported as kind ``markov`` when the ratio of the
mixture of random models to the ordinary model reaches ``MIN_RATIO`` nats and
``MIN_RATE`` nats per character. Base spans always stay.

Training counts all rows, each within its own text: every task sends at most 67 x 67 x 5 transition
counts, summed by Spark; the model (bounded by the alphabet) goes into the
scan. Only texts that can hold a span are decoded; the others are ruled out on
their bytes. Null and empty texts have no span; any table may be empty; extra
columns are not read; repeated rows are scanned each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hemicycle.llm.common import byte_view, text_batches

KINDS = ("assign", "access", "hex", "markov")
#: fixed values of the base patterns
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24

MIN_LENGTH = 20
MIN_RATIO = 12.0
MIN_RATE = 0.6
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_LENGTH)
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET) + 1
RANDOM = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
          "base62": ALPHABET[:62], "base64": ALPHABET}
RANDOM_SAMPLES = 2000
RANDOM_LENGTH = 32
#: weight of the corpus's own secrets in the random models, whatever their number
CORPUS_SHARE = 0.5

_SYMBOL = np.zeros(256, np.int64)
for _i, _c in enumerate(ALPHABET):
    _SYMBOL[ord(_c)] = _i + 1
_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in "0123456789abcdef"]] = True


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, secret part) of the base patterns, in report order."""
    out = [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= MIN_VALUE]
    out += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    return sorted(out)


def _long_runs(mask: np.ndarray, off: np.ndarray, least: int) -> np.ndarray:
    """Rows holding a run of ``least`` marked bytes."""
    if len(mask) < least:
        return np.zeros(0, np.int64)
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return np.unique(np.searchsorted(off, start[end - start >= least], side="right") - 1)


def _rows_with(data: bytes, off: np.ndarray, needles: tuple[bytes, ...]) -> np.ndarray:
    found = []
    for needle in needles:
        at = data.find(needle)
        while at >= 0:
            row = int(np.searchsorted(off, at, side="right")) - 1
            found.append(row)
            at = data.find(needle, int(off[row + 1]))  # one hit a row is enough
    return np.unique(np.array(found, np.int64))


def suspects(data: np.ndarray, off: np.ndarray, tokens: bool) -> np.ndarray:
    """Rows that may hold a base span (or, with ``tokens``, a token long enough to be scored)."""
    raw = data.tobytes()
    rows = [_rows_with(raw.lower(), off, ASSIGN_WORDS), _rows_with(raw, off, (b"AKIA",)),
            _long_runs(_HEX[data], off, MIN_HEX)]
    if tokens:
        rows.append(_long_runs(_SYMBOL[data] > 0, off, MIN_LENGTH))
    return np.unique(np.concatenate(rows))


def _transitions(s: str) -> np.ndarray:
    sym = _SYMBOL[np.frombuffer(s.encode("ascii", "replace"), np.uint8)]
    return np.concatenate([[0], sym]) * SIZE + np.concatenate([sym, [0]])


def _alphabet_of(value: str) -> int:
    chars = set(value)
    return next((i for i, a in enumerate(RANDOM.values()) if chars <= set(a)), len(RANDOM) - 1)


def text_transitions(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Transition counts of the texts ``data[off[i]:off[i+1]]``, none of them across two texts."""
    sym = _SYMBOL[data]
    if not len(sym):
        return np.zeros(SIZE * SIZE, np.int64)
    inner = np.ones(len(sym) - 1, bool)
    cut = off[1:-1]
    inner[cut[(cut > 0) & (cut < len(sym))] - 1] = False
    filled = off[1:] > off[:-1]
    first, last = sym[off[:-1][filled]], sym[off[1:][filled] - 1]
    at = np.concatenate([(sym[:-1] * SIZE + sym[1:])[inner], first, last * SIZE])  # a text begins and ends at the boundary
    return np.bincount(at, minlength=SIZE * SIZE)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transition counts of one partition: label 0 ordinary, 1.. random by alphabet."""
    total = np.zeros((1 + len(RANDOM), SIZE * SIZE), np.int64)
    for batch in batches:
        for lo, hi in text_batches(batch, "text"):
            data, off = byte_view(batch.column("text"), lo, hi)
            total[0] += text_transitions(data, off)
            for row in suspects(data, off, tokens=False):
                text = data[off[row]:off[row + 1]].tobytes().decode("utf-8", "replace")
                for _, kind, _, value in base_spans(text):
                    at = _transitions(value)
                    if kind == 0:
                        np.add.at(total[0], at, -1)
                    if kind != 0 or any(c.isdigit() for c in value):
                        np.add.at(total[1 + _alphabet_of(value)], at, 1)
    label, at = np.nonzero(total)
    yield pa.record_batch([pa.array(label, pa.int32()), pa.array(at, pa.int32()), pa.array(total[label, at])],
                          names=["label", "at", "n"])


def _ordinary(c: np.ndarray) -> np.ndarray:
    """Counts of ordinary identifiers: corpus tokens and the joints by which identifiers are built."""
    c = np.maximum(c.reshape(SIZE, SIZE), 0).astype(float)
    out = c.copy()
    lower, upper, digits = np.arange(1, 27), np.arange(27, 53), np.arange(53, 63)
    end, start = c[:, 0].copy(), c[0].copy()
    end[0] = start[0] = 0
    for joint in (ALPHABET.index(x) + 1 for x in "_-/="):
        out[:, joint] += 0.05 * end
        out[joint] += 0.05 * start
    share = start[lower] / max(start[lower].sum(), 1)
    out[np.ix_(lower, upper)] += 0.05 * end[lower][:, None] * share[None]       # camelCase
    out[np.ix_(upper, upper)] += 0.05 * c[np.ix_(lower, lower)]                 # CONSTANT
    out[np.ix_(upper, lower)] += 0.02 * c[np.ix_(lower, lower)]
    out[:, digits] += 0.002 * end[:, None]                                       # name1
    out[np.ix_(digits, digits)] += 0.002 * end.sum() / 10
    return out


def _log(counts: np.ndarray, floor: float) -> np.ndarray:
    c = counts.reshape(SIZE, SIZE) + floor
    return np.log(c / c.sum(1, keepdims=True))


def _random_samples() -> list[str]:
    """Seeded labelled samples of random strings, the same on every run."""
    rng = np.random.Generator(np.random.PCG64(1))
    return ["".join(rng.choice(list(a), RANDOM_LENGTH)) for a in RANDOM.values() for _ in range(RANDOM_SAMPLES)]


def train(df: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(ordinary, random) log transition tables; ``random`` has one table per alphabet."""
    rows = (df.selectExpr(f"coalesce(`{text}`, '') as text")
            .mapInArrow(_count, "label int, at int, n long").groupBy("label", "at").sum("n").collect())
    counts = np.zeros((1 + len(RANDOM), SIZE * SIZE))
    for label, at, n in rows:  # at most 67 x 67 x 5 sums
        counts[label, at] = n
    samples = _random_samples()
    for i in range(len(RANDOM)):
        at = np.concatenate([_transitions(s) for s in samples[i * RANDOM_SAMPLES:(i + 1) * RANDOM_SAMPLES]])
        seeded = np.bincount(at, minlength=SIZE * SIZE)
        found = counts[1 + i].sum()
        counts[1 + i] = seeded if not found else (
            (1 - CORPUS_SHARE) * seeded + CORPUS_SHARE * seeded.sum() / found * counts[1 + i])
    ordinary = _ordinary(counts[0])
    return _log(ordinary, 1e-5 * max(ordinary.sum() / SIZE, 1.0) + 0.01), np.stack([_log(c, 0.05) for c in counts[1:]])


def ratio(token: str, model: tuple[np.ndarray, np.ndarray]) -> float:
    """Log-likelihood ratio of the random mixture to the ordinary model, in nats."""
    at = _transitions(token)
    rand = model[1].reshape(len(RANDOM), -1)[:, at].sum(1) - np.log(len(RANDOM))
    return float(np.logaddexp.reduce(rand) - model[0].reshape(-1)[at].sum())


def find(text: str, model: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int, int, str]]:
    """All spans of one text: (start, kind, end, value), base spans and ``markov`` additions."""
    base = base_spans(text)
    out = list(base)
    for m in TOKEN.finditer(text):
        s = m.group()
        if (any(b[0] < m.end() and m.start() < b[2] for b in base) or not any(c.isdigit() for c in s)
                or not any(c.isalpha() for c in s)):
            continue
        r = ratio(s, model)
        if r >= MIN_RATIO and r >= MIN_RATE * len(s):
            out.append((m.start(), 3, m.end(), s))
    return sorted(out)


def _scan(model: tuple[np.ndarray, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(len(batch))]
            for lo, hi in text_batches(batch, "text"):
                data, off = byte_view(batch.column("text"), lo, hi)
                for row in suspects(data, off, tokens=True):
                    text = data[off[row]:off[row + 1]].tobytes().decode("utf-8", "replace")
                    rows[lo + row] = [{"kind": KINDS[k], "start": s, "end": e, "value": v}
                                      for s, k, e, v in find(text, model)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(rows, SPANS)], names=["doc_id", "spans"])
    return run


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                            ("value", pa.string())]))


def scan(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, value>>) for every row; positions in code points."""
    model = train(df, text)
    kind = dict(df.dtypes)[doc_id]
    return (df.selectExpr(f"`{doc_id}` as doc_id", f"coalesce(`{text}`, '') as text")
            .mapInArrow(_scan(model), f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long,value:string>>"))


def report(df: DataFrame) -> DataFrame:
    """Digest per document: counts of the base kinds, hash of the base spans, all spans as text."""
    found = scan(df)
    n = "cast(size(filter(spans, s -> s.kind = '{0}')) as bigint) as n_{0}"
    line = "concat_ws(',', transform({}, s -> concat_ws(':', s.kind, s.start, s.end)))"
    return found.selectExpr("doc_id", *[n.format(k) for k in KINDS[:3]],
                            "sha2(" + line.format("filter(spans, s -> s.kind != 'markov')") + ", 256) as base_sha256",
                            line.format("spans") + " as spans")


def digest(spans: list[tuple[int, int, int, str]]) -> str:
    """The span text of a brute-force scan, for tests."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


def base_digest(text: str) -> str:
    return hashlib.sha256(digest(base_spans(text)).encode()).hexdigest()
