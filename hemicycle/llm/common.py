"""Shared helpers: stored tables, Arrow text buffers, vectorised word hashing, split of folds.

The word helpers work on the UTF-8 bytes of a whole Arrow batch at once (numpy),
so no Python object is made per word. White space is the six ASCII characters
``[\\x20\\x09-\\x0D]``; their bytes never occur inside a longer UTF-8 sequence.
"""

from __future__ import annotations

import ctypes
import sys
import time
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hemicycle.llm import bloom
from hemicycle.session import scratch_path

U64 = np.uint64
#: bytes of text handled at once inside a task: bounds the memory of the numpy passes
CHUNK_BYTES = 1 << 20


_scopes: list[list[str]] = []


def stored(df: DataFrame, name: str = "table", keep: bool = False, scope: int = -1, **options) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder (``options`` of the writer) and read it back.

    Cuts the lineage (a lost executor re-reads the table) and pins the result
    of passes that must not run twice. Within ``scratch`` the table goes when the
    scope ends, unless it is to ``keep``; -2 is the ``scope`` around the innermost.
    """
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    if _scopes and not keep:
        _scopes[scope].append(path)
    schema = df.schema
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at the end; only what is kept may be read after it."""
    _scopes.append([])
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _scopes.pop():
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def row_keys(doc_id: str, text: str) -> list[Column]:
    """Two 64-bit hashes of (id, text), ``rk1`` and ``rk2``: name a row alike in every scan.

    Row numbers of a scan would not do: how files are split may change when executors are lost.
    Rows equal in id and text share their keys.
    """
    d, t = F.col(f"`{doc_id}`"), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return [F.xxhash64(d, t).alias("rk1"), F.xxhash64(t, d.isNull(), d).alias("rk2")]


def keep_rows(df: DataFrame, decided: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows of ``df`` by ``decided`` (rk1, rk2, kept: one row per decided row); of rows equal in id and text one stays."""
    by_key = stored(decided.groupBy("rk1", "rk2").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("times"))
                    .filter("not kept or times > 1"), "keys", keep=True)
    body = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("body")
    rows = df.select(body, *row_keys(doc_id, text))
    out = rows.join(by_key.select("rk1", "rk2"), ["rk1", "rk2"], "left_anti").select("body")
    repeated = by_key.filter("kept").select("rk1", "rk2")
    if not repeated.isEmpty():
        out = out.unionByName(rows.join(repeated, ["rk1", "rk2"], "left_semi").dropDuplicates(["rk1", "rk2"]).select("body"))
    return out.select("body.*")


def rows_named(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` joined with the table ``wanted`` on (rk1, rk2).

    A Bloom filter of the wanted keys, broadcast in a bounded size, holds back nearly all other rows before the shuffle.
    """
    blocks = bloom.blocks_for(wanted.count())
    filt = stored(bloom.build(wanted, F.col("rk1"), blocks), "filter")
    return bloom.test(df, F.col("rk1"), filt, blocks, "_maybe").filter("_maybe").drop("_maybe").join(
        wanted.hint("merge"), ["rk1", "rk2"])


def fold_of(doc_id: Column | str, mod: int) -> Column:
    """``crc32(doc_id as text) mod n``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % mod


#: seconds without use after which a worker drops what it keeps between tasks
IDLE_SECONDS = 10.0


def _kept() -> dict[str, list]:
    """name -> [last use, key, value]: beside the imported modules, as it outlives a task."""
    state = sys.modules.setdefault("_hemicycle_worker", types.ModuleType("_hemicycle_worker"))
    return state.__dict__.setdefault("kept", {})


def kept(name: str, key: object, make: Callable[[], object]) -> object:
    """The value kept in this worker under ``name``, made anew for another ``key`` or after ``IDLE_SECONDS`` without use."""
    found = _kept().get(name)
    if found is None or found[1] != key:
        found = _kept()[name] = [0.0, key, make()]
    found[0] = time.monotonic()
    return found[2]


def release() -> None:
    """Give memory of this Python worker back to the machine (workers outlive their tasks and share an executor):
    what was kept for tasks of another kind and has not been used lately, and what is free already."""
    state, now = _kept(), time.monotonic()
    for name in [n for n, entry in state.items() if now - entry[0] > IDLE_SECONDS]:
        del state[name]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def text_batches(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of ``batch`` holding about ``limit`` bytes of text each (one long text stands alone)."""
    arr = batch.column(column)
    if len(arr) == 0:
        return
    off = offsets_of(arr)
    lo = 0
    while lo < len(arr):
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), len(arr))
        yield lo, hi
        lo = hi
    release()


def offsets_of(arr: pa.Array) -> np.ndarray:
    """Byte offsets of a string / binary array (length + 1), as int64."""
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    return np.frombuffer(arr.buffers()[1], dtype=kind)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)


def byte_view(arr: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets relative to them) of rows ``lo:hi``; null rows hold no bytes."""
    off = offsets_of(arr)[lo:hi + 1]
    data = arr.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 64, size=n, dtype=np.uint64)


_BASE = U64(0x9E3779B97F4A7C15)
_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = seeded(256, 11)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_powers: list[np.ndarray] = []
#: bytes hashed at once: the power tables keep this length, however long a text is
HASH_BYTES = 1 << 16


def _pow_tables() -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        up = np.full(HASH_BYTES + 1, _BASE, np.uint64)
        down = np.full(HASH_BYTES + 1, _INV, np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def words(data: np.ndarray, off: np.ndarray,
          inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) of the words of the texts ``data[off[i]:off[i+1]]``.

    ``first[i]:first[i+1]`` are the words of text i. Words are runs of bytes
    marked in ``inside`` (without it: other than white space) within one text.
    """
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    if inside is None:
        inside = ~_SPACE[data]
    prev = np.empty(n, bool)
    prev[0] = False
    prev[1:] = inside[:-1]
    edge = off[:-1][off[:-1] < n]
    prev[edge] = False
    start = np.flatnonzero(inside & ~prev)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    cut = off[1:][off[1:] > 0]
    after[cut - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each byte range: a polynomial over random byte codes, mixed (A-Z folded if ``lower``).

    The ranges follow one another. They are hashed in blocks of ``HASH_BYTES``, a longer range piece by piece.
    """
    code = _LOWER if lower else _BYTE
    up, down = _pow_tables()
    h = np.zeros(len(start), np.uint64)
    total = np.zeros(HASH_BYTES + 1, np.uint64)
    a = 0
    with np.errstate(over="ignore"):
        while a < len(start):
            lo = int(start[a])
            b = max(int(np.searchsorted(end, lo + HASH_BYTES, side="right")), a + 1)
            hi = int(end[b - 1])
            if hi - lo <= HASH_BYTES:
                np.cumsum(code[data[lo:hi]] * up[:hi - lo], out=total[1:hi - lo + 1])
                h[a:b] = (total[end[a:b] - lo] - total[start[a:b] - lo]) * down[start[a:b] - lo]
            else:
                scale = up[:1].copy()
                for i in range(lo, hi, HASH_BYTES):
                    part = code[data[i:min(i + HASH_BYTES, hi)]]
                    h[a:b] += (part * up[:len(part)]).sum(dtype=np.uint64) * scale
                    scale *= up[HASH_BYTES]
            a = b
        return mix(h + (end - start).astype(np.uint64))


def shingles(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles and their text boundaries.

    A text with fewer words than ``width`` (but at least one) has its whole
    word sequence as its only shingle.
    """
    keys = seeded(width, 17 + width)
    counts = np.diff(first)
    n = len(h)
    with np.errstate(over="ignore"):
        full = np.zeros(max(n - width + 1, 0), np.uint64)
        for j in range(width):
            full += h[j:j + len(full)] * keys[j] if len(full) else full
        full = mix(full)
        out_n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
        bounds = np.concatenate([[0], np.cumsum(out_n)]).astype(np.int64)
        out = np.zeros(int(bounds[-1]), np.uint64)
        if (counts >= width).all():
            idx = np.arange(len(out)) + np.repeat(first[:-1] - bounds[:-1], out_n)
            return full[idx], bounds
        long = np.repeat(counts >= width, out_n)
        idx = (np.arange(len(out)) + np.repeat(first[:-1] - bounds[:-1], out_n))[long]
        out[long] = full[idx]
        for i in np.flatnonzero((counts > 0) & (counts < width)):
            part = h[first[i]:first[i + 1]]
            out[bounds[i]] = mix(np.array([(part * keys[:len(part)]).sum() + U64(len(part))], np.uint64))[0]
    return out, bounds
