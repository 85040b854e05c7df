"""Near-duplicate documents by min-max hashing.

A document is its set of distinct word shingles. Each of ``HASHES``
permutations gives two signature values, the smallest and the largest image of
the set: both agree between two documents with probability equal to the
Jaccard similarity, so half the hash evaluations serve a signature of a given
length. ``ROWS`` consecutive values form a band; documents equal in one band are candidates. At
similarity 0.8 a pair is missed with probability (1 - 0.8^5)^32 = 3e-6.

Links are confirmed on the full shingle sets, without all pairs of a group:

1. documents with the same set become one class (a hash aggregate); only its
   first document goes on;
2. every class is compared with the leader of its buckets, first with its
   smallest leader only; confirmed links are contracted to components;
3. the other leaders are compared where the components still differ; then, twice, the members outside a bucket's
   largest component with one further member of it;
4. what remains are pairs of one bucket in different components that no leader has joined. A member outside a
   bucket's largest component that is near one of its members is compared with the whole component, in blocks inside a task;
   members outside are compared with each other. Nothing is capped.

Pairs are only formed where the sizes allow the similarity and 128 one-bit
signature values differ in at most 28 places. At the least similarity 12.8 differ, with a deviation of
3.4: a linked pair is refused with probability 4e-6 at most, and chance companions of a bucket are
refused inside the join.

Defined cases: a null text has no words; a document without words has an empty
set and links with nothing; one with fewer words than the width has its whole
word sequence as only shingle; repeated rows fall into one class; a null
doc_id never names a component that has another id; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemicycle.llm.common import U64, byte_view, keep_rows, mix, row_keys, rows_named, scratch, seeded, shingles, stored, text_batches, word_hashes, words
from hemicycle.llm.components import components
from hemicycle.plans.ranking import checkpointed

HASHES, ROWS = 80, 5
BANDS = 2 * HASHES // ROWS
PERCENT = 80
#: one bit of each of 128 signature values: at similarity 0.8 a pair differs in 12.8 of them, deviation 3.4
BITS = 128
MAX_DIFFERENT = 28
#: sets compared at once in a task
BLOCK = 48
_STEP = 2048


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every row."""
    for lo, hi in text_batches(batch, "text"):
        data, off = byte_view(batch.column("text"), lo, hi)
        start, end, first = words(data, off)
        h, bounds = shingles(word_hashes(data, start, end), first, width)
        for i in range(hi - lo):
            yield np.unique(h[bounds[i]:bounds[i + 1]])


def signature(s: np.ndarray, xor: np.ndarray, mul: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under each permutation (interleaved), in bounded blocks."""
    low = np.full(len(mul), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(mul), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), _STEP):
            image = (s[i:i + _STEP, None] ^ xor) * mul
            np.minimum(low, image.min(0), out=low)
            np.maximum(high, image.max(0), out=high)
    return np.stack([low, high], 1).reshape(-1)


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xor, mul = seeded(HASHES, 101), seeded(HASHES, 102) | U64(1)
        weight, salt = seeded(ROWS, 103) | U64(1), seeded(BANDS, 104)
        for batch in batches:
            n, k1, k2, bands, bits = [], [], [], [], []
            with np.errstate(over="ignore"):
                for s in _sets(batch, width):
                    n.append(len(s))
                    k1.append(s.sum(dtype=np.uint64))
                    k2.append(mix(s).sum(dtype=np.uint64))
                    if len(s):
                        sig = mix(signature(s, xor, mul))
                        bands.append(mix((sig.reshape(BANDS, ROWS) * weight).sum(1) + salt).view(np.int64))
                        bits.append(np.packbits((sig[:BITS] & U64(1)).astype(np.uint8)).view(np.int64))
                    else:
                        bands.append(None)
                        bits.append(np.zeros(2, np.int64))
            yield pa.record_batch([
                *[batch.column(c) for c in ("row", "doc_id", "rk1", "rk2")], pa.array(n, pa.int64()),
                pa.array(np.array(k1, np.uint64).view(np.int64)), pa.array(np.array(k2, np.uint64).view(np.int64)),
                pa.array(bands, pa.list_(pa.int64())),
                *[pa.array([b[i] for b in bits], pa.int64()) for i in (0, 1)]],
                names=["row", "doc_id", "rk1", "rk2", "n", "k1", "k2", "bands", "s1", "s2"])
    return run


def _set_bytes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([s.tobytes() for s in _sets(batch, width)], pa.binary())
            yield pa.record_batch([batch.column("node"), sets], names=["node", "words"])
    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


def _confirm_blocks(percent: int):
    """Links between two blocks of sets: one sorted pool of a block, counted once for every set of the other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for row in range(len(batch)):
                xs, ys = ([(e["node"].as_py(), np.frombuffer(e["words"].as_buffer(), np.uint64)) for e in batch.column(c)[row]]
                          for c in ("xs", "ys"))
                names, size = np.array([n for n, _ in ys]), np.array([len(s) for _, s in ys])
                pool = np.concatenate([s for _, s in ys])
                order = np.argsort(pool, kind="stable")
                pool, owner = pool[order], np.repeat(np.arange(len(ys)), size)[order]
                for node, s in xs:
                    lo, hi = np.searchsorted(pool, s, side="left"), np.searchsorted(pool, s, side="right")
                    n = hi - lo
                    at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    both = np.bincount(owner[at], minlength=len(ys))
                    ok = (100 * both >= percent * (len(s) + size - both)) & (names != node)
                    a += [node] * int(ok.sum())
                    b += names[ok].tolist()
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


class NearDuplicates:
    """Classes, links and components of one table."""

    def __init__(self, df: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5,
                 percent: int = PERCENT):
        self.width, self.percent = width, percent
        kind = dict(df.dtypes)[doc_id]
        self.texts = df.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"),
                               F.coalesce(F.col(text), F.lit("")).alias("text"), *row_keys(doc_id, text))
        self.sketch = stored(self.texts.mapInArrow(
            _sketch(width), f"row long, doc_id {kind}, rk1 long, rk2 long, n long, k1 long, k2 long, bands array<long>, s1 long, s2 long"),
            "sketch")
        self.classes = checkpointed(
            self.sketch.filter("n > 0").groupBy("n", "k1", "k2")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "row")).alias("m"),
                 F.count(F.lit(1)).alias("members"))
            .select("n", "k1", "k2", F.col("m.row").alias("node"), F.col("m.doc_id").alias("first_id"), "members"))
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None
        self.sets: DataFrame | None = None
        self._link()

    def _near(self, a: str, b: str) -> str:
        """Condition on the columns n, s1, s2 with the suffixes ``a`` and ``b``."""
        return (f"{self.percent} * greatest(n{a}, n{b}) <= 100 * least(n{a}, n{b}) and "
                f"bit_count(s1{a} ^ s1{b}) + bit_count(s2{a} ^ s2{b}) <= {MAX_DIFFERENT}")

    def _link(self) -> None:
        nodes = stored(self.sketch.select(F.col("row").alias("node"), "n", "s1", "s2", "bands")
                       .join(self.classes.select("node"), "node", "left_semi"), "nodes")
        buckets = nodes.select("node", F.explode("bands").alias("key"))
        shared = checkpointed(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("leader"))
                              .filter("size > 1"))
        facts = [F.col(c).alias(f"{c}b") for c in ("n", "s1", "s2")]
        leaders = checkpointed(shared.drop("size").join(nodes.select(F.col("node").alias("leader"), *facts), "leader"))
        member = stored(buckets.join(shared.select("key"), "key", "left_semi"), "members")
        member = stored(member.join(nodes.drop("bands"), "node"), "members")
        side = member.select("key", F.col("node").alias("a"), *[F.col(c).alias(f"{c}a") for c in ("n", "s1", "s2")])
        pairs = stored(side.join(leaders.withColumnRenamed("leader", "b"), "key")
                       .filter("a <> b").filter(self._near("a", "b")).select("a", "b").distinct(), "pairs")
        first = stored(pairs.groupBy("a").agg(F.min("b").alias("b")), "first")
        self._make_sets(pairs)
        self._add(first)
        self._add(self._apart(pairs.join(first, ["a", "b"], "left_anti")))
        # a bucket of two holds one pair, and its leader has been compared
        member = stored(member.join(shared.filter("size > 2").select("key"), "key", "left_semi"), "crowded")
        for seed in (1, 2):  # these rounds only leave less for the complete last step
            self._add(self._to_main(member, seed))
        self._across(member)

    def _open(self, member: DataFrame) -> DataFrame:
        """Members of buckets that hold several components, with the bucket's largest one (``main``)."""
        named = stored(self._labelled(member, "node"), "labelled")
        parts = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size"))
        open_keys = stored(parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"),
                                                    F.max_by("label", F.struct("size", "label")).alias("main"))
                           .filter("parts > 1").select("key", "main"), "open")
        return stored(named.join(open_keys, "key"), "open")

    def _to_main(self, member: DataFrame, seed: int) -> DataFrame:
        """Near pairs of the members outside a bucket's main component with one member of it, another in every round."""
        inside = self._open(member)
        pick = F.min(F.struct(F.xxhash64("node", F.lit(seed)).alias("h"), "node", "n", "s1", "s2")).alias("m")
        chosen = stored(inside.filter("label = main").groupBy("key").agg(pick)
                        .select("key", *[F.col(f"m.{c}").alias(f"{c}b") for c in ("node", "n", "s1", "s2")]), "chosen")
        outside = inside.filter("label <> main").select("key", *[F.col(c).alias(f"{c}a") for c in ("node", "n", "s1", "s2")])
        return self._ordered(outside.join(chosen, "key").filter(self._near("a", "b")))

    def _across(self, member: DataFrame) -> None:
        """The complete last step over all buckets that still hold several components.

        A member outside the main component that is near some member of it is compared with all nodes of that
        component, in blocks of bounded size inside a task, so no pair is listed; members outside are also compared with each other.
        """
        inside = self._open(member)
        left, right = (inside.select("key", "main", *[F.col(c).alias(f"{c}{x}") for c in ("node", "label", "n", "s1", "s2")])
                       for x in "ab")
        outside, main = left.filter("labela <> main"), right.filter("labelb = main").drop("main")
        near_main = outside.join(main, (outside.key == main.key) & F.expr(self._near("a", "b")), "left_semi")
        asked = stored(near_main.select(F.col("nodea").alias("node"), F.col("main").alias("label")).distinct(), "asked")
        # two members that are both compared with the main component meet each other in its blocks
        flag = asked.select(F.col("node").alias("nodea"), F.col("label").alias("main"), F.lit(True).alias("seena"))
        outside = stored(outside.join(flag, ["nodea", "main"], "left").withColumn("seena", F.coalesce("seena", F.lit(False))), "outside")
        other = outside.drop("main").toDF(*[c[:-1] + "b" if c != "key" else c for c in outside.columns if c != "main"])
        apart = (outside.drop("main").join(other, "key").filter("labela <> labelb and nodea > nodeb and not (seena and seenb)")
                 .filter(self._near("a", "b")))
        apart = stored(self._ordered(apart), "apart")
        if not asked.isEmpty():
            wanted = asked.select("label").distinct()
            known = (self.labels if self.labels is not None else asked.select("node", F.col("node").alias("label")).limit(0))
            alone = wanted.join(known.select("label").distinct(), "label", "left_anti").select(F.col("label").alias("node"), "label")
            nodes = stored(known.join(wanted, "label", "left_semi").select("node", "label").unionByName(alone)
                           .unionByName(asked), "nodes")
            self._make_sets(asked.select(F.col("node").alias("a"), F.col("node").alias("b"))
                            .unionByName(nodes.select(F.col("node").alias("a"), F.col("node").alias("b"))))
            found = (self._in_blocks(asked, "xs").join(self._in_blocks(nodes, "ys"), "label").select("xs", "ys")
                     .mapInArrow(_confirm_blocks(self.percent), "a long, b long"))
            self._link_found(stored(found, "links"))
        self._add(self._apart(apart))

    def _in_blocks(self, nodes: DataFrame, out: str) -> DataFrame:
        """(label, ``out``): the nodes of a label with their sets, about ``BLOCK`` in a row."""
        sizes = stored(nodes.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")), "sizes")
        return (nodes.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
                .join(self.sets, "node").groupBy("label", "block")
                .agg(F.collect_list(F.struct("node", "words")).alias(out)).drop("block"))

    @staticmethod
    def _ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.greatest("nodea", "nodeb").alias("a"), F.least("nodea", "nodeb").alias("b")).distinct()

    def _labelled(self, df: DataFrame, node: str, out: str = "label") -> DataFrame:
        if self.labels is None:
            return df.withColumn(out, F.col(node))
        names = self.labels.select(F.col("node").alias(node), F.col("label").alias("_l"))
        return df.join(names, node, "left").withColumn(out, F.coalesce("_l", node)).drop("_l")

    def _apart(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components so far."""
        return self._labelled(self._labelled(pairs, "a", "la"), "b", "lb").filter("la <> lb").select("a", "b")

    def _add(self, pairs: DataFrame) -> bool:
        """Confirm pairs on their full sets; extend the links and the components. Whether a link was found."""
        pairs = stored(pairs, "candidates")
        if pairs.isEmpty():
            return False
        self._make_sets(pairs)
        x, y = (self.sets.select(F.col("node").alias(k), F.col("words").alias(v)) for k, v in ("ax", "by"))
        found = stored(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
                       .mapInArrow(_confirm(self.percent), "a long, b long"), "links")
        return self._link_found(found)

    def _link_found(self, found: DataFrame) -> bool:
        if found.isEmpty():
            return False
        self.links = found if self.links is None else self.links.unionByName(found)
        self.labels = stored(components(self.links), "labels")
        return True

    def _make_sets(self, pairs: DataFrame) -> None:
        """Full shingle sets of the ends of ``pairs`` that have none yet."""
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        if self.sets is not None:
            ends = ends.join(self.sets.select("node"), "node", "left_anti")
        ends = stored(ends.join(self.sketch.select(F.col("row").alias("node"), "rk1", "rk2"), "node"), "ends")
        if ends.isEmpty():
            return
        new = stored(rows_named(self.texts.drop("row"), ends).select("node", "text")
                     .mapInArrow(_set_bytes(self.width), "node long, words binary"), "sets")
        self.sets = new if self.sets is None else self.sets.unionByName(new)

    def rows(self) -> DataFrame:
        """(row, doc_id, n_shingles, component_id, first_row) for every row; ``first_row``: the row that may stay."""
        named = self._labelled(self.classes, "node")
        best = F.min(F.struct(F.col("first_id").isNull().alias("x"), "first_id", "node")).alias("m")
        parts = checkpointed(named.groupBy("label").agg(best)
                             .select("label", F.col("m.first_id").alias("component_id"), F.col("m.node").alias("first_row")))
        of_class = checkpointed(named.join(parts, "label").select("n", "k1", "k2", "component_id", "first_row"))
        linked = self.sketch.filter("n > 0").join(of_class, ["n", "k1", "k2"])
        alone = self.sketch.filter("n = 0").withColumn("component_id", F.col("doc_id")).withColumn("first_row", F.col("row"))
        cols = ["row", "doc_id", F.col("n").alias("n_shingles"), "component_id", "first_row"]
        return linked.select(*cols).unionByName(alone.select(*cols))


def deduplicate(df: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5,
                percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: one of each group of near duplicates."""
    with scratch(df.sparkSession):  # the kept rows need the decisions only
        found = NearDuplicates(df, text, doc_id, width, percent)
        decided = found.rows().select("row", (F.col("row") == F.col("first_row")).alias("kept"))
        return keep_rows(df, decided.join(found.sketch.select("row", "rk1", "rk2"), "row"), doc_id, text)


def report(df: DataFrame, width: int = 2) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    return NearDuplicates(df, width=width).rows().select(
        "doc_id", "n_shingles", "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("row") == F.col("first_row")).alias("kept"))


