"""Exact deduplication by two-pass Bloom filtering (DataFrame / SQL functions only).

Pass 1 reads the texts once into a narrow table of fingerprints (SHA-256 of the
text without white space, length). Every fingerprint sets ``K`` positions of a
blocked Bloom array that counts to two; the counting is a hash aggregate over
(block, position) pairs with map-side partials, so a group of copies arrives as
one row per task. Positions hit at least twice form a second, much smaller
Bloom filter of *possibly repeated* fingerprints.

Pass 2 tests each row against that filter with a broadcast lookup. Only rows
that may be repeated are shuffled (as fingerprints, never as texts); all others
pass straight through as kept. False positives only shuffle needlessly; the
SHA-256 decides.

The broadcast filter has ``bits_per_row`` bits per row, at most ``max_bits``
(32 MB at the default). Beyond that it lets more rows through to the shuffle,
which stays right and skew-safe.

Defined cases: a null text counts as empty, all empty texts are one group; of
rows equal in text, length and doc_id (repeated rows) exactly one is kept; a
null doc_id loses every tie. Other columns never matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemicycle.llm import bloom
from hemicycle.llm.common import row_keys, stored
from hemicycle.plans.ranking import checkpointed

WHITE_SPACE = r"[\x20\x09-\x0D]+"


def fingerprints(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(row, doc_id, n, sha, rk1, rk2): one narrow row per input row."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"),
                     F.length(t).cast("long").alias("n"),
                     _text_key(t).alias("sha"), *row_keys(doc_id, text))


def _text_key(text: Column) -> Column:
    return F.unhex(F.sha2(F.regexp_replace(text, WHITE_SPACE, "").cast("binary"), 256))


class Decisions:
    """The stored first pass over one table: fingerprints, repeat filter and decided groups."""

    def __init__(self, df: DataFrame, text: str = "text", doc_id: str = "doc_id",
                 bits_per_row: int = bloom.BITS_PER_KEY, max_bits: int = bloom.MAX_BITS):
        fp = stored(fingerprints(df, text, doc_id), "fingerprints")
        self.blocks = bloom.blocks_for(fp.count(), bits_per_row, max_bits)
        self.filter = checkpointed(bloom.build(fp, F.col("sha"), self.blocks, least=2))
        self.marked = bloom.test(fp, F.col("sha"), self.filter, self.blocks)
        self.again = self.marked.filter("maybe").select("row", "doc_id", "n", "sha", "rk1", "rk2")
        best = F.min(F.struct((-F.col("n")).alias("a"), F.col("doc_id").isNull().alias("b"), "doc_id", "row"))
        # written before the join, so that a hot group meets it in a join whose large side can be split
        self.groups = checkpointed(self.again.groupBy("sha").agg(F.count(F.lit(1)).alias("group_size"),
                                                                 best.alias("best"))
                                   .select("sha", "group_size", F.col("best.doc_id").alias("keep_id"),
                                           F.col("best.row").alias("keep_row")))

    def rows(self) -> DataFrame:
        """(row, doc_id, keep_id, group_size, kept, sha) for every input row."""
        once = (self.marked.filter(~F.col("maybe"))
                .select("row", "doc_id", F.col("doc_id").alias("keep_id"),
                        F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha"))
        joined = (self.again.join(self.groups, "sha", "left")
                  .select("row", "doc_id", "keep_id", "group_size",
                          (F.col("row") == F.col("keep_row")).alias("kept"), "sha"))
        return once.unionByName(joined)


def decide(df: DataFrame, text: str = "text", doc_id: str = "doc_id", **limits: int) -> DataFrame:
    """(row, doc_id, keep_id, group_size, kept, sha): the decision for every input row.

    Of equal texts the longest original stays, then the smallest doc_id.
    """
    return Decisions(df, text, doc_id, **limits).rows()


def deduplicate(df: DataFrame, text: str = "text", doc_id: str = "doc_id", **limits: int) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.

    Rows whose fingerprint cannot be repeated pass straight through the second scan
    with their text; only possibly repeated rows are joined with the keys of the kept ones.
    """
    done = Decisions(df, text, doc_id, **limits)
    body = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("body")
    rows = df.select(body, _text_key(F.coalesce(F.col(text), F.lit(""))).alias("sha"), *row_keys(doc_id, text))
    marked = bloom.test(rows, F.col("sha"), done.filter, done.blocks)
    once = marked.filter(~F.col("maybe")).select("body")
    keep = checkpointed(done.again.join(done.groups.select(F.col("keep_row").alias("row")), "row").select("rk1", "rk2"))
    again = (marked.filter("maybe").join(keep, ["rk1", "rk2"], "left_semi")
             .dropDuplicates(["rk1", "rk2"]).select("body"))  # rows equal in id and text share their keys
    return once.unionByName(again).select("body.*")


def report(df: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return decide(df).select("doc_id", "keep_id", "group_size", "kept",
                             F.lower(F.hex("sha")).alias("text_sha256"))


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER g = 1 AS kept, text_sha256
FROM t
WINDOW g AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
