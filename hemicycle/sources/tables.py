"""Table sources.

The voting model (SURVEY §1.3) is laid over the driver tables (SURVEY §7.5):

* scrutiny (roll call)  = ``orders``   (uuid = o_orderkey, date = o_orderdate)
* ballot                = ``lineitem`` (l_returnflag A/R/N -> yea/nay/abs,
                                        voter = l_suppkey, order = l_linenumber)
* deputy                = ``supplier`` (group = its nation, jurisdiction = region)
* name directory        = ``part.p_name`` / ``customer.c_name``
* raw pages             = ``pages``; text = ``documents``; change feed = ``events``

Every loader is a lazy ``spark.read.parquet`` + ``select``, so Catalyst prunes
columns and pushes filters into the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# Ballot flag -> vote type of the reference ("yea", "nay", "abs").
VOTE_OF_FLAG = {"A": "yea", "R": "nay", "N": "abs"}
VOTE_TYPES = ("yea", "nay", "abs")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


ROWS_A_TASK = 1_000_000  # rows of a table that one task of a sized shuffle takes


def parts(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Partitions for a shuffle of the rows of a table (counted in its footers), so many that the sorts and hash tables of
    a task stay as large whatever the table's size."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, name).count() // ROWS_A_TASK))


def vote_of_flag(flag: Column) -> Column:
    expr = None
    for k, v in VOTE_OF_FLAG.items():
        expr = F.when(flag == k, v) if expr is None else expr.when(flag == k, v)
    return expr


def ballots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per cast ballot: (scrutiny_uuid, vote, voter_uuid, ord).

    ``(scrutiny_uuid, ord)`` is *not* a key in the driver data, and a voter may
    appear twice in one roll call; tallies count rows, per-document queries
    deduplicate.
    """
    li = table(spark, sf_dir, "lineitem")
    # filter on the raw column so parquet gets an In(...) pushdown
    return (li.where(F.col("l_returnflag").isin(*VOTE_OF_FLAG))
              .select(F.col("l_orderkey").alias("scrutiny_uuid"),
                      vote_of_flag(F.col("l_returnflag")).alias("vote"),
                      F.col("l_suppkey").alias("voter_uuid"),
                      F.col("l_linenumber").alias("ord")))


def scrutinies(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("scrutiny_uuid"),
                    F.col("o_orderdate").alias("date"),
                    F.col("o_orderpriority").alias("title"))


def deputies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deputies with their group (nation name) and jurisdiction (region name).

    nation (25 rows) and region (5 rows) are fixed-size dimensions, so the
    joins below are broadcast by the planner's size check, never by data size.
    """
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return (s.join(n, s.s_nationkey == n.n_nationkey, "left")
             .join(r, n.n_regionkey == r.r_regionkey, "left")
             .select(F.col("s_suppkey").alias("uuid"),
                     F.col("s_name").alias("name"),
                     F.col("n_name").alias("party"),
                     F.col("r_name").alias("jurisdiction")))


def name_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searchable people directory: (uuid, name) from ``part.p_name``."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("uuid"), F.col("p_name").alias("name"))
