"""Skew-safe ranking.

``row_number().over(Window.orderBy(...))`` without a partition runs in one
task, and ``Window.partitionBy(g)`` sorts a whole hot group in one task. The
helpers below rank over a total order with a range-partitioned sort instead:

1. ``orderBy`` range-partitions and sorts the rows (balanced by sampling, so a
   hot group is split over many tasks);
2. the sorted frame is checkpointed into the shared checkpoint folder with each
   row's partition and place, fixing both (and cutting lineage, so a lost executor
   only recomputes from the checkpoint);
3. each partition counts its rows; the tiny per-partition table (one row per
   partition, a proven bound) is prefix-summed and broadcast back;
4. rank = partition offset + position inside the partition.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemicycle.session import ensure_checkpoint_dir, scratch_path


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into ``spark.checkpoint.dir`` (never a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read again.

    For loops that join a frame with itself: a checkpoint keeps the size *estimates* of its plan, which such a loop
    squares every round; a table has the size of its files.
    """
    path = scratch_path(df.sparkSession, f"saved-{uuid.uuid4().hex}")
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def _sorted(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """``df`` sorted over ranges and checkpointed, each row with its partition ``_pid`` and place ``_local`` in it.

    Both are part of the checkpoint: later plans (unions, joins) cannot change them.
    """
    at = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    return checkpointed(df.orderBy(*order).select("*", F.spark_partition_id().alias("_pid"), at.alias("_local")))


def _offsets(counts: DataFrame) -> DataFrame:
    """(_pid, _off): the sum of ``_n`` over earlier partitions; one row per partition, a single-task window of proven size."""
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))


def global_rank(df: DataFrame, order: list[Column | str], out: str = "rank") -> DataFrame:
    """1-based rank over ``order``; ``order`` must be a total order (unique keys)."""
    s = _sorted(df, order)
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    return (s.join(_offsets(counts), "_pid")
             .withColumn(out, (F.col("_off") + F.col("_local") + 1).cast("long"))
             .drop("_pid", "_local", "_off"))


def global_prefix(df: DataFrame, order: list[Column | str], value: str, out: str = "prefix") -> DataFrame:
    """Running sum of ``value`` over ``order`` (a total order), the row itself included, without a single-task window.

    Like ``global_rank``: sorted ranges are summed each in its own task, and one
    row per partition carries the sums of the earlier ones.
    """
    return global_prefixes(df, order, {out: value})


def global_prefixes(df: DataFrame, order: list[Column | str], sums: dict[str, str]) -> DataFrame:
    """Several running sums ``{out: value}`` over one sort."""
    s = _sorted(df, order)
    within = Window.partitionBy("_pid").orderBy("_local").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = s.groupBy("_pid").agg(*[F.sum(v).alias(f"_n_{out}") for out, v in sums.items()])
    offsets = parts.select("_pid", *[F.coalesce(F.sum(f"_n_{out}").over(before), F.lit(0)).alias(f"_off_{out}") for out in sums])
    s = s.withColumns({f"_in_{out}": F.sum(v).over(within) for out, v in sums.items()})
    s = s.join(F.broadcast(offsets), "_pid").withColumns({out: F.col(f"_in_{out}") + F.col(f"_off_{out}") for out in sums})
    return s.drop("_pid", "_local", *[f"{x}_{out}" for out in sums for x in ("_in", "_off")])


def rank_in_groups(df: DataFrame, groups: list[str], order: list[Column | str],
                   out: str = "rn") -> DataFrame:
    """1-based ``row_number`` within ``groups`` over ``order`` without a per-group sort task.

    Equal to ``row_number().over(Window.partitionBy(groups).orderBy(order))``
    when ``groups + order`` is a total order. A group's first rank is found from one row
    per (partition, group) and joined back on both, so a hot group stays spread over its partitions.
    """
    s = _sorted(df, [*groups, *order])
    # one row per partition of a group: where it starts there, and how many rows it has in earlier partitions
    firsts = s.groupBy("_pid", *groups).agg(F.min("_local").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    keys = [F.col("_pid") == F.col("_q"), *[F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in groups]]
    firsts = firsts.select(F.col("_pid").alias("_q"), "_first", "_before", *[F.col(c).alias(f"_k_{c}") for c in groups])
    return (s.join(firsts, keys)
             .withColumn(out, (F.col("_local") - F.col("_first") + F.col("_before") + 1).cast("long"))
             .drop("_pid", "_local", "_first", "_before", "_q", *[f"_k_{c}" for c in groups]))
