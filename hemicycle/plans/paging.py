"""API helpers of the reference's query surface: paging (O9), field lists (P21),
JSON result lines (K4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page(df: DataFrame, order: list[Column | str], offset: int = 0, limit: int = 10) -> DataFrame:
    """One page of a total order (``offset`` / ``limit``, or start / max-results).

    ``order`` must end with a unique key so pages neither overlap nor skip.
    Planned as a top-(offset+limit) TakeOrderedAndProject, not a full sort.
    """
    return df.orderBy(*order).offset(offset).limit(limit)


def project_fields(df: DataFrame, fields: str | None) -> DataFrame:
    """``fields=id,title`` -> those columns in that order; unknown names are an error."""
    if not fields:
        return df
    names = [f.strip() for f in fields.split(",") if f.strip()]
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"unknown fields: {missing}")
    return df.select(*names)


def json_lines(df: DataFrame) -> DataFrame:
    """K4: one JSON document per row (``value`` column), ready for ``write.text``."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def apply_pipeline(df: DataFrame, steps) -> DataFrame:
    """Ordered item pipelines as chained ``DataFrame.transform`` calls."""
    for step in steps:
        df = df.transform(step)
    return df
