"""Corpus preparation: language, exact copies, near copies, benchmark leaks, packing.

Every stage takes what the one before it kept, and returns the columns of
``documents`` (the last one the packed pieces). ``run`` writes each stage's
result as Parquet under the shared checkpoint folder and reads it again, so a
lost executor never reaches back beyond its stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hemicycle.llm import decontaminate, exact_dedup, langid, minmax_dedup, packing
from hemicycle.llm.common import stored
from hemicycle.llm.queries import tokenizer_path
from hemicycle.session import ensure_checkpoint_dir
from hemicycle.sources.tables import table


#: rows of one Arrow batch: whole texts go to the Python workers, so a batch is bounded lower than Spark's default
ARROW_ROWS = 2000


def ready(spark: SparkSession) -> None:
    """Settings that every stage needs when its result is written."""
    ensure_checkpoint_dir(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognised language (null text, no letter, far from all labelled rows).

    Repeated rows are each judged alike; an empty table stays empty.
    """
    ready(spark)
    model = langid.train(docs)
    return langid.accept(docs, model, limit=langid.limits(docs, model))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts: the longest original, then the smallest doc_id; nulls are empty
    texts, a repeated row counts as a copy."""
    ready(spark)
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five-word shingles, similarity 0.8 or more; the smallest
    doc_id stays, and texts without a word are linked with nothing."""
    ready(spark)
    return minmax_dedup.deduplicate(docs, width=5, percent=80)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage; null and empty texts hold none, an empty benchmark drops nothing."""
    ready(spark)
    return decontaminate.Retrieval(docs, table(spark, sf_dir, "benchmark")).clean(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the remaining documents into sequences of at most 2048 tokens; a null text is the end token alone."""
    ready(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", leaks),
          ("packing", packed)]

#: near duplicates, retrieval and tokens are not expressible in SQL; tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
