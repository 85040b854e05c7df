"""Roll calls extracted incrementally from a stream of crawled pages.

A roll call needs three pages (index, vote, info) that may arrive in any order
and in different batches. Two streaming queries carry that:

1. ``pages -> facts``: every page is parsed once; a file sink appends its facts.
2. ``facts -> linked pages``: the links of index rows, each (link, role) once, are
   joined with the pages on their URL by a stream-stream join. Its keyed state
   holds links waiting for their page and pages waiting for a link, so a batch
   touches the keys of its own rows only, whatever has been seen before. The
   batch sink reads ballots and fields from the pages that became linked, and
   appends them to tables named by the batch (a replayed batch rewrites its own).

A link that many index rows share (one dossier of a whole session) is removed
within the page first, then in ``SALTS`` slices, so no state key gathers it.

Which row, vote and info page count is settled on reading, by the greatest
``page_id`` of each URL and the greatest (index page, position) of each roll call:
the order of arrival does not matter, and a re-crawl replaces what was read from
the page before, down to nothing. The result equals the batch extraction
(``operators/extract.py``) over all pages seen so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemicycle.operators import extract as E
from hemicycle.sources.html import FACTS_SCHEMA, page_facts_df
from hemicycle.streaming.upsert import SnapshotTable

SALTS = 16

# State lives in RocksDB with a change log: memory and commits follow the batch, not all pages seen.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """The settings a query takes when it starts; the session's own come back after it."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class RollcallTables:
    """What the stream has written so far, and the roll calls it makes up."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def append(self, name: str, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.base}/{name}/d{batch_id:08d}")

    def _read(self, name: str) -> DataFrame | None:
        """The newest compacted base and the batches after it."""
        t = SnapshotTable(self.spark, f"{self.base}/{name}")
        base, done = t._versions(), t._list("d")
        paths = [f"{t.path}/v{base[-1]:08d}"] if base else []
        paths += [f"{t.path}/d{d:08d}" for d in done if not base or d > base[-1]]
        return self.spark.read.parquet(*paths) if paths else None

    def facts(self) -> DataFrame:
        return self.spark.read.schema(FACTS_SCHEMA).parquet(f"{self.base}/facts")

    def _newest(self, name: str) -> DataFrame | None:
        """Rows of the newest page of each URL: a page is written once, or alike by each batch in which it was linked."""
        df = self._read(name)
        return None if df is None else E.latest_pages(df)

    def index_rows(self) -> DataFrame:
        return E.one_per_uuid(E.index_rows(E.latest_pages(self.facts().select("page_id", "url", "index_rows"))))

    def scrutinies(self, strict: bool = False) -> DataFrame | None:
        votes = self._newest("votes")
        if votes is None:
            return None
        infos = self._newest("infos")
        return E.assemble(self.index_rows(), votes.where("reason is null").drop("reason"), infos, strict)

    def ballots(self, scrutinies: DataFrame | None = None) -> DataFrame | None:
        s = self.scrutinies() if scrutinies is None else scrutinies
        return None if s is None else E.ballots_of(s, self._read("ballots").distinct())

    def rejects(self) -> DataFrame | None:
        """Newest vote pages that were linked but not accepted: (page_id, url, reason)."""
        votes = self._newest("votes")
        return None if votes is None else votes.where("reason is not null").select("page_id", "url", "reason")

    def compact(self) -> None:
        """Folds the batches of each table into a base without the rows of superseded pages; readers switch to it
        once it is complete."""
        current = self._newest("votes").select("page_id")
        tables = {"ballots": lambda: self._read("ballots").distinct().join(current, "page_id", "left_semi"),
                  "votes": lambda: self._newest("votes"), "infos": lambda: self._newest("infos")}
        for name, rows in tables.items():
            t = SnapshotTable(self.spark, f"{self.base}/{name}")
            done = t._list("d")
            if done and done[-1] not in t._versions():
                t.write(rows(), done[-1])


def linked_pages(facts: DataFrame) -> DataFrame:
    """Facts of the pages that an index row links to, once per role (vote, info) and salt; a stream-stream join."""
    rows = E.index_rows(facts).select("url", "file_href", F.pmod(F.col("index_page_id"), F.lit(SALTS)).alias("salt"))
    links = rows.select("salt", F.inline(F.array(
        F.struct(F.col("url").alias("link"), F.lit("vote").alias("role")),
        F.struct(F.col("file_href").alias("link"), F.lit("info").alias("role")))))
    links = links.where("link is not null").dropDuplicates(["link", "role", "salt"])
    return facts.drop("index_rows", "skipped_rows").join(links, F.col("url") == F.col("link")).drop("link", "salt")


def stream_extract(spark: SparkSession, pages_stream: DataFrame, base: str, checkpoint: str,
                   available_now: bool = True, files_per_batch: int = 1024) -> RollcallTables:
    """Starts (or with ``available_now`` runs to its end) the extraction of ``pages_stream`` into tables under ``base``.

    ``files_per_batch`` bounds how many files of facts one batch of the second query takes.
    """
    tables = RollcallTables(spark, base)

    def start(writer, name: str):
        writer = writer.option("checkpointLocation", f"{checkpoint}/{name}").queryName(f"rollcalls-{name}")
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
        return writer

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch = E.checkpointed(batch.dropDuplicates(["page_id", "role"]))
        votes, ballots, rejects = E.vote_pages(batch.where("role = 'vote'").drop("role"))
        reasons = rejects.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reason"))
        urls = batch.where("role = 'vote'").select("page_id", "url")
        tables.append("votes", votes.withColumn("reason", F.lit(None).cast("string")).unionByName(
            reasons.join(urls, "page_id").withColumn("date", F.lit(None).cast("timestamp"))), batch_id)
        tables.append("ballots", ballots, batch_id)
        tables.append("infos", E.info_pages(batch.where("role = 'info'").drop("role")), batch_id)

    # pages of one large file are dealt to all cores: the parse is what takes time
    pages = pages_stream.select("page_id", "url", "html").repartition(spark.sparkContext.defaultParallelism, "url", "page_id")
    facts = page_facts_df(pages)
    first = start(facts.writeStream.format("parquet").option("path", f"{base}/facts"), "facts").start()
    if available_now:
        first.awaitTermination()
    with _state_store(spark):
        seen = spark.readStream.schema(FACTS_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(f"{base}/facts")
        second = start(linked_pages(seen).writeStream.foreachBatch(apply), "linked").start()
    if available_now:
        second.awaitTermination()
    tables.queries = (first, second)
    return tables
