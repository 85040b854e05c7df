"""A stored positional index over text fields that survives upserts.

Four tables, each a compacted base plus one delta per batch (a replayed batch
rewrites its own):

* ``postings``: (field, term, uuid, version, positions), in folders by field and
  term bucket, so that a search reads the buckets of its terms only;
* ``forward``: (uuid, version, field, terms), in folders by uuid bucket: what a
  document put into the index, to be taken back when it changes;
* ``retired``: (uuid, version): postings of the uuid before this version no longer count;
* ``counts``: (field, term, n): differences of document frequencies; the row
  without a term counts the documents.

An upsert costs its own rows plus the forward buckets it touches; the postings of
old versions stay in place and are skipped by ``retired`` until ``compact``.

Defined results: of rows of one uuid in a batch the greatest by ``order`` (then by
the fields) is taken; a null field has no terms; a row whose fields are all null
is a document without terms; deleting an unknown uuid does nothing; rows without
uuid are not indexed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hemicycle.operators.analysis import normalized_tokens, with_positions
from hemicycle.plans.ranking import saved
from hemicycle.streaming.upsert import SnapshotTable, latest_per_key

#: folders of a table; a bucket is the unit that a search or an upsert reads
BUCKETS = 16

SCHEMAS = {
    "postings": "term string, uuid long, version long, positions array<int>, field string, bucket int",
    "forward": "uuid long, version long, field string, terms array<string>, bucket int",
    "retired": "uuid long, version long",
    "counts": "field string, term string, n long",
}
FOLDERS = {"postings": ["field", "bucket"], "forward": ["bucket"], "retired": [], "counts": []}


def bucket_of(c: Column | str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


class TextIndex:
    def __init__(self, spark: SparkSession, path: str, fields: list[str], analyzer: str = "general", uuid: str = "uuid"):
        self.spark, self.path, self.fields, self.analyzer, self.uuid = spark, path.rstrip("/"), fields, analyzer, uuid

    def _table(self, name: str, before: int | None = None) -> DataFrame:
        """Base and deltas of a table, or only the deltas of batches ``before``."""
        t = SnapshotTable(self.spark, f"{self.path}/{name}")
        done = [d for d in t._list("d") if before is None or d < before]
        base = [v for v in t._versions() if before is None or v < before]
        paths = [f"{t.path}/v{base[-1]:08d}"] if base else []
        paths += [f"{t.path}/d{d:08d}" for d in done if not base or d > base[-1]]
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[name])
        # tables with folders of their own cannot be read together from several places
        parts = [[p] for p in paths] if FOLDERS[name] else [paths]
        return reduce(DataFrame.unionByName, [self.spark.read.schema(SCHEMAS[name]).parquet(*p) for p in parts])

    def _write(self, name: str, df: DataFrame, folder: str) -> None:
        df = df.select(*[c.split()[0] for c in SCHEMAS[name].split(", ")])
        df.write.mode("overwrite").partitionBy(*FOLDERS[name]).parquet(f"{self.path}/{name}/{folder}")

    def upsert(self, batch: DataFrame, batch_id: int, order: list[str] | None = None, delete: Column | None = None) -> None:
        """Index the rows of ``batch``; rows for which ``delete`` holds take their uuid out instead."""
        rows = batch.where(F.col(self.uuid).isNotNull()).select(
            F.col(self.uuid).cast("long").alias("uuid"), *self.fields, *[c for c in order or [] if c not in self.fields],
            F.coalesce(delete, F.lit(False)).alias("_gone") if delete is not None else F.lit(False).alias("_gone"))
        rows = latest_per_key(rows, ["uuid"], order or [])
        version = F.lit(batch_id).cast("long").alias("version")
        # one row per document from here on: its postings are found within the row and written once
        for f in self.fields:
            rows = with_positions(rows.withColumn(f, F.when(~F.col("_gone"), F.col(f))), f, self.analyzer, f"_p_{f}").drop(f)
        held = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_p_{f}").alias("held")) for f in self.fields])
        rows = saved(rows.select("uuid", "_gone", F.filter(held, lambda x: F.size(x["held"]) > 0).alias("_fields")))
        by_field = rows.select("uuid", F.inline("_fields"))
        postings = by_field.select("uuid", "field", F.inline("held"))
        self._write("postings", postings.withColumn("version", version).withColumn("bucket", bucket_of("term")), f"d{batch_id:08d}")
        # one row per document and field, and one with field null that says the document is (or no longer is) there
        forward = by_field.select("uuid", "field", F.col("held.term").alias("terms"))
        marks = rows.select("uuid", F.lit(None).cast("string").alias("field"),
                            F.when(~F.col("_gone"), F.array().cast("array<string>")).alias("terms"))
        forward = forward.unionByName(marks).withColumn("version", version).withColumn("bucket", bucket_of("uuid"))
        self._write("forward", forward, f"d{batch_id:08d}")
        forward = self.spark.read.schema(SCHEMAS["forward"]).parquet(f"{self.path}/forward/d{batch_id:08d}")
        touched = [r["bucket"] for r in forward.select("bucket").distinct().collect()]  # at most BUCKETS rows
        old = self._table("forward", before=batch_id).where(F.col("bucket").isin(touched)).join(
            forward.select("uuid").distinct(), "uuid", "left_semi")
        newest = old.groupBy("uuid").agg(F.max("version").alias("version"))
        old = old.join(newest, ["uuid", "version"], "left_semi")
        self._write("retired", newest.select("uuid", version), f"d{batch_id:08d}")
        counts = None
        for df, sign in ((forward, 1), (old, -1)):
            terms = df.where("field is not null").select("field", F.explode("terms").alias("term"))
            docs = df.where("field is null and terms is not null").select("field", F.lit(None).cast("string").alias("term"))
            part = terms.unionByName(docs).groupBy("field", "term").agg((sign * F.count(F.lit(1))).alias("n"))
            counts = part if counts is None else counts.unionByName(part)
        counts = counts.groupBy("field", "term").agg(F.sum("n").alias("n")).where("n <> 0")
        self._write("counts", counts, f"d{batch_id:08d}")

    def frequencies(self) -> DataFrame:
        """(field, term, df) of all terms that are there."""
        return (self._table("counts").where("term is not null").groupBy("field", "term").agg(F.sum("n").alias("df"))
                .where("df > 0"))

    def documents(self) -> int:
        return self._table("counts").where("term is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def _live(self, postings: DataFrame) -> DataFrame:
        retired = self._table("retired").groupBy("uuid").agg(F.max("version").alias("_from"))
        return postings.join(retired, "uuid", "left").where(F.col("_from").isNull() | (F.col("version") >= F.col("_from"))).drop("_from")

    def postings(self, field: str | None = None, terms: list[str] | None = None) -> DataFrame:
        """(field, term, uuid, positions) that count; with ``terms`` only their buckets are read."""
        df = self._table("postings")
        if field is not None:
            df = df.where(F.col("field") == field)
        if terms is not None:
            place = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(bucket_of("t")).collect()]
            df = df.where(F.col("bucket").isin(place) & F.col("term").isin(*terms))
        return self._live(df).select("field", "term", "uuid", "positions")

    def terms_of(self, text: str) -> list[tuple[int, str]]:
        """(position, term) of a query text, analyzed like the field."""
        one = self.spark.createDataFrame([(0, text)], "doc_id long, text string")
        return sorted((r["pos"], r["term"]) for r in normalized_tokens(one, "doc_id", "text", self.analyzer).collect())

    def phrase(self, field: str, text: str) -> DataFrame:
        """(uuid, hits, score): documents with the phrase, its number of places, and tf * ln(N / df) summed over its terms.

        Every position of the i-th term stands for a phrase that begins i places before; a phrase is there where all
        terms agree.
        """
        query = self.terms_of(text)
        if not query:
            raise ValueError("empty phrase")
        terms = sorted({t for _, t in query})
        found = self.postings(field, terms)
        wanted = self.spark.createDataFrame([(p - query[0][0], t) for p, t in query], "at int, term string")
        starts = found.join(wanted, "term").select("uuid", F.explode("positions").alias("pos"), "at")
        hits = (starts.groupBy("uuid", (F.col("pos") - F.col("at")).alias("start")).agg(F.count(F.lit(1)).alias("n"))
                .where(F.col("n") == len(query)).groupBy("uuid").agg(F.count(F.lit(1)).alias("hits")))
        n = self.documents()
        idf = self.frequencies().where((F.col("field") == field) & F.col("term").isin(*terms)).select("term", F.log(n / F.col("df")).alias("idf"))
        score = (found.join(idf, "term").groupBy("uuid").agg(F.round(F.sum(F.size("positions") * F.col("idf")), 6).alias("score")))
        return hits.join(score, "uuid").select("uuid", "hits", "score")

    def compact(self) -> None:
        """Folds all deltas into bases without what has been taken back; readers switch when a base is complete.

        ``retired`` goes last: until then it only skips postings that are no longer there.
        """
        last = max(SnapshotTable(self.spark, f"{self.path}/counts")._list("d"), default=None)
        if last is None:
            return
        newest = self._table("forward").groupBy("uuid").agg(F.max("version").alias("version"))
        rows = {"postings": self._live(self._table("postings")),
                "forward": self._table("forward").join(newest, ["uuid", "version"], "left_semi"),
                "counts": self._table("counts").groupBy("field", "term").agg(F.sum("n").alias("n")).where("n <> 0"),
                "retired": self._table("retired").limit(0)}
        for name, df in rows.items():
            t = SnapshotTable(self.spark, f"{self.path}/{name}")
            if last not in t._versions():
                self._write(name, df, f"v{last:08d}")
