"""Tree sources and sinks.

* S9 / K5 flat XML: ``<item id parent_id state><content><name>…`` rows go
  through Spark's XML data source both ways (attributes as ``_``-prefixed
  columns), no custom parsing.
* S8 nested JSON, S10 nested XML, S11 nested ``<ul><li>`` HTML: each file is
  one document (read whole, one row per file) flattened by a small Python
  walk inside ``mapInPandas`` into adjacency rows
  (doc, key, parent_key, position, title, state). A single document is the
  unit of work, as a single page is for the HTML jobs.
* ``assign_ids`` turns string keys into dense long ids with the skew-safe
  global rank, so the rows feed ``number_tree`` directly.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hemicycle.plans.ranking import global_rank
from hemicycle.sources import html as Hh

FLAT_SCHEMA = T.StructType([
    T.StructField("doc", T.StringType()), T.StructField("key", T.StringType()),
    T.StructField("parent_key", T.StringType()), T.StructField("position", T.LongType()),
    T.StructField("title", T.StringType()), T.StructField("state", T.StringType()),
])


def _json_title(data, lang: str | None):
    """``data`` is a string, a {title} object, or a list of language-tagged titles."""
    if isinstance(data, str):
        return data
    if isinstance(data, dict):
        return data.get("title")
    if isinstance(data, list) and data:
        if lang:
            for d in data:
                if isinstance(d, dict) and d.get("language") == lang:
                    return d.get("title")
        d = data[0]
        return d.get("title") if isinstance(d, dict) else str(d)
    return None


def flatten_json(doc: str, text: str, lang: str | None = None) -> list[dict]:
    """``[{data, attr, state, children}, "bare title", ...]`` -> adjacency rows."""
    out = []

    def walk(nodes, parent, prefix):
        for i, n in enumerate(nodes if isinstance(nodes, list) else [nodes]):
            if isinstance(n, str):
                n = {"data": n}
            key = (n.get("attr") or {}).get("id") or f"{prefix}{i}"
            out.append({"doc": doc, "key": key, "parent_key": parent, "position": i,
                        "title": _json_title(n.get("data"), lang), "state": n.get("state")})
            walk(n.get("children") or [], key, f"{key}.")

    walk(json.loads(text), None, "n")
    return out


def flatten_xml_nested(doc: str, text: str) -> list[dict]:
    """Nested ``<item id><content><name>…</name></content><item>…</item></item>``."""
    out = []
    root = ET.fromstring(text.encode("utf-8") if isinstance(text, str) else text)

    def walk(el, parent, prefix):
        for i, it in enumerate(el.findall("item")):
            key = it.get("id") or f"{prefix}{i}"
            name = it.find("content/name")
            out.append({"doc": doc, "key": key, "parent_key": parent, "position": i,
                        "title": (name.text or "").strip() if name is not None else None,
                        "state": it.get("state")})
            walk(it, key, f"{key}.")

    walk(root, None, "n")
    return out


def flatten_html_list(doc: str, text: str) -> list[dict]:
    """Nested ``<ul><li id><a>title</a><ul>…</ul></li></ul>``."""
    out = []
    root = Hh.parse(text)

    def first_ul(n):
        for e in Hh.iter_elements(n):
            if e.tag == "ul":
                return e
        return None

    def walk(ul, parent, prefix):
        lis = [c for c in ul.children if isinstance(c, Hh.Node) and c.tag == "li"]
        for i, li in enumerate(lis):
            key = li.attrs.get("id") or f"{prefix}{i}"
            a = next((c for c in li.children if isinstance(c, Hh.Node) and c.tag == "a"), None)
            title = "".join(Hh.text_pieces(a, set(), direct=False)).strip() if a is not None else None
            out.append({"doc": doc, "key": key, "parent_key": parent, "position": i, "title": title,
                        "state": (li.attrs.get("class") or None)})
            sub = next((c for c in li.children if isinstance(c, Hh.Node) and c.tag == "ul"), None)
            if sub is not None:
                walk(sub, key, f"{key}.")

    top = first_ul(root)
    if top is not None:
        walk(top, None, "n")
    return out


_FLATTENERS = {"json": flatten_json, "xml": flatten_xml_nested, "html": flatten_html_list}


def flatten_documents(docs: DataFrame, fmt: str) -> DataFrame:
    """(doc, text) rows -> flat adjacency rows, one document per Python call."""
    fn = _FLATTENERS[fmt]

    def batches(it):
        for pdf in it:
            rows = [r for d, t in zip(pdf["doc"], pdf["text"]) for r in fn(d, t)]
            yield pd.DataFrame(rows, columns=[f.name for f in FLAT_SCHEMA.fields])

    return docs.select("doc", "text").mapInPandas(batches, FLAT_SCHEMA)


def read_tree_files(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Whole files (one row each) -> flat adjacency rows."""
    docs = (spark.read.text(path, wholetext=True)
                 .select(F.input_file_name().alias("doc"), F.col("value").alias("text")))
    return flatten_documents(docs, fmt)


def assign_ids(flat: DataFrame, first_id: int = 1) -> DataFrame:
    """String keys -> dense long ids (doc, key order); roots get parent_id 0."""
    ranked = global_rank(flat, [F.col("doc"), F.col("key")], "_r")
    ids = ranked.select("doc", "key", (F.col("_r") + F.lit(first_id - 1)).alias("id"))
    parents = ids.select("doc", F.col("key").alias("parent_key"), F.col("id").alias("_pid"))
    return (ranked.join(ids, ["doc", "key"])
                  .join(parents, ["doc", "parent_key"], "left")
                  .select("id", F.coalesce("_pid", F.lit(0)).cast("long").alias("parent_id"),
                          F.col("position").cast("long").alias("position"), "title",
                          F.coalesce("state", F.lit("")).alias("type")))


# ---- S9 / K5: flat XML through Spark's XML source ----

XML_ITEM_SCHEMA = T.StructType([
    T.StructField("_id", T.LongType()), T.StructField("_parent_id", T.LongType()),
    T.StructField("_position", T.LongType()), T.StructField("_type", T.StringType()),
    T.StructField("content", T.StructType([T.StructField("name", T.StringType())])),
])


def write_flat_xml(tree: DataFrame, path: str) -> None:
    """K5: one ``<item id parent_id position type><content><name>`` per node."""
    (tree.select(F.col("id").alias("_id"), F.col("parent_id").alias("_parent_id"),
                 F.col("position").alias("_position"), F.col("type").alias("_type"),
                 F.struct(F.col("title").alias("name")).alias("content"))
         .write.mode("overwrite").format("xml").option("rootTag", "root").option("rowTag", "item")
         .save(path))


def read_flat_xml(spark: SparkSession, path: str) -> DataFrame:
    """Flat XML items -> adjacency rows (parent 0 = root)."""
    x = (spark.read.format("xml").option("rowTag", "item").schema(XML_ITEM_SCHEMA).load(path))
    return x.select(F.col("_id").alias("id"), F.col("_parent_id").alias("parent_id"),
                    F.coalesce(F.col("_position"), F.lit(0)).alias("position"),
                    F.col("content.name").alias("title"), F.coalesce(F.col("_type"), F.lit("")).alias("type"))
