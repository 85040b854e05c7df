"""Tree file sources (S8-S11) and the flat XML round trip (K5 + S9)."""

import tempfile

from hemicycle.operators import tree as H
from hemicycle.sources import tree_files as TF

JSON_DOC = """[
  {"data": "Top", "attr": {"id": "t1"}, "state": "open",
   "children": [{"data": "Kid", "state": "closed"}, "Bare kid"]},
  {"data": [{"title": "Deux", "language": "fr"}, {"title": "Two", "language": "en"}]}
]"""

XML_NEST = """<root><item id="a"><content><name><![CDATA[A]]></name></content>
<item id="b"><content><name>B</name></content></item><item id="c"><content><name>C</name></content></item>
</item><item id="d"><content><name>D</name></content></item></root>"""

HTML_LIST = """<div><ul><li id="x"><a href="#">X</a><ul><li><a href="#">Y</a></li></ul></li>
<li id="z"><a href="#">Z</a></li></ul></div>"""


def test_flatten_json():
    rows = TF.flatten_json("d", JSON_DOC, lang="en")
    got = [(r["key"], r["parent_key"], r["position"], r["title"]) for r in rows]
    assert got == [("t1", None, 0, "Top"), ("t1.0", "t1", 0, "Kid"), ("t1.1", "t1", 1, "Bare kid"),
                   ("n1", None, 1, "Two")]


def test_flatten_xml_and_html():
    got = [(r["key"], r["parent_key"], r["title"]) for r in TF.flatten_xml_nested("d", XML_NEST)]
    assert got == [("a", None, "A"), ("b", "a", "B"), ("c", "a", "C"), ("d", None, "D")]
    got = [(r["key"], r["parent_key"], r["title"]) for r in TF.flatten_html_list("d", HTML_LIST)]
    assert got == [("x", None, "X"), ("x.0", "x", "Y"), ("z", None, "Z")]


def test_json_to_numbered_tree(spark):
    docs = spark.createDataFrame([("d1", JSON_DOC)], "doc string, text string")
    adj = TF.assign_ids(TF.flatten_documents(docs, "json"))
    t = H.number_tree(adj)
    assert sorted((r.title, r.lft, r.rgt, r.level) for r in t.collect()) == sorted([
        ("Top", 1, 6, 0), ("Kid", 2, 3, 1), ("Bare kid", 4, 5, 1), ("Deux", 7, 8, 0)])


def test_flat_xml_roundtrip(spark):
    demo = H.demo_tree(spark)
    path = tempfile.mkdtemp(prefix="tree-xml-") + "/out"
    TF.write_flat_xml(demo, path)
    back = H.number_tree(TF.read_flat_xml(spark, path))
    cols = ("id", "parent_id", "lft", "rgt", "level", "title")
    assert sorted(tuple(r[c] for c in cols) for r in back.collect()) == \
        sorted(tuple(r[c] for c in cols) for r in demo.collect())
