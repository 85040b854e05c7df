"""Link frontier and the stored text index against plain versions."""

import random
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hemicycle.operators import frontier as FR
from hemicycle.operators.text_index import TextIndex

SITE = "http://s.example/"


def test_frontier_equals_breadth_first_search(spark):
    rng = random.Random(4)
    graph = {i: [rng.randrange(0, 60) for _ in range(rng.randrange(0, 4))] for i in range(40)}  # 40..59 are not stored
    graph.update({100 + i: [101 + i] for i in range(12)})  # a chain that leads back
    graph[112] = [100, 112]
    rows = [(i, f"{SITE}p/{i}#top", "".join(f'<a href="{to}">x</a><a class=x href=/p/{to}#f>y</a>' for to in out))
            for i, out in graph.items()]
    rows += [(500, f"{SITE}p/0", '<a href="/p/100">late</a><a href="http://other.example/">out</a>'), (501, None, "<a href=/p/7>x</a>"),
             (502, f"{SITE}p/59x", None)]
    graph[0] = graph[0] + [100]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    starts = {0, 3}
    depth, queue = {i: 0 for i in starts}, list(starts)
    for i in queue:
        for to in graph.get(i, []):
            if to not in depth:
                depth[to] = depth[i] + 1
                queue.append(to)
    start = F.col("url").rlike("/p/(0|3)(#|$)")
    got = {(r.url, r.depth, r.stored) for r in FR.reachable(pages, start, F.col("url").startswith(SITE)).collect()}
    assert got == {(f"{SITE}p/{i}", d, i in graph) for i, d in depth.items()}
    near = {(r.url, r.depth) for r in FR.reachable(pages, start, F.col("url").startswith(SITE), max_depth=2).collect()}
    assert near == {(f"{SITE}p/{i}", d) for i, d in depth.items() if d <= 2}
    assert FR.reachable(pages, F.lit(False)).count() == 0
    assert FR.reachable(pages.limit(0), F.lit(True)).count() == 0


WORDS = ["alpha", "beta", "gamma", "delta", "Été", "l'eau"]


def state(index):
    return ({tuple(r) for r in index.frequencies().collect()},
            {(r.field, r.term, r.uuid, tuple(r.positions)) for r in index.postings().collect()}, index.documents())


def test_index_after_upserts_equals_a_fresh_one(spark):
    rng = random.Random(2)
    schema = "uuid long, title string, body string, at long"

    def doc(i, at):
        return (i, rng.choice([None, "", " ".join(rng.choices(WORDS, k=3))]), " ".join(rng.choices(WORDS, k=rng.randrange(0, 9))), at)

    index = TextIndex(spark, tempfile.mkdtemp(prefix="index-"), ["title", "body"])
    live = {}
    for batch, ids in enumerate(([*range(30)], [3, 4, 5, 40, 41], [3, 9, 99, 41])):
        rows = [doc(i, at) for i in ids for at in (0, 1)] + [doc(None, 0)]
        gone = [9, 99, 41] if batch == 2 else []
        df = spark.createDataFrame(rows, schema)
        for _ in range(2 if batch == 1 else 1):  # a replayed batch
            index.upsert(df, batch, order=["at"], delete=F.col("uuid").isin(*gone) if gone else None)
        live.update({r[0]: r for r in rows if r[0] is not None and r[3] == 1})
        for i in gone:
            live.pop(i, None)
        if batch == 1:
            index.compact()
    fresh = TextIndex(spark, tempfile.mkdtemp(prefix="index-"), ["title", "body"])
    fresh.upsert(spark.createDataFrame(list(live.values()), schema), 0)
    assert state(index) == state(fresh) and index.documents() == len(live)
    texts = {i: [t.lower().replace("é", "e").replace("'", " ").split() for t in [r[2]]][0] for i, r in live.items()}
    want = Counter()
    for i, w in texts.items():
        want[i] += sum(w[k:k + 2] == ["alpha", "beta"] for k in range(len(w)))
    for _ in range(2):
        got = {r.uuid: r.hits for r in index.phrase("body", "Alpha beta").collect()}
        assert got == {i: n for i, n in want.items() if n}
        index.compact()
    assert state(index) == state(fresh)
    with pytest.raises(ValueError):
        index.phrase("body", " ")


def test_index_search_reads_its_buckets(spark):
    index = TextIndex(spark, tempfile.mkdtemp(prefix="index-"), ["body"])
    index.upsert(spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma")], "uuid long, body string"), 0)
    plan = index.postings("body", ["beta"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(field" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    empty = TextIndex(spark, tempfile.mkdtemp(prefix="index-"), ["body"])
    assert empty.documents() == 0 and empty.postings().count() == 0
    empty.compact()
    empty.upsert(spark.createDataFrame([], "uuid long, body string"), 0)
    assert empty.frequencies().count() == 0
