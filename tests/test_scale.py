"""What keeps the jobs within their limits on larger tables."""

import gc

import pyarrow as pa

from hemicycle.operators import extract as E
from hemicycle.sources import html as Hh

PAGE = '<html><body><p>Scrutin du : 1er avril 2003</p><p>Groupe Alpha (4) :</p><p>Pour : 2</p><p>M. A Un et Mme B Deux</p></body></html>'


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_ballots_are_read_off_pages_once(spark):
    """Votes, ballots and rejects come from one written table, not from windows run again for each."""
    df = spark.createDataFrame([(1, "http://x.example/1", PAGE), (2, "http://x.example/2", "<p>sans date</p>")], "page_id long, url string, html string")
    votes, ballots, rejects = E.vote_pages(E.facts(df))
    for out in (votes, ballots, rejects):
        assert "Window" not in plan(out) and "Join" not in plan(out)
    assert [(r.page_id, r.voter_name) for r in ballots.orderBy("ord").collect()] == [(1, "A Un"), (1, "B Deux")]
    assert [(r.page_id, r.reason) for r in rejects.collect()] == [(2, E.REASONS["date"])]


def test_parsed_pages_leave_the_worker_in_small_batches():
    """memory follows a few pages, not a whole Arrow batch of parsed trees."""
    n = 3 * Hh.ROWS_OUT + 1
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(n)), "url": ["u"] * n, "html": [PAGE] * n})
    schema = Hh.to_arrow_schema(Hh.FACTS_SCHEMA)
    sizes = [b.num_rows for b in Hh._parsed(lambda r: Hh._safe(Hh.page_facts, r["page_id"], r["html"]), schema)(iter([batch]))]
    assert sum(sizes) == n and max(sizes) <= Hh.ROWS_OUT


def test_page_trees_do_not_wait_for_the_collector():
    """F9, F10."""
    gc.collect()
    gc.disable()
    try:
        Hh.page_facts(1, PAGE)
        assert not any(isinstance(o, Hh.Node) for o in gc.get_objects())
    finally:
        gc.enable()


def test_terms_are_counted_within_their_row(spark):
    """Tokens of a text are not shuffled; ids borne by several rows, or null, still add up."""
    from hemicycle.operators import analysis as A
    df = spark.createDataFrame([(1, "Ab ab l'été"), (1, "AB x1"), (2, "ab"), (None, "ab"), (None, "ab cd"), (3, None), (4, "!")], "id long, t string")
    for analyzer in ("general", "timestamped_english", "english"):
        old = A.analyze(df, "id", "t", analyzer).groupBy("doc_id", "term", "kind").count()
        assert sorted(map(tuple, A.analyzed_terms(df, "id", "t", analyzer).collect()), key=str) == sorted(map(tuple, old.collect()), key=str)
    old = A.term_frequencies(A.normalized_tokens(df, "id", "t", "french"))
    assert sorted(map(tuple, A.counted_terms(df, "id", "t", "french").collect()), key=str) == sorted(map(tuple, old.collect()), key=str)


def test_postings_are_found_within_their_row(spark):
    """the positions of a document's terms need no shuffle."""
    from hemicycle.operators import analysis as A
    df = spark.createDataFrame([(1, "de la de"), (2, None), (3, "")], "id long, t string")
    out = A.with_positions(df, "t", "general", "p")
    assert "Exchange" not in plan(out)
    got = {r.id: [(x.term, list(x.positions)) for x in r.p or []] for r in out.collect()}
    assert got == {1: [("de", [0, 2]), ("la", [1])], 2: [], 3: []}
