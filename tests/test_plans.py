"""Plan-shape tests: the scale properties claimed in the README, checked on the physical plans."""

import contextlib
import io

import pytest

from hemicycle.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_tallies_prune_push_and_partial_aggregate(spark):
    p = plan(QUERIES["rollcall_tallies"](spark, SF))
    assert "PushedFilters: [In(l_returnflag, [A,N,R])]" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string>" in p
    assert "partial_count" in p
    assert p.count("Exchange (") == 1


def test_history_topk_limits_before_the_shuffle(spark):
    p = plan(QUERIES["voter_history_topk"](spark, SF))
    assert p.count("WindowGroupLimit (") >= 2


def test_latest_wins_is_a_partial_aggregate(spark):
    p = plan(QUERIES["upsert_latest"](spark, SF))
    assert "partial_max_by" in p
    assert "Window" not in p


def test_legislature_folders_are_pruned_at_run_time(spark):
    p = plan(QUERIES["rollcall_legislatures"](spark, SF))
    assert "dynamicpruning" in p


def test_text_scan_pushdown(spark):
    p = plan(QUERIES["tokens_fr"](spark, SF))
    assert "EqualTo(lang,fr)" in p
    assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p


PYTHON_BACKED = {"stem_vocab", "french_analyzer_tokens", "english_analyzer_tokens", "name_resolution", "prefix_search_highlight",
                 "search_stop_word_head", "rollcall_resolved", "rollcall_pages_roundtrip", "rollcall_scrutinies", "rollcall_rejects",
                 "page_blocks", "page_join_chain", "rollcall_extract", "deputy_profiles"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loop_and_no_python_in_native_queries(spark, name):
    p = plan(QUERIES[name](spark, SF))
    assert "BroadcastNestedLoopJoin" not in p
    assert "CartesianProduct" not in p
    if name not in PYTHON_BACKED:
        for op in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "PythonUDF"):
            assert op not in p, op


@pytest.mark.parametrize("name", ["rollcall_resolved", "scrutiny_documents"])
def test_large_shuffles_follow_the_rows(spark, name, monkeypatch):
    """The large joins and the distinct counts are dealt over more tasks where the ballots are more."""
    from hemicycle.sources import tables as T
    monkeypatch.setattr(T, "ROWS_A_TASK", 500)
    n = T.parts(spark, SF, "lineitem")
    assert n == -(-T.table(spark, SF, "lineitem").count() // 500) > 4
    assert plan(QUERIES[name](spark, SF)).count(f", {n}), REPARTITION_BY_NUM") >= 2
