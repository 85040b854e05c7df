"""Tree operators against the demo-tree goldens (FIXTURES.md §8) and a property test."""

import random

import pytest
from pyspark.sql import functions as F

from hemicycle.operators import edit_log
from hemicycle.operators import tree as H


def rows(df, cols=("id", "parent_id", "position", "lft", "rgt", "level")):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def demo(spark):
    return H.demo_tree(spark)


def test_numbering_reproduces_dump(spark, demo):
    renum = H.number_tree(demo.select(*H.ADJ_COLS))
    assert rows(renum) == rows(demo)


def test_analyze_ok(spark, demo):
    rep = H.analyze(demo).orderBy("check_no").collect()
    assert [r.status for r in rep] == ["OK"] * 5


def test_descendants_and_path(spark, demo):
    d = H.descendants(demo).where("ancestor_id = 5").select("id").collect()
    assert sorted(r.id for r in d) == [5, 12]
    p = H.paths(demo).where("id = 12").first()
    assert p.path_ids == "1/2/5/12"


def test_search_ancestors(spark, demo):
    got = sorted(r.id for r in H.search_ancestors(demo, "HTML").collect())
    assert got == [1, 2, 3, 5]


def test_remove(spark, demo):
    t = H.remove_subtree(demo, 3)
    assert rows(t, ("id", "lft", "rgt", "position")) == sorted([
        (1, 1, 10, 2), (2, 2, 7, 0), (5, 3, 6, 0), (12, 4, 5, 0), (6, 8, 9, 1)])


def test_move(spark, demo):
    t = H.move_subtree(demo, 5, 6, 0)
    assert rows(t, ("id", "lft", "rgt", "level")) == sorted([
        (1, 1, 14, 0), (2, 2, 7, 1), (3, 3, 6, 2), (4, 4, 5, 3), (6, 8, 13, 1),
        (5, 9, 12, 2), (12, 10, 11, 3)])


def test_refusals(spark, demo):
    with pytest.raises(H.RefusedEdit):
        H.move_subtree(demo, 2, 4, 0)
    with pytest.raises(H.RefusedEdit):
        H.remove_subtree(demo, 1)
    with pytest.raises(H.RefusedEdit):
        H.move_subtree(demo, 1, 6, 0)


def test_copy(spark, demo):
    t = H.copy_subtree(demo, 5, 6, 0)
    assert [r.status for r in H.analyze(t).collect()] == ["OK"] * 5
    new = {r.id: r for r in t.where("id > 12").collect()}
    assert sorted(new) == [13, 14]
    assert new[13].parent_id == 6 and new[13].title == "_docs"
    assert new[14].parent_id == 13 and new[14].title == "zmei.html"


def test_broken_tree(spark, demo):
    broken = demo.withColumn("parent_id", F.when(F.col("id") == 12, F.lit(99).cast("long"))
                             .otherwise(F.col("parent_id")))
    rep = {r.check_no: r.status for r in H.analyze(broken).collect()}
    assert rep[3] == "FAIL" and rep[5] == "FAIL"
    renum = H.number_tree(broken.select(*H.ADJ_COLS))
    assert 12 not in {r.id for r in renum.collect()}


def _random_forest(n, seed):
    rnd = random.Random(seed)
    rows_ = [(1, 0, 0, "n1", "t")]
    kids = {1: 0}
    for i in range(2, n + 1):
        p = rnd.randint(1, i - 1)
        rows_.append((i, p, kids.get(p, 0), f"n{i}", "t"))
        kids[p] = kids.get(p, 0) + 1
    return rows_


def _model_numbering(rows_):
    ch = {}
    for i, p, pos, *_ in rows_:
        ch.setdefault(p, []).append((pos, i))
    out, c = {}, [0]

    def visit(i, d):
        c[0] += 1
        lft = c[0]
        for _, k in sorted(ch.get(i, [])):
            visit(k, d + 1)
        c[0] += 1
        out[i] = (lft, c[0], d)
    visit(1, 0)
    return out


def test_property_random_trees(spark):
    for seed in range(3):
        rws = _random_forest(60, seed)
        adj = spark.createDataFrame(rws, "id long, parent_id long, position long, title string, type string")
        t = H.number_tree(adj)
        model = _model_numbering(rws)
        assert {r.id: (r.lft, r.rgt, r.level) for r in t.collect()} == model
        assert [r.status for r in H.analyze(t).collect()] == ["OK"] * 5
        moved = H.move_subtree(t, 7, 3, 1) if not _inside(model, 7, 3) else t
        assert [r.status for r in H.analyze(moved).collect()] == ["OK"] * 5
        removed = H.remove_subtree(t, 9)
        assert [r.status for r in H.analyze(removed).collect()] == ["OK"] * 5
        size9 = (model[9][1] - model[9][0] + 1) // 2
        assert removed.count() == 60 - size9
        if not _inside(model, 5, 2):
            copied = H.copy_subtree(t, 5, 2, 0)
            assert [r.status for r in H.analyze(copied).collect()] == ["OK"] * 5
            assert copied.count() == 60 + (model[5][1] - model[5][0] + 1) // 2


def _inside(model, a, b):
    la, ra, _ = model[a]
    lb, rb, _ = model[b]
    return la <= lb and rb <= ra


def test_descendants_by_pointers_equal_dyadic_join(spark):
    rws = _random_forest(80, 5)
    adj = spark.createDataFrame(rws, "id long, parent_id long, position long, title string, type string")
    tree = H.number_tree(adj)
    a = {(r.ancestor_id, r.id, r.distance) for r in H.ancestor_pairs(adj).collect()}
    assert a == {(r.ancestor_id, r.id, r.distance) for r in H.descendants(tree).collect()}


def test_chain_of_ten_thousand(spark):
    """Depth costs log2(depth) rounds."""
    n = 10_000
    chain = spark.range(1, n + 1).selectExpr("id", "id - 1 as parent_id", "0L as position", "'t' as title", "'x' as type")
    t = H.number_tree(chain)
    assert t.where(f"lft <> id or rgt <> {2 * n} + 1 - id or level <> id - 1").count() == 0 and t.count() == n


def test_cycles_and_orphans_vanish(spark):
    rows = [(1, 0, 0, "r", ""), (2, 1, 0, "a", ""), (3, 4, 0, "c", ""), (4, 3, 0, "c", ""), (5, 4, 0, "c", ""), (6, 99, 0, "o", ""), (7, 6, 0, "o", "")]
    t = H.number_tree(spark.createDataFrame(rows, "id long, parent_id long, position long, title string, type string"))
    assert sorted((r.id, r.lft, r.rgt) for r in t.collect()) == [(1, 1, 4), (2, 2, 3)]


def test_wide_intervals(spark):
    """A root over four billion positions: containment cost does not follow the width."""
    rows = [(1, 0, 0, 1, 4_000_000_000, 0, "R", ""), (2, 1, 0, 1_999_999_999, 2_000_000_000, 1, "a", ""),
            (3, 1, 1, 3_000_000_001, 3_000_000_002, 1, "b", "")]
    t = spark.createDataFrame(rows, H.TREE_SCHEMA)
    got = sorted((r.ancestor_id, r.id, r.distance) for r in H.descendants(t).collect())
    assert got == [(1, 1, 0), (1, 2, 1), (1, 3, 1), (2, 2, 0), (3, 3, 0)]
    assert [r.id for r in H.search_ancestors(t, "b").collect()] == [1]



# ---------------------------------------------------------------- edits


def _edited(rows, log):
    """Edits one after another on plain lists: (rows of the numbered tree, sequence numbers refused)."""
    nodes = {i: [t, y] for i, _, _, t, y in rows}
    parent = {i: p for i, p, *_ in rows}
    kids = {}
    for i, p, pos, *_ in sorted(rows, key=lambda r: (r[2], r[0])):
        kids.setdefault(p, []).append(i)
    refused = []

    def under(i):
        return [i] + [d for k in kids.get(i, []) for d in under(k)]

    def put(i, ref, pos):
        mine = kids.setdefault(ref, [])
        mine.insert(min(max(pos or 0, 0), len(mine)), i)
        parent[i] = ref

    def level(i):
        return 0 if parent[i] not in nodes else 1 + level(parent[i])

    for n, e in enumerate(log):
        op, i, ref = e["op"], e.get("id"), e.get("ref_id")
        if op == "rename":
            if i in nodes:
                nodes[i] = [new if new is not None else old for new, old in zip((e.get("title"), e.get("type")), nodes[i])]
        elif op == "remove":
            if i == 1:
                refused.append(n)
            elif i in nodes:
                kids[parent[i]].remove(i)
                for d in under(i):
                    del nodes[d], parent[d]
                    kids.pop(d, None)
        elif op not in ("create", "move", "copy") or ref == 0 or ref not in nodes or (op != "create" and (
                i not in nodes or ref in under(i))) or (op == "move" and i == 1):
            refused.append(n)
        elif op == "create":
            new = max(nodes) + 1
            nodes[new] = [e.get("title"), e.get("type")]
            put(new, ref, e.get("position"))
        elif op == "move":
            kids[parent[i]].remove(i)
            put(i, ref, e.get("position"))
        else:
            base = max(nodes)
            new = {d: base + 1 + r for r, d in enumerate(sorted(under(i), key=lambda d: (level(d), d)))}
            for d, c in new.items():
                nodes[c] = list(nodes[d])
                if d != i:
                    parent[c] = new[parent[d]]
                kids[c] = [new[k] for k in kids.get(d, [])]
            put(new[i], ref, e.get("position"))
    out = [(i, p, k, *nodes[i]) for p, mine in kids.items() for k, i in enumerate(mine)]
    at = _model_numbering(out)
    return {(i, p, k, *at[i], t, y) for i, p, k, t, y in out}, refused


def _log(rng, n, ops, ids):
    return [{"op": rng.choice(ops), "id": rng.randrange(0, ids), "ref_id": rng.randrange(0, ids) if rng.random() < 0.95 else None,
             "position": rng.choice([None, -1, 0, 1, 2, 5, 99]), "title": rng.choice([None, f"t{i}"]), "type": rng.choice([None, "y"])}
            for i, _ in enumerate(range(n))]


SCHEMA = "id long, parent_id long, position long, title string, type string"


def _dense(rows):
    """The forest with positions 0, 1, ... under each parent."""
    place, out = {}, []
    for i, p, pos, t, y in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        out.append((i, p, place.setdefault(p, 0), t, y))
        place[p] += 1
    return out


def test_edit_log_equals_edits_one_by_one(spark):
    for seed in range(2):
        rng = random.Random(seed)
        rows = _dense(_random_forest(30, seed))
        log = _log(rng, 40, ["create", "move", "move", "copy", "remove", "rename", "drop"], 45)
        want, refused = _edited(rows, log)
        t = edit_log.apply_edits(H.number_tree(spark.createDataFrame(rows, SCHEMA)), log)
        assert {tuple(r) for r in t.select(H.TREE_COLS).collect()} == want
        assert sorted(r.seq for r in t._refused.collect()) == refused


def test_ten_thousand_edits_in_one_renumbering(spark, monkeypatch):
    rng = random.Random(9)
    rows = _dense(_random_forest(200, 9))
    log = _log(rng, 10_000, ["create", "move", "move", "move", "rename"], 2500)
    tree = H.number_tree(spark.createDataFrame(rows, SCHEMA)).cache()
    calls = []
    monkeypatch.setattr(edit_log, "number_tree", lambda adj: (calls.append(1), H.number_tree(adj))[1])
    t = edit_log.apply_edits(tree, log)
    want, refused = _edited(rows, log)
    assert {tuple(r) for r in t.select(H.TREE_COLS).collect()} == want
    assert t._refused.count() == len(refused) > 100 and calls == [1]


def test_edit_log_in_blocks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(edit_log, "BLOCK", 7)
    rng = random.Random(3)
    rows = _dense(_random_forest(25, 3))
    tree = H.number_tree(spark.createDataFrame(rows, SCHEMA))
    log = _log(rng, 20, ["create", "move", "copy", "remove"], 30)
    want, _ = _edited(rows, log)
    assert {tuple(r) for r in edit_log.apply_edits(tree, log).select(H.TREE_COLS).collect()} == want
    none = edit_log.apply_edits(tree, spark.createDataFrame([], edit_log.EDITS))
    assert none.count() == 25 and none._refused.count() == 0


def test_single_edits_shift_like_renumbering(spark, monkeypatch):
    """Remove, move, copy and create shift intervals; the result is the renumbered tree, without deriving it again."""
    rows = _dense(_random_forest(40, 11))
    tree = H.number_tree(spark.createDataFrame(rows, SCHEMA)).cache()
    tree.count()
    monkeypatch.setattr(H, "_double", None)
    jobs = [{"op": "move", "id": 7, "ref_id": 3, "position": 1}, {"op": "move", "id": 12, "ref_id": 1, "position": 0},
            {"op": "move", "id": 30, "ref_id": 1, "position": 99}, {"op": "copy", "id": 5, "ref_id": 40, "position": 0},
            {"op": "create", "ref_id": 2, "position": 1, "title": "n", "type": "x"}, {"op": "remove", "id": 9}, {"op": "remove", "id": 77}]
    run = {"move": lambda e: H.move_subtree(tree, e["id"], e["ref_id"], e["position"]),
           "copy": lambda e: H.copy_subtree(tree, e["id"], e["ref_id"], e["position"]),
           "create": lambda e: H.create_node(tree, e["ref_id"], e["position"], e["title"], e["type"]),
           "remove": lambda e: H.remove_subtree(tree, e["id"])}
    for e in jobs:
        want, refused = _edited(rows, [e])
        if refused:
            with pytest.raises(H.RefusedEdit):
                run[e["op"]](e)
        else:
            assert {tuple(r) for r in run[e["op"]](e).select(H.TREE_COLS).collect()} == want, e


def test_remove_many_subtrees(spark):
    rows = _dense(_random_forest(60, 4))
    tree = H.number_tree(spark.createDataFrame(rows, SCHEMA)).cache()
    for ids in ([5, 9, None, 9, 400], [2, 3, 4, 20, 21, 22, 59], [], [None]):
        want, _ = _edited(rows, [{"op": "remove", "id": i} for i in ids if i])
        got = H.remove_subtrees(tree, spark.createDataFrame([(i,) for i in ids], "id long"))
        assert {tuple(r) for r in got.select(H.TREE_COLS).collect()} == want, ids
    with pytest.raises(H.RefusedEdit):
        H.remove_subtrees(tree, spark.createDataFrame([(1,), (5,)], "id long"))


def test_counters_beyond_31_bits(spark):
    rows = [(1, 0, 0, 1, 6, 0, "R", ""), (2, 1, 0, 2, 3, 1, "a", ""), (3, 1, 1, 4, 5, 1, "b", "")]
    tree = spark.createDataFrame(rows, H.TREE_SCHEMA)
    marks = spark.createDataFrame([(2, 1 << 33, 5), (4, 1 << 34, 1 << 40)], "lft long, value long, value2 long")
    got = {tuple(r) for r in H.counts_inside(tree, marks).select("id", "n", "n2").collect()}
    assert (1, (1 << 33) + (1 << 34), (1 << 40) + 5) in got
