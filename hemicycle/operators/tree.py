"""Hierarchies stored as tables: adjacency (parent_id, position) + nested set (lft, rgt, level).

The reference keeps both encodings in one MySQL table and edits them row by
row (one SQL round trip per step). Here every operation is set-based:

* ``number_tree`` (H10/W8) derives lft/rgt/level for the whole forest from the
  adjacency columns by pointer doubling: in log2(depth) rounds every node learns its
  level, its root and its subtree size n; one skew-safe sort gives the sizes of its earlier
  siblings; log2(depth) more rounds add them up along its path. Rows have a fixed width at any depth.
* containment (J5/J6) covers each interval by at most 2 log2 n dyadic blocks
  and joins on the block: an exact equi-join whose output is the answer.
* where only a count inside an interval is asked (J7, J9, A11), it is the
  difference of two prefix sums over the sorted positions: no pairs at all.
* single edits (H5-H8, H13) shift lft/rgt/level by constants and rank the siblings they touch; an edit log (H18,
  ``edit_log.py``) rewrites parent_id / position and renumbers once.

Unreachable nodes (missing parent, cycles) vanish from a renumbered tree, as
they do in the reference; ``analyze`` reports them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hemicycle.plans.ranking import checkpointed, global_prefix, global_prefixes, global_rank, rank_in_groups, saved

ADJ_COLS = ["id", "parent_id", "position", "title", "type"]
TREE_COLS = ["id", "parent_id", "position", "lft", "rgt", "level", "title", "type"]
ROOT_ID = 1  # the reference refuses to remove or move node 1

TREE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("parent_id", T.LongType(), False),
    T.StructField("position", T.LongType(), False),
    T.StructField("lft", T.LongType(), True),
    T.StructField("rgt", T.LongType(), True),
    T.StructField("level", T.LongType(), True),
    T.StructField("title", T.StringType(), True),
    T.StructField("type", T.StringType(), True),
])


class RefusedEdit(ValueError):
    """An edit the reference refuses (root, ref 0, move into own subtree)."""


# --------------------------------------------------------------------------
# sources
# --------------------------------------------------------------------------

def tree_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacency rows for root -> region -> nation -> customer.

    Ids: root 1, region 2 + r_regionkey, nation 10 + n_nationkey, customer
    100 + c_custkey (region and nation sizes are fixed by the data model).
    Positions are dense 0..k-1 per parent in key order; customers are ranked
    with the skew-safe ``rank_in_groups`` since one nation can hold a large
    share of all customers.
    """
    from hemicycle.sources.tables import table

    root = spark.range(1).select(F.lit(ROOT_ID).cast("long").alias("id"),
                                 F.lit(0).cast("long").alias("parent_id"),
                                 F.lit(0).cast("long").alias("position"),
                                 F.lit("ROOT").alias("title"), F.lit("root").alias("type"))
    r = table(spark, sf_dir, "region")  # 5 rows by the data model: an unpartitioned window is fine
    regions = r.select((F.col("r_regionkey") + 2).cast("long").alias("id"),
                       F.lit(ROOT_ID).cast("long").alias("parent_id"),
                       (F.row_number().over(Window.orderBy("r_regionkey")) - 1).cast("long").alias("position"),
                       F.col("r_name").alias("title"), F.lit("region").alias("type"))
    n = table(spark, sf_dir, "nation")
    nations = n.select((F.col("n_nationkey") + 10).cast("long").alias("id"),
                       (F.col("n_regionkey") + 2).cast("long").alias("parent_id"),
                       (F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1)
                       .cast("long").alias("position"),
                       F.col("n_name").alias("title"), F.lit("nation").alias("type"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name")
    c = rank_in_groups(c, ["c_nationkey"], ["c_custkey"], "rn")
    customers = c.select((F.col("c_custkey") + 100).cast("long").alias("id"),
                         (F.col("c_nationkey") + 10).cast("long").alias("parent_id"),
                         (F.col("rn") - 1).cast("long").alias("position"),
                         F.col("c_name").alias("title"), F.lit("customer").alias("type"))
    return root.unionByName(regions).unionByName(nations).unionByName(customers)


# The reference's 7-row demo tree (id, parent_id, position, lft, rgt, level, title, type).
DEMO_TREE_ROWS = [
    (1, 0, 2, 1, 14, 0, "ROOT", ""),
    (2, 1, 0, 2, 11, 1, "C:", "drive"),
    (3, 2, 0, 3, 6, 2, "_demo", "folder"),
    (4, 3, 0, 4, 5, 3, "index.html", "default"),
    (5, 2, 1, 7, 10, 2, "_docs", "folder"),
    (6, 1, 1, 12, 13, 1, "D:", "drive"),
    (12, 5, 0, 8, 9, 3, "zmei.html", "default"),
]


def demo_tree(spark: SparkSession) -> DataFrame:
    """H9: the reference's default demo tree as a DataFrame (tests, examples)."""
    return spark.createDataFrame(DEMO_TREE_ROWS, TREE_SCHEMA)


# --------------------------------------------------------------------------
# numbering
# --------------------------------------------------------------------------

def _written(df: DataFrame, live: Column) -> tuple[DataFrame, int]:
    """``df`` saved, and the number of its rows that are ``live``, counted while it is written."""
    seen = Observation()
    df = saved(df.observe(seen, F.count(F.when(live, 1)).alias("live")))
    return df, seen.get["live"]


def _double(state: DataFrame, sums: dict[str, str], up: dict[str, str], live: int | None = None) -> DataFrame:
    """Pointer doubling over ``state(id, anc, ...)`` until every pointer is null.

    Each round, ``up[c]`` combines a node's own ``c`` with that of its pointer (towards the root), ``sums[c]``
    combines it with those of the nodes pointing at it (from below); both are SQL expressions over ``c`` and ``other``.
    A round is one job, which writes the next state and counts its open pointers. ``live`` is that count for a
    ``state`` that is a written table itself.
    Nodes that reach a cycle never finish: after log2(nodes) + 1 rounds they are dropped.
    """
    open_ = F.col("anc").isNotNull()
    if live is None:
        state, live = _written(state, open_)
    rounds = max(live, 1).bit_length() + 1
    for _ in range(rounds):
        if not live:
            return state
        above = state.select(F.col("id").alias("anc"), F.col("anc").alias("_anc"), *[F.col(c).alias(f"_{c}") for c in up])
        nxt = state.join(above, "anc", "left")
        if sums:
            nxt = nxt.join(state.where(open_).groupBy(F.col("anc").alias("id")).agg(
                *[F.expr(e.split("|")[0]).alias(f"s_{c}") for c, e in sums.items()]), "id", "left")
        keep = [c for c in state.columns if c not in ("id", "anc", *up, *sums)]
        new = {**{c: F.expr(e.replace("other", f"_{c}")) for c, e in up.items()},
               **{c: F.expr(e.split("|")[1].replace("other", f"s_{c}")) for c, e in sums.items()}}
        state, live = _written(nxt.select("id", F.col("_anc").alias("anc"), *keep, *[
            F.coalesce(v, F.col(c)).alias(c) for c, v in new.items()]), open_)
    return saved(state.where(~open_))


def _pointers(adj: DataFrame, more: list[str] | None = None) -> DataFrame:
    """(id, parent_id, anc, *more): the parent where it exists, null for roots and for nodes whose parent is missing."""
    ids = adj.select(F.col("id").alias("parent_id"), F.col("id").alias("anc"))
    keep = ["id", "parent_id", *(more or [])]
    return adj.select(*keep).join(ids, "parent_id", "left").select("id", "parent_id", "anc", *keep[2:])


def number_tree(adj: DataFrame) -> DataFrame:
    """(id, parent_id, position, title, type) -> TREE_COLS with lft/rgt/level.

    A forest is numbered consecutively, roots in (position, id) order; unreachable nodes vanish. It replaces the
    stack machine that joins the stack top with its next child one step at a time (J10, O11).

    The interval of a node starts one after that of its parent, plus twice the sizes of its earlier siblings; both
    are sums along paths, so any depth takes log2(depth) rounds over rows of fixed width.
    """
    adj = adj.select(*ADJ_COLS)
    adj, live = _written(_pointers(adj, ["position", "title", "type"]), F.col("anc").isNotNull())
    start = (adj.select("id", "parent_id", "anc", F.when(F.col("anc").isNull(), 0).otherwise(1).cast("long").alias("level"),
                        F.coalesce("anc", "id").alias("root"), F.lit(1).cast("long").alias("size")))
    done = _double(start, sums={"size": "sum(size)|size + other"}, up={"level": "level + other", "root": "other"}, live=live)
    # a node is reachable when the top of its path is a root
    roots = adj.where(F.col("parent_id") == 0).select(F.col("id").alias("root"))
    sized = saved(done.join(roots, "root", "left_semi").select("id", "parent_id", "level", "size")
                  .join(adj.select("id", "position", "title", "type"), "id"))
    # sizes of all earlier siblings: a running sum over (parent, position), less its value where the parent starts
    running = (global_prefix(sized.select("id", "parent_id", "position", "size"), ["parent_id", "position", "id"], "size", "upto")
               .withColumn("before", F.col("upto") - F.col("size")).select("id", "parent_id", "before"))
    first = running.groupBy("parent_id").agg(F.min("before").alias("first"))
    offsets = (running.join(first, "parent_id").withColumn("off", 1 + 2 * (F.col("before") - F.col("first")))
               .withColumn("anc", F.when(F.col("parent_id") != 0, F.col("parent_id"))).select("id", "anc", "off"))
    placed = _double(offsets, sums={}, up={"off": "off + other"})
    return (sized.join(placed.select("id", F.col("off").alias("lft")), "id")
            .select("id", "parent_id", "position", "lft", (F.col("lft") + 2 * F.col("size") - 1).alias("rgt"),
                    "level", "title", "type"))


def ancestor_pairs(tree: DataFrame) -> DataFrame:
    """(ancestor_id, id, distance) of every node and itself, from the parent pointers in log2(depth) rounds.

    After round k all pairs up to distance 2^k are known; a node's further ancestors are those of its pointer.
    The rows are the answer itself: one per pair.
    """
    jump = saved(_pointers(tree).select("id", "anc"))
    pairs = saved(jump.select(F.col("id").alias("ancestor_id"), "id", F.lit(0).cast("long").alias("distance")))
    step = 1
    while not jump.where(F.col("anc").isNotNull()).isEmpty():
        if step > 2 * max(jump.count(), 1):
            raise ValueError("the parent pointers hold a cycle")
        far = (jump.where(F.col("anc").isNotNull()).select(F.col("id").alias("_low"), "anc")
               .join(pairs.select("ancestor_id", F.col("id").alias("anc"), "distance"), "anc")
               .select("ancestor_id", F.col("_low").alias("id"), (F.col("distance") + step).alias("distance")))
        pairs = saved(pairs.unionByName(far))
        jump = saved(jump.join(jump.select(F.col("id").alias("anc"), F.col("anc").alias("_a")), "anc", "left")
                            .select("id", F.col("_a").alias("anc")))
        step *= 2
    return pairs


# --------------------------------------------------------------------------
# containment (J5, J6, J7) on the nested set
# --------------------------------------------------------------------------

def _blocks(lo: Column, hi: Column, bits: int) -> Column:
    """The dyadic blocks (level k, index) that cover ``lo..hi`` exactly: at most two a level."""
    def level(k: Column) -> Column:
        shift = lambda name, c: F.call_function(name, c, k)
        left, right = shift("shiftright", lo + shift("shiftleft", F.lit(1).cast("long")) - 1), shift("shiftright", hi + 1)
        use = left < right
        return F.filter(F.array(F.struct(k.alias("k"), F.when(use & (left % 2 == 1), left).alias("b")),
                                F.struct(k.alias("k"), F.when(use & (right % 2 == 1), right - 1).alias("b"))),
                        lambda x: x["b"].isNotNull())
    return F.flatten(F.transform(F.array(*[F.lit(k) for k in range(bits)]), level))


def containment_pairs(tree: DataFrame, strict: bool = False, outer: DataFrame | None = None) -> DataFrame:
    """All (a, d) with d's interval inside a's: ``a.lft <= d.lft and d.rgt <= a.rgt``.

    ``strict`` excludes a = d. ``outer`` restricts the containing side to the asked nodes; default is the whole
    tree. Columns: a_id, a_lft, a_rgt, a_level, d_id, d_lft, d_rgt, d_level.

    Each containing interval is cut into dyadic blocks, each node lies in one block of every level that occurs; the
    equi-join on the block meets every pair once, however wide an interval is.
    """
    a = (outer if outer is not None else tree).select(
        F.col("id").alias("a_id"), F.col("lft").alias("a_lft"),
        F.col("rgt").alias("a_rgt"), F.col("level").alias("a_level"))
    bits = max(int(tree.agg(F.max("rgt")).first()[0] or 0).bit_length(), 1) + 1
    cover = checkpointed(a.withColumn("_c", F.explode(_blocks(F.col("a_lft"), F.col("a_rgt"), bits)))
                         .select("a_id", "a_lft", "a_rgt", "a_level", "_c.k", "_c.b"))
    levels = sorted(r.k for r in cover.select("k").distinct().collect())  # at most one per bit of a position
    d = (tree.select(F.col("id").alias("d_id"), F.col("lft").alias("d_lft"), F.col("rgt").alias("d_rgt"),
                     F.col("level").alias("d_level"), F.explode(F.array(*[F.lit(k) for k in levels])
                                                                if levels else F.array().cast("array<int>")).alias("k"))
         .withColumn("b", F.call_function("shiftright", F.col("d_lft"), F.col("k"))))
    inside = ((F.col("d_lft") > F.col("a_lft")) & (F.col("d_rgt") < F.col("a_rgt"))) if strict else (
        F.col("d_rgt") <= F.col("a_rgt"))
    return cover.join(d, ["k", "b"]).where(inside).drop("k", "b")


def counts_inside(tree: DataFrame, marks: DataFrame, key: Column | None = None, mark_key: Column | None = None) -> DataFrame:
    """(id, n): sum of ``marks(lft, value)`` strictly inside each node's interval, without pairs; n2 for ``value2``, ...

    One sort of marks and interval ends, a running sum, and the difference at the two ends. With ``key`` (of a
    node) and ``mark_key`` only marks of the node's key count.
    """
    k, mk = (key if key is not None else F.lit(0)).cast("long"), (mark_key if mark_key is not None else F.lit(0)).cast("long")
    zero = F.lit(0).cast("long")
    values = {c: "n" + c.removeprefix("value") for c in marks.columns if c.startswith("value")}
    ends = tree.select("id", k.alias("k"), F.explode(F.array(
        F.struct(F.col("lft").alias("at"), F.lit(-1).alias("sign")), F.struct(F.col("rgt").alias("at"), F.lit(1).alias("sign")))).alias("e"))
    rows = (ends.select("id", "k", "e.at", "e.sign", *[zero.alias(c) for c in values])
            .unionByName(marks.select(F.lit(None).cast("long").alias("id"), mk.alias("k"), F.col("lft").alias("at"),
                                      zero.cast("int").alias("sign"), *[F.col(c).cast("long").alias(c) for c in values])))
    # a mark at the position of a left end is the node itself: it sorts before, so it cancels out
    run = global_prefixes(rows.withColumn("o", F.when(F.col("sign") == 0, 0).otherwise(1)),
                          ["k", "at", "o", "id", "sign"], {f"upto_{c}": c for c in values})
    return (run.where(F.col("sign") != 0).groupBy("id")
            .agg(*[F.sum(F.col(f"upto_{c}") * F.col("sign")).cast("long").alias(n) for c, n in values.items()]))


def descendants(tree: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """H3: (ancestor_id, id, distance) of the asked nodes ``of`` (default: every node), inclusive of the node itself."""
    p = containment_pairs(tree, outer=of)
    return p.select(F.col("a_id").alias("ancestor_id"), F.col("d_id").alias("id"),
                    (F.col("d_level") - F.col("a_level")).alias("distance"))


def paths(tree: DataFrame, sep: str = "/") -> DataFrame:
    """H4 for every node: path to the root as ids and titles, root first.

    Output (id, level, path_ids, path_titles); the per-node list is the path itself.
    """
    t = tree.select(F.col("id").alias("ancestor_id"), F.col("title").alias("a_title"))
    per = (ancestor_pairs(tree).join(t, "ancestor_id").groupBy("id")
           .agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("o"), "ancestor_id", "a_title"))).alias("_p")))
    return per.join(tree.select("id", "level"), "id").select(
        "id", "level", F.array_join(F.transform("_p", lambda x: x["ancestor_id"].cast("string")), sep).alias("path_ids"),
        F.array_join(F.transform("_p", lambda x: x["a_title"]), sep).alias("path_titles"))


def title_matches(title: Column, needle: str) -> Column:
    """``LIKE '%x%'`` under a case- and accent-insensitive collation."""
    return F.contains(F.collate(title, "UNICODE_CI_AI"), F.lit(needle))


def search_ancestors(tree: DataFrame, needle: str) -> DataFrame:
    """Distinct strict ancestors of the nodes whose title contains ``needle``: the nodes with a hit
    strictly inside their interval (a difference of prefix sums, no pairs)."""
    hits = tree.where(title_matches(F.col("title"), needle)).select("lft", F.lit(1).alias("value"))
    inside = counts_inside(tree, hits).where("n > 0").select("id")
    return tree.join(inside, "id", "left_semi").select("id", "title").distinct()  # A5: distinct ids


def search_with_ancestors(tree: DataFrame, needle: str) -> DataFrame:
    """F10 + U2 (``show_only_matches``): the matching nodes and all their ancestors, distinct."""
    hits = tree.where(title_matches(F.col("title"), needle)).select("id", "title")
    return hits.unionByName(search_ancestors(tree, needle)).distinct()


# --------------------------------------------------------------------------
# Consistency report
# --------------------------------------------------------------------------

# The five report lines of the reference's analyze().
ANALYZE_MESSAGES = {
    "no_root": "No root node.",
    "many_roots": "More than one root node.",
    "one_root": "Just one root node.",
    "root_left_bad": "Root node's left index is not 1.",
    "root_left_ok": "Root node's left index is 1.",
    "missing_parents": "Missing parents.",
    "no_missing_parents": "No missing parents.",
    "right_bad": "Right index does not match node count.",
    "right_ok": "Right index matches count.",
    "adj_bad": "Adjacency and nested set do not match.",
    "adj_ok": "NS and AJ match",
}


def analyze(tree: DataFrame) -> DataFrame:
    """Five (check_no, status, message) rows, as the reference's analyze().

    One aggregate pass (A6) for roots / root left / max(rgt) / count; an anti
    join for missing parents (J8); nested-set children (nodes of level + 1 strictly
    inside, by prefix sums per level) against adjacency children counts (J9).
    """
    M = ANALYZE_MESSAGES
    stats = tree.agg(
        F.count_if(F.col("parent_id") == 0).alias("roots"),
        F.min(F.when(F.col("parent_id") == 0, F.col("lft"))).alias("root_lft"),
        F.max("rgt").alias("max_rgt"),
        F.count(F.lit(1)).alias("n"))
    ids = tree.select(F.col("id").alias("parent_id"))
    missing = (tree.where(F.col("parent_id") != 0).select("parent_id")
                   .join(ids, "parent_id", "left_anti")
                   .agg(F.count(F.lit(1)).alias("missing")))
    ns_children = counts_inside(tree, tree.select("lft", "level", F.lit(1).alias("value")), F.col("level") + 1,
                                F.col("level")).withColumnRenamed("n", "ns")
    aj_children = tree.groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("aj"))
    mismatch = (tree.select("id")
                    .join(ns_children, "id", "left").join(aj_children, "id", "left")
                    .where(F.coalesce("ns", F.lit(0)) != F.coalesce("aj", F.lit(0)))
                    .agg(F.count(F.lit(1)).alias("mismatch")))
    # the other one-row aggregates come in as scalar subqueries (no join)
    one = stats.select("*", missing.scalar().alias("missing"), mismatch.scalar().alias("mismatch"))
    lines = F.array(
        F.struct(F.lit(1).alias("check_no"),
                 F.when(F.col("roots") == 0, F.lit("FAIL")).when(F.col("roots") > 1, F.lit("FAIL"))
                  .otherwise(F.lit("OK")).alias("status"),
                 F.when(F.col("roots") == 0, F.lit(M["no_root"])).when(F.col("roots") > 1, F.lit(M["many_roots"]))
                  .otherwise(F.lit(M["one_root"])).alias("message")),
        F.struct(F.lit(2).alias("check_no"),
                 F.when(F.coalesce(F.col("root_lft") == 1, F.lit(False)), F.lit("OK")).otherwise(F.lit("FAIL")).alias("status"),
                 F.when(F.coalesce(F.col("root_lft") == 1, F.lit(False)), F.lit(M["root_left_ok"]))
                  .otherwise(F.lit(M["root_left_bad"])).alias("message")),
        F.struct(F.lit(3).alias("check_no"),
                 F.when(F.col("missing") > 0, F.lit("FAIL")).otherwise(F.lit("OK")).alias("status"),
                 F.when(F.col("missing") > 0, F.lit(M["missing_parents"]))
                  .otherwise(F.lit(M["no_missing_parents"])).alias("message")),
        F.struct(F.lit(4).alias("check_no"),
                 F.when(F.coalesce(F.col("max_rgt") / 2 == F.col("n"), F.lit(False)), F.lit("OK"))
                  .otherwise(F.lit("FAIL")).alias("status"),
                 F.when(F.coalesce(F.col("max_rgt") / 2 == F.col("n"), F.lit(False)), F.lit(M["right_ok"]))
                  .otherwise(F.lit(M["right_bad"])).alias("message")),
        F.struct(F.lit(5).alias("check_no"),
                 F.when(F.col("mismatch") > 0, F.lit("FAIL")).otherwise(F.lit("OK")).alias("status"),
                 F.when(F.col("mismatch") > 0, F.lit(M["adj_bad"])).otherwise(F.lit(M["adj_ok"])).alias("message")),
    )
    return one.select(F.inline(lines))


# --------------------------------------------------------------------------
# edits (H5-H8, H13, W7, H18)
# --------------------------------------------------------------------------

def get_node(tree: DataFrame, node_id: int):
    """H1: the node row, or None (a point lookup pushed into the scan; one row to the driver)."""
    return tree.where(F.col("id") == F.lit(node_id)).first()


def children(tree: DataFrame, node_id: int) -> DataFrame:
    """H2 + O5: children of a node ordered by position (structural orders: position,
    left, level, id are plain ``orderBy``)."""
    return tree.where(F.col("parent_id") == F.lit(node_id)).orderBy("position", "id")


def _adj(tree: DataFrame) -> DataFrame:
    return tree.select(*ADJ_COLS)


def _others(tree: DataFrame, parents: list[int], node_id: int | None) -> DataFrame:
    """Children of ``parents`` except the node, with their place ``_at`` from 0 in their order (skew-safe rank)."""
    kept = F.col("parent_id").isin(*[F.lit(p) for p in parents])
    if node_id is not None:
        kept &= F.col("id") != F.lit(node_id)
    ranked = rank_in_groups(tree.where(kept), ["parent_id"], [F.col("position"), F.col("id")], "_at")
    return checkpointed(ranked.withColumn("_at", F.col("_at") - 1))


def _seat(tree: DataFrame, ref, position: int, node_id: int | None = None, old_parent: int | None = None):
    """Room for a node as the ``position``-th child of ``ref``.

    Returns (rows other than the node, siblings renumbered densely with a free place; the place; the bracket position
    before which the node goes). The place is clamped to the number of other children.
    """
    parents = sorted({ref["id"]} | ({old_parent} if old_parent is not None else set()))
    others = _others(tree, parents, node_id)
    here = F.col("parent_id") == F.lit(ref["id"])
    place = min(max(position, 0), others.where(here).count())
    follower = others.where(here & (F.col("_at") == place)).select("lft").first()
    seated = others.withColumn("position", F.col("_at") + F.when(here & (F.col("_at") >= place), 1).otherwise(0)).select(*TREE_COLS)
    apart = ~F.col("parent_id").isin(*[F.lit(p) for p in parents])
    if node_id is not None:
        apart &= F.col("id") != F.lit(node_id)
    return tree.where(apart).select(*TREE_COLS).unionByName(seated), place, follower["lft"] if follower else ref["rgt"]


def _shift(df: DataFrame, by) -> DataFrame:
    """lft and rgt each moved by ``by(position)``: the sum of the widths opened and closed before it."""
    return df.withColumns({c: (F.col(c) + by(F.col(c))).cast("long") for c in ("lft", "rgt")}).select(*TREE_COLS)


def _step(at: Column, width: int) -> Column:
    return F.when(at, F.lit(width)).otherwise(F.lit(0))


def remove_subtree(tree: DataFrame, node_id: int) -> DataFrame:
    """H6: delete the node and its subtree, close the sibling gap, shift the intervals behind it.

    The tree is not derived again: lft and rgt change by constants, positions by the rank of the siblings.
    """
    if node_id == ROOT_ID:
        raise RefusedEdit("the root cannot be removed")
    node = get_node(tree, node_id)
    if node is None:
        return tree
    rest = tree.where(~((F.col("lft") >= node["lft"]) & (F.col("rgt") <= node["rgt"])))
    siblings = _others(rest, [node["parent_id"]], None).withColumn("position", F.col("_at")).select(*TREE_COLS)
    rest = rest.where(F.col("parent_id") != F.lit(node["parent_id"])).select(*TREE_COLS).unionByName(siblings)
    return _shift(rest, lambda at: _step(at > node["rgt"], node["lft"] - node["rgt"] - 1))


def remove_subtrees(tree: DataFrame, ids: DataFrame) -> DataFrame:
    """H6 for a frame of ids (column ``id``): every listed subtree goes, at any number of them.

    Nodes under a listed one are found by a running sum over the sorted brackets and taken out by a ``left_anti``
    join; the intervals behind shift by the running sum of what was taken out. Unknown and null ids name nothing,
    a subtree listed within another goes with it; the root is refused.
    """
    listed = saved(tree.select("id", "lft", "rgt").join(ids.select(F.col("id").cast("long").alias("id")), "id", "left_semi"))
    if not listed.where(F.col("id") == ROOT_ID).isEmpty():
        raise RefusedEdit("the root cannot be removed")
    one = F.lit(1).cast("long")
    marks = (tree.select("lft", F.col("id").alias("node"), (one * 0).alias("open"))
             .unionByName(listed.select("lft", (one * 0).alias("node"), one.alias("open")).withColumn("node", F.lit(None).cast("long")))
             .unionByName(listed.select(F.col("rgt").alias("lft"), F.lit(None).cast("long").alias("node"), (-one).alias("open"))))
    # a listed node's own mark opens before the node is met
    depth = global_prefix(marks, ["lft", F.col("node").asc_nulls_first(), "open"], "open", "depth")
    gone = saved(depth.where("node is not null and depth > 0").select(F.col("node").alias("id")))
    rest = saved(tree.join(gone, "id", "left_anti").select(*TREE_COLS))
    cut = tree.join(gone, "id", "left_semi").select(F.col("lft").alias("at"), F.lit(None).cast("long").alias("node"), F.lit("").alias("end"),
                                                   (one * 2).alias("width"))
    ends = [rest.select(F.col(c).alias("at"), F.col("id").alias("node"), F.lit(c).alias("end"), (one * 0).alias("width")) for c in ("lft", "rgt")]
    moved = global_prefix(cut.unionByName(ends[0]).unionByName(ends[1]), ["at"], "width", "less").where("node is not null")
    moved = saved(moved.select(F.col("node").alias("id"), "end", (F.col("at") - F.col("less")).alias("to")))
    for c in ("lft", "rgt"):
        rest = rest.drop(c).join(moved.where(F.col("end") == c).select("id", F.col("to").alias(c)), "id")
    parents = saved(tree.join(gone, "id", "left_semi").select("parent_id").distinct()
                    .join(gone.select(F.col("id").alias("parent_id")), "parent_id", "left_anti"))
    ranked = rank_in_groups(rest.join(parents, "parent_id", "left_semi"), ["parent_id"], ["position", "id"], "_at")
    return (rest.join(parents, "parent_id", "left_anti").select(*TREE_COLS)
            .unionByName(ranked.withColumn("position", F.col("_at") - 1).select(*TREE_COLS)))


def _subtree_rows(tree: DataFrame, node) -> DataFrame:
    return tree.where((F.col("lft") >= node["lft"]) & (F.col("rgt") <= node["rgt"])).select(*TREE_COLS)


def _check_target(tree: DataFrame, node_id: int, ref_id: int):
    node = get_node(tree, node_id)
    ref = get_node(tree, ref_id)
    if node is None or ref is None:
        raise RefusedEdit("unknown node or ref")
    if node["lft"] <= ref["lft"] and ref["rgt"] <= node["rgt"]:
        raise RefusedEdit("the ref is inside the node's own subtree")
    return node, ref


def move_subtree(tree: DataFrame, node_id: int, ref_id: int, position: int) -> DataFrame:
    """H7: make ``node_id`` the ``position``-th child of ``ref_id`` by shifting intervals.

    Refused like the reference: moving node 1, ref 0, or a ref inside the
    node's own subtree. The position is clamped to the ref's child count;
    old and new sibling lists are compacted in their existing order.
    """
    if ref_id == 0 or node_id == ROOT_ID:
        raise RefusedEdit("moving the root or under ref 0 is refused")
    node, ref = _check_target(tree, node_id, ref_id)
    others, place, at = _seat(tree, ref, position, node_id, node["parent_id"])
    width = node["rgt"] - node["lft"] + 1
    own = (F.col("lft") >= node["lft"]) & (F.col("rgt") <= node["rgt"])
    rest = _shift(others.where(~own), lambda x: _step(x >= at, width) - _step(x > node["rgt"], width))
    by = at - node["lft"] - (width if at > node["rgt"] else 0)
    is_node = F.col("id") == F.lit(node_id)
    moved = _shift(_subtree_rows(others, node).unionByName(tree.where(is_node).select(*TREE_COLS)), lambda x: F.lit(by))
    moved = moved.withColumns({"level": F.col("level") + (ref["level"] + 1 - node["level"]),
                               "parent_id": F.when(is_node, F.lit(ref_id)).otherwise(F.col("parent_id")).cast("long"),
                               "position": F.when(is_node, F.lit(place)).otherwise(F.col("position")).cast("long")})
    return rest.unionByName(moved)


def copy_subtree(tree: DataFrame, node_id: int, ref_id: int, position: int) -> DataFrame:
    """H8 + J12: copy a subtree under ``ref_id`` at ``position`` with new ids.

    New ids continue after max(id), assigned in (level, id) order as the
    reference's ``INSERT ... ORDER BY level`` does; each copy keeps its
    source's title, type and sibling position; the copy root takes
    ``position`` under ``ref_id``. Refused when the ref is inside the subtree.
    """
    if ref_id == 0:
        raise RefusedEdit("copy under ref 0 is refused")
    node, ref = _check_target(tree, node_id, ref_id)
    max_id = tree.agg(F.max("id")).first()[0]
    others, place, at = _seat(tree, ref, position)
    width = node["rgt"] - node["lft"] + 1
    src = global_rank(_subtree_rows(tree, node), [F.col("level"), F.col("id")], "_r").withColumn("_new", F.lit(max_id) + F.col("_r"))
    idmap = src.select(F.col("id").alias("parent_id"), F.col("_new").alias("_newp"))
    is_root = F.col("id") == F.lit(node_id)
    copies = src.join(idmap, "parent_id", "left").select(
        F.col("_new").alias("id"), F.when(is_root, F.lit(ref_id)).otherwise(F.col("_newp")).cast("long").alias("parent_id"),
        F.when(is_root, F.lit(place)).otherwise(F.col("position")).cast("long").alias("position"), "lft", "rgt",
        (F.col("level") + (ref["level"] + 1 - node["level"])).alias("level"), "title", "type")
    return _shift(others, lambda x: _step(x >= at, width)).unionByName(_shift(copies, lambda x: F.lit(at - node["lft"])))


def create_node(tree: DataFrame, ref_id: int, position: int, title: str | None = None,
                type_: str | None = None) -> DataFrame:
    """H5: a new node under ``ref_id`` at ``position`` (clamped), id = max(id) + 1."""
    if ref_id == 0:
        raise RefusedEdit("create under ref 0 is refused")
    ref = get_node(tree, ref_id)
    if ref is None:
        raise RefusedEdit("unknown ref")
    max_id = tree.agg(F.max("id")).first()[0]
    others, place, at = _seat(tree, ref, position)
    new = tree.sparkSession.createDataFrame([(max_id + 1, ref_id, place, at, at + 1, ref["level"] + 1, title, type_)], TREE_SCHEMA)
    return _shift(others, lambda x: _step(x >= at, 2)).unionByName(new)


def set_data(tree: DataFrame, updates: DataFrame) -> DataFrame:
    """Partial update of title / type by id; a null keeps the old value."""
    u = updates.select("id", F.col("title").alias("_t"), F.col("type").alias("_y"))
    return (tree.join(u, "id", "left")
                .withColumn("title", F.coalesce("_t", "title"))
                .withColumn("type", F.coalesce("_y", "type"))
                .select(*tree.columns))


# --------------------------------------------------------------------------
# rule checks and roll-ups
# --------------------------------------------------------------------------

def sort_siblings(tree: DataFrame, key: Column | None = None) -> DataFrame:
    """Reorder every sibling list by ``key`` (default title), then id; renumber.

    Positions come from the skew-safe ``rank_in_groups`` (a parent with a huge
    child list is ranked by a range-partitioned sort, not one task).
    """
    k = key if key is not None else F.col("title")
    adj = _adj(tree).withColumn("_k", k)
    ranked = rank_in_groups(adj, ["parent_id"], [F.col("_k"), F.col("id")], "_rn")
    adj = ranked.withColumn("position", (F.col("_rn") - 1).cast("long")).select(*ADJ_COLS)
    return number_tree(adj)


def duplicate_siblings(tree: DataFrame, case_insensitive: bool = True) -> DataFrame:
    """Nodes whose title is used more than once under their parent.

    One row per offending node: (parent_id, title_key, id, n) with n the size
    of its (parent, title) group - a violations frame, never a collected list.
    """
    t = F.lower(F.col("title")) if case_insensitive else F.col("title")
    keyed = tree.select("parent_id", t.alias("title_key"), "id")
    g = (keyed.groupBy("parent_id", "title_key").agg(F.count(F.lit(1)).alias("n"))
              .where(F.col("n") > 1))
    return keyed.join(g, ["parent_id", "title_key"]).select("parent_id", "title_key", "id", "n")


def rollup_checked(tree: DataFrame, leaf_flags: DataFrame) -> DataFrame:
    """Tri-state per node from its leaves' (id, checked) flags.

    ``state`` is checked (all leaves below checked), unchecked (none) or
    undetermined; ``top_checked`` marks checked nodes whose parent is not
    checked (the reference widget's default selection). A leaf without a flag
    counts as unchecked.
    """
    leaves = (tree.where(is_leaf()).select("id", "lft")
                  .join(leaf_flags.select("id", F.col("checked").alias("_c")), "id", "left")
                  .withColumn("_c", F.coalesce("_c", F.lit(False)).cast("int")))
    leaves = checkpointed(leaves)
    marks = leaves.select("lft", F.lit(1).cast("long").alias("value"), F.col("_c").cast("long").alias("value2"))
    own = leaves.select("id", F.col("_c").alias("_own"))
    agg = (counts_inside(tree, marks).join(own, "id", "left")
           .withColumn("_leaves", F.when(F.col("_own").isNotNull(), 1).otherwise(F.col("n")))
           .withColumn("_on", F.coalesce(F.col("_own"), F.col("n2")))
           .select("id", (F.col("_leaves") == F.col("_on")).alias("_all"), (F.col("_on") > 0).alias("_any")))
    state = (F.when(F.col("_all"), F.lit("checked"))
              .when(F.col("_any"), F.lit("undetermined")).otherwise(F.lit("unchecked")))
    st = tree.select("id", "parent_id").join(agg, "id", "left").withColumn("state", state)
    par = st.select(F.col("id").alias("parent_id"), F.col("state").alias("_ps"))
    return (st.join(par, "parent_id", "left")
              .select("id", "state",
                      ((F.col("state") == "checked") &
                       F.coalesce(F.col("_ps") != "checked", F.lit(True))).alias("top_checked")))


RULES_SCHEMA = "type string, max_children long, max_depth long, valid_children array<string>"


def check_rules(tree: DataFrame, rules: DataFrame) -> DataFrame:
    """Violations of per-type rules: (id, rule, value, limit).

    ``max_children`` / ``max_depth``: -1 unlimited, -2 unchecked. ``max_depth``
    bounds the levels below a node. ``valid_children``: null or ['all'] allows
    any type, ['none'] allows no child, else the listed types.
    """
    r = rules.select("type", "max_children", "max_depth", "valid_children")
    nchild = tree.groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("_nc"))
    # the deepest level below each node, child to parent in log2(depth) rounds
    deepest = _double(_pointers(tree).join(tree.select("id", F.col("level").alias("deep")), "id"),
                      sums={"deep": "max(deep)|greatest(deep, other)"}, up={})
    height = deepest.join(tree.select("id", "level"), "id").select("id", (F.col("deep") - F.col("level")).alias("_h"))
    base = (tree.select("id", "type").join(r, "type")
                .join(nchild, "id", "left").join(height, "id", "left")
                .fillna(0, ["_nc", "_h"]))
    too_many = base.where((F.col("max_children") >= 0) & (F.col("_nc") > F.col("max_children"))).select(
        "id", F.lit("max_children").alias("rule"), F.col("_nc").alias("value"), F.col("max_children").alias("limit"))
    too_deep = base.where((F.col("max_depth") >= 0) & (F.col("_h") > F.col("max_depth"))).select(
        "id", F.lit("max_depth").alias("rule"), F.col("_h").alias("value"), F.col("max_depth").alias("limit"))
    parents = tree.select(F.col("id").alias("parent_id"), F.col("type").alias("_pt")).join(
        r.select(F.col("type").alias("_pt"), "valid_children"), "_pt")
    kids = tree.select("id", "parent_id", "type").join(parents, "parent_id")
    allowed = (F.col("valid_children").isNull() | F.array_contains("valid_children", "all") |
               (~F.array_contains("valid_children", "none") & F.array_contains("valid_children", F.col("type"))))
    bad_child = kids.where(~allowed).select(
        F.col("parent_id").alias("id"), F.lit("valid_children").alias("rule"),
        F.col("id").alias("value"), F.lit(None).cast("long").alias("limit"))
    return too_many.unionByName(too_deep).unionByName(bad_child)


def catalog_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second hierarchy from ``part``: root -> p_type -> p_brand -> item (p_name).

    Ids: root 1, then types, then (type, brand) pairs by dense rank, then
    items after them by p_partkey. Positions follow key order per parent
    (skew-safe ranks); item titles repeat under a brand, which A10 reports.
    """
    from hemicycle.sources.tables import table

    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_name")
    types = global_rank(p.select("p_type").distinct(), [F.col("p_type")], "_t")
    brands = global_rank(p.select("p_type", "p_brand").distinct(), [F.col("p_type"), F.col("p_brand")], "_b")
    n_types = types.agg(F.count(F.lit(1))).scalar()
    n_brands = brands.agg(F.count(F.lit(1))).scalar()
    root = spark.range(1).select(F.lit(ROOT_ID).cast("long").alias("id"), F.lit(0).cast("long").alias("parent_id"),
                                 F.lit(0).cast("long").alias("position"), F.lit("CATALOG").alias("title"),
                                 F.lit("root").alias("type"))
    type_rows = types.select((F.col("_t") + 1).alias("id"), F.lit(ROOT_ID).cast("long").alias("parent_id"),
                             (F.col("_t") - 1).alias("position"), F.col("p_type").alias("title"),
                             F.lit("type").alias("type"))
    b = rank_in_groups(brands.join(types, "p_type"), ["p_type"], [F.col("p_brand")], "_pos")
    brand_rows = b.select((F.col("_b") + 1 + n_types).alias("id"), (F.col("_t") + 1).alias("parent_id"),
                          (F.col("_pos") - 1).alias("position"), F.col("p_brand").alias("title"),
                          F.lit("brand").alias("type"))
    it = rank_in_groups(p.join(brands, ["p_type", "p_brand"]), ["_b"], [F.col("p_partkey")], "_pos")
    item_rows = it.select((F.col("p_partkey") + 2 + n_types + n_brands).alias("id"),
                          (F.col("_b") + 1 + n_types).alias("parent_id"), (F.col("_pos") - 1).alias("position"),
                          F.col("p_name").alias("title"), F.lit("item").alias("type"))
    return root.unionByName(type_rows).unionByName(brand_rows).unionByName(item_rows)


def localized_titles(tree: DataFrame, titles: DataFrame, lang: str) -> DataFrame:
    """Show the title in ``lang`` when the (id, lang, title) table has one, else the node's own."""
    t = titles.where(F.col("lang") == F.lit(lang)).select("id", F.col("title").alias("_lt"))
    return (tree.join(t, "id", "left").withColumn("title", F.coalesce("_lt", "title"))
                .select(*tree.columns))


def subtree_size(tree: DataFrame) -> Column:
    """Nodes in the subtree (itself included): ``(rgt - lft + 1) / 2``."""
    return ((F.col("rgt") - F.col("lft") + 1) / 2).cast("long")


def is_leaf() -> Column:
    """a leaf has ``rgt - lft = 1``; ``rgt - lft > 1`` has children."""
    return (F.col("rgt") - F.col("lft")) == 1


def children_counts(tree: DataFrame) -> DataFrame:
    """Adjacency children per node (``count(rchildren)``), zero for leaves."""
    n = tree.groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    return tree.select("id").join(n, "id", "left").fillna(0, ["n_children"])


def node_json(tree: DataFrame) -> DataFrame:
    """The widget's JSON view of a node (state from F12: closed when not a leaf)."""
    state = F.when(F.col("rgt") - F.col("lft") > 1, F.lit("closed")).otherwise(F.lit(""))
    js = F.to_json(F.struct(
        F.struct(F.concat(F.lit("node_"), F.col("id").cast("string")).alias("id"),
                 F.col("type").alias("rel")).alias("attr"),
        F.col("title").alias("data"), state.alias("state")))
    return tree.select("id", "parent_id", js.alias("json"))


def dump(tree: DataFrame) -> DataFrame:
    """S7 / H14 + X20: rows in left order with an indented label (``repeat`` + ``concat_ws``)."""
    label = F.concat(F.repeat(F.lit("  "), F.col("level").cast("int")), F.col("id").cast("string"),
                     F.lit(" ("), F.concat_ws(",", *[F.col(c).cast("string") for c in
                                                    ("lft", "rgt", "level", "parent_id", "position")]),
                     F.lit(")"))
    return tree.select("lft", "id", label.alias("line")).orderBy("lft")
