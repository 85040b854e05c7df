"""H18 + G7: an ordered log of tree edits applied as one job.

Edits are a DataFrame (``EDITS``). What an edit does depends on those before it
only through a few facts: which of the nodes *named in the log* exist, which of
them lies under which, and how many children stand before a position. So the
log is folded against the named nodes alone, ``BLOCK`` edits at a time:

* **order keys**: the children of a parent are ranked once. An edit puts its
  node into a gap between two ranks, found by two bisections over the ranks taken out
  and the gaps filled so far; the children themselves are never listed;
* **refusals**: the check (a boolean Column over the log), unknown nodes, and
  cycles, by the path of named ancestors in the state the log prefix has left;
* **one renumbering**: the folded parents and order keys replace those of the
  named nodes, siblings are ranked by their keys (a skew-safe sort of the changed
  parents' children), and the tree is numbered once.

Everything that grows with the tree stays in Spark; what reaches the driver is a
block of the log and one row per node it names.

A block ends early where an edit needs what only the applied tree can tell: an id
inside a copy made by the same block (or a copy as the new parent), a copy of a subtree that the block has
already changed, or the largest id after its holder was removed.

Defined results: edits are ordered by ``seq`` (ties by the other columns);
refused ones are skipped and returned with their reason; removing or renaming an
unknown node does nothing; positions are clamped to the number of other
children; a null position counts as 0, an unknown op is refused.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemicycle.operators.tree import ADJ_COLS, ROOT_ID, number_tree
from hemicycle.plans.ranking import checkpointed, global_rank, rank_in_groups, saved

EDITS = "seq long, op string, id long, ref_id long, position long, title string, type string"
REFUSED = "seq long, op string, id long, ref_id long, reason string"
#: edits folded at once
BLOCK = 20_000

GONE = object()


class _Children:
    """The order of one parent's children: n initial ranks, some taken out, and nodes put into gaps (gap r is before rank r)."""

    def __init__(self, n: int):
        self.n = n
        self.out: list[int] = []  # ranks taken out
        self.filled: list[int] = []  # the gap of every node put in, sorted
        self.gaps: dict[int, list[int]] = {}

    def _before(self, r: int) -> int:
        """Children before gap r's nodes."""
        return r - bisect_left(self.out, r) + bisect_left(self.filled, r)

    def size(self) -> int:
        return self.n - len(self.out) + len(self.filled)

    def insert(self, node: int, position: int) -> int:
        p = min(max(position, 0), self.size())
        lo, hi = 0, self.n  # the first gap with p children up to its end
        while lo < hi:
            mid = (lo + hi) // 2
            if self._before(mid) + bisect_right(self.filled, mid) - bisect_left(self.filled, mid) >= p:
                hi = mid
            else:
                lo = mid + 1
        self.gaps.setdefault(lo, []).insert(p - self._before(lo), node)
        insort(self.filled, lo)
        return lo

    def take_rank(self, r: int) -> None:
        insort(self.out, r)

    def take_node(self, node: int, gap: int) -> None:
        self.gaps[gap].remove(node)
        self.filled.pop(bisect_left(self.filled, gap))


class _Fold:
    """A block of the log applied to the nodes it names; ``info[id]`` is (parent, lft, rgt, rank among its siblings)."""

    def __init__(self, info: dict[int, tuple], counts: dict[int, int], top: int):
        self.info, self.counts, self.top = info, counts, top
        self.max_id = top
        self.above: dict[int, int | None] = {}  # nearest named ancestor as numbered
        stack: list[int] = []
        for i in sorted(info, key=lambda i: info[i][1]):
            while stack and info[stack[-1]][2] < info[i][1]:
                stack.pop()
            self.above[i] = stack[-1] if stack else None
            stack.append(i)
        self.parent: dict = {}  # of every node moved, made or removed by the block
        self.gap: dict[int, int] = {}
        self.children: dict[int, _Children] = {}
        self.made: dict[int, tuple] = {}  # id -> (title, type) of nodes created
        self.copies: dict[int, tuple] = {}  # id of the copy's root -> (source, nodes)
        self.names: dict[int, tuple] = {}
        self.refused: list[tuple] = []

    def _path(self, node: int):
        """Named nodes from ``node`` to its root, or to ``GONE``."""
        while node is not None and node is not GONE:
            yield node
            node = self.parent[node] if node in self.parent else self.above.get(node)
        if node is GONE:
            yield GONE

    def exists(self, node) -> bool:
        return (node in self.info or node in self.parent) and GONE not in list(self._path(node))

    def _of(self, parent: int) -> _Children:
        if parent not in self.children:
            self.children[parent] = _Children(self.counts.get(parent, 0))
        return self.children[parent]

    def _take(self, node: int) -> None:
        if node in self.parent:
            self._of(self.parent[node]).take_node(node, self.gap.pop(node))
        else:
            self._of(self.info[node][0]).take_rank(self.info[node][3])

    def _put(self, node: int, ref: int, position: int) -> None:
        self.gap[node] = self._of(ref).insert(node, position)
        self.parent[node] = ref

    def _needs_copy(self, node, ref) -> bool:
        """Whether an edit names a node inside a copy, or the children of a copy."""
        return any((node is not None and r < node < r + n) or (ref is not None and r <= ref < r + n) for r, (_, n) in self.copies.items())

    def _changed_below(self, node: int) -> bool:
        if node not in self.info:
            return True
        _, lft, rgt, _ = self.info[node]
        return any(z in self.info and lft <= self.info[z][1] <= rgt for z in self.names) or any(
            z != node and ((z in self.info and lft <= self.info[z][1] <= rgt) or node in list(self._path(z))) for z in self.parent)

    def step(self, e, allowed: bool) -> str:
        """'next', 'last' (the block ends after this edit) or 'again' (it ends before it)."""
        op, node, ref, position = e["op"], e["id"], e["ref_id"], e["position"] or 0
        if self._needs_copy(node, ref):
            return "again"
        why = None
        if not allowed:
            why = "refused by check"
        elif op == "rename":
            if self.exists(node):
                old = self.names.get(node, (None, None))
                self.names[node] = tuple(n if n is not None else o for n, o in zip((e["title"], e["type"]), old))
        elif op == "remove":
            if node == ROOT_ID:
                why = "the root cannot be removed"
            elif node is not None and self.exists(node):
                holds_top = node in list(self._path(self.top))
                self._take(node)
                self.parent[node] = GONE
                return "last" if holds_top else "next"
        elif op not in ("create", "move", "copy"):
            why = f"unknown op {op}"
        elif ref == 0:
            why = f"{op} under ref 0 is refused"
        elif op == "move" and node == ROOT_ID:
            why = "moving the root is refused"
        elif not self.exists(ref) or op != "create" and not self.exists(node):
            why = "unknown node or ref"
        elif op != "create" and node in list(self._path(ref)):
            why = "the ref is inside the node's own subtree"
        elif op == "create":
            self.max_id = self.top = self.max_id + 1
            self.made[self.top] = (e["title"], e["type"])
            self._put(self.top, ref, position)
        elif op == "move":
            self._take(node)
            self._put(node, ref, position)
        else:
            if self._changed_below(node):
                return "again"
            root, size = self.max_id + 1, (self.info[node][2] - self.info[node][1] + 1) // 2
            self.copies[root] = (node, size)
            self.max_id, self.top = self.max_id + size, root
            self._put(root, ref, position)
        if why:
            self.refused.append((e["seq"], op, node, ref, why))
        return "next"


def _block_facts(tree: DataFrame, edits: list) -> tuple[_Fold, DataFrame]:
    """The fold's start, and the ranked children of all parents the block may change."""
    spark = tree.sparkSession
    last = tree.select("id").orderBy(F.desc("id")).first()
    named = {v for e in edits for v in (e["id"], e["ref_id"]) if v is not None} | ({last["id"]} if last else set())
    ids = spark.createDataFrame([(v,) for v in sorted(named)], "id long")
    found = saved(tree.join(ids, "id", "left_semi").select("id", "parent_id", "lft", "rgt"))
    parents = found.select("parent_id").union(ids.select("id")).distinct()
    kids = tree.select(*ADJ_COLS).join(parents, "parent_id", "left_semi")
    ranked = saved(rank_in_groups(kids, ["parent_id"], [F.col("position"), F.col("id")], "rank"))
    counts = {r["parent_id"]: r["n"] for r in ranked.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = found.join(ranked.select("id", F.col("rank") - 1), "id").collect()  # the named nodes
    return _Fold({r[0]: tuple(r[1:]) for r in rows}, counts, last["id"] if last else 0), ranked


def _applied(tree: DataFrame, fold: _Fold, ranked: DataFrame) -> DataFrame:
    """The tree with the fold's parents, order keys, nodes and names."""
    spark = tree.sparkSession
    adj = tree.select(*ADJ_COLS)
    seats = [(n, p, g, fold.children[p].gaps[g].index(n)) for n, p in fold.parent.items() if p is not GONE for g in (fold.gap[n],)]
    seat = spark.createDataFrame(seats, "id long, to long, k1 long, k3 long")
    gone = spark.createDataFrame([(n,) for n in fold.parent], "id long")
    changed = spark.createDataFrame([(p,) for p in fold.children], "parent_id long")
    keys = [F.col("k1"), F.lit(0).alias("k2"), F.col("k3")]
    stay = ranked.join(changed, "parent_id", "left_semi").join(gone, "id", "left_anti").select(
        *ADJ_COLS, (F.col("rank") - 1).alias("k1"), F.lit(1).alias("k2"), F.lit(0).cast("long").alias("k3"))
    made = spark.createDataFrame([(n, *v) for n, v in fold.made.items()], "id long, title string, type string")
    sources = spark.createDataFrame([(r, s) for r, (s, _) in fold.copies.items()], "root long, source long")
    roots = sources.join(adj, adj["id"] == sources["source"]).select(F.col("root").alias("id"), "title", "type")
    body = adj.select("id", "title", "type").join(gone, "id", "left_semi").unionByName(made).unionByName(roots)
    moved = seat.join(body, "id").select("id", F.col("to").alias("parent_id"), F.col("k1").alias("position"), "title", "type", *keys)
    seated = rank_in_groups(stay.unionByName(moved), ["parent_id"], ["k1", "k2", "k3"], "rank")
    seated = seated.withColumn("position", F.col("rank") - 1).select(*ADJ_COLS)
    out = adj.join(changed, "parent_id", "left_anti").join(gone, "id", "left_anti").select(*ADJ_COLS).unionByName(seated)
    for root, (source, _) in fold.copies.items():
        top = tree.where(F.col("id") == source).first()
        inner = tree.where((F.col("lft") > top["lft"]) & (F.col("rgt") < top["rgt"]))
        inner = saved(global_rank(inner, ["level", "id"], "r").withColumn("new", F.lit(root) + F.col("r")))
        up = inner.select(F.col("id").alias("parent_id"), F.col("new").alias("to"))
        out = out.unionByName(inner.join(up, "parent_id", "left").select(
            F.col("new").alias("id"), F.coalesce("to", F.lit(root)).alias("parent_id"), "position", "title", "type"))
    if fold.names:
        names = spark.createDataFrame([(n, *v) for n, v in fold.names.items()], "id long, t string, y string")
        out = (out.join(names, "id", "left").withColumn("title", F.coalesce("t", "title"))
               .withColumn("type", F.coalesce("y", "type")).select(*ADJ_COLS))
    return number_tree(out)


def apply_edits(tree: DataFrame, edits: DataFrame | list[dict], check: Column | None = None) -> DataFrame:
    """The numbered tree after all edits; ``_refused`` of the result is the frame (``REFUSED``) of those skipped.

    ``check`` may refuse an edit: a boolean Column over the log, with the rows its node and ref have in ``tree`` as
    structs ``node`` and ``ref``; only false refuses.
    """
    spark = tree.sparkSession
    if isinstance(edits, list):
        names = [c.split()[0] for c in EDITS.split(", ")]
        edits = spark.createDataFrame([tuple({**e, "seq": i}.get(c) for c in names) for i, e in enumerate(edits)], EDITS)
    log = global_rank(edits, edits.columns, "at")
    if check is not None:
        row = F.struct(*tree.columns)
        log = (log.join(tree.select(F.col("id").alias("id"), row.alias("node")), "id", "left")
               .join(tree.select(F.col("id").alias("ref_id"), row.alias("ref")), "ref_id", "left"))
    log = saved(log.withColumn("allowed", F.lit(True) if check is None else F.coalesce(check, F.lit(True)))
                .withColumn("block", F.floor((F.col("at") - 1) / BLOCK)).drop("node", "ref"))
    tree = saved(tree)
    refused = spark.createDataFrame([], REFUSED)
    for b in range((log.agg(F.max("block")).first()[0] if not log.isEmpty() else -1) + 1):
        rest = log.where(F.col("block") == b).orderBy("at").collect()  # at most BLOCK rows
        while rest:
            fold, ranked = _block_facts(tree, rest)
            done = 0
            for e in rest:
                what = fold.step(e, e["allowed"])
                done += what != "again"
                if what != "next":
                    break
            rest = rest[done:]
            if fold.refused:
                refused = refused.unionByName(spark.createDataFrame(fold.refused, REFUSED))
            if fold.parent or fold.names:
                tree = checkpointed(_applied(tree, fold, ranked))
    tree._refused = refused  # type: ignore[attr-defined]
    return tree
