"""Hierarchies of relations: closure, leaves, heights, pruning and bottom-up unions. Edges are (parent, child, pos)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.loops import checkpointed, few


def closure(edges: DataFrame) -> DataFrame:
    """Every (anc, des, depth, paths): how many paths of each length lead from an ancestor down. A cycle raises.

    A path without a cycle has fewer steps than there are nodes, which bounds the rounds. Each round joins the last round's paths with the edges; counts stay aggregated, so shared children don't multiply rows.
    """
    step = edges.select(F.col("parent").alias("up"), F.col("child").alias("down"))
    level = checkpointed(step.groupBy(F.col("up").alias("anc"), F.col("down").alias("des")).agg(F.count(F.lit(1)).alias("paths")))
    found, depth = level.withColumn("depth", F.lit(1)), 1
    nodes = edges.select(F.explode(F.array("parent", "child"))).distinct().count()
    while level.limit(1).count():
        if depth >= nodes:
            raise ValueError("the hierarchy has a cycle")
        depth += 1
        level = checkpointed(level.join(step, level.des == step.up).groupBy("anc", F.col("down").alias("des")).agg(F.sum("paths").alias("paths")))
        found = found.unionByName(level.withColumn("depth", F.lit(depth)))
    return found.select("anc", "des", "depth", "paths")


def siblings(edges: DataFrame) -> DataFrame:
    """Distinct ordered pairs of children of one parent."""
    a, b = edges.select("parent", F.col("child").alias("a")), edges.select("parent", F.col("child").alias("b"))
    return a.join(b, "parent").where("a <> b").select("a", "b").distinct()


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that are no child, and whether they are isolated (no parent either)."""
    parents = edges.select(F.col("parent").alias("pid"), F.lit(False).alias("isolated")).distinct()
    top = nodes.join(edges.select(F.col("child").alias("pid")), "pid", "left_anti")
    return top.join(parents, "pid", "left").select("pid", F.coalesce("isolated", F.lit(True)).alias("isolated"))


def shape(nodes: DataFrame, closed: DataFrame) -> DataFrame:
    """Height, number of descendants and leaf flag of each node."""
    own = closed.groupBy(F.col("anc").alias("pid")).agg(F.max("depth").alias("height"), F.countDistinct("des").alias("descendants"))
    out = nodes.join(own, "pid", "left")
    return out.select("pid", F.coalesce("height", F.lit(0)).alias("height"), F.coalesce("descendants", F.lit(0)).alias("descendants"), F.col("height").isNull().alias("leaf"))


def depths(nodes: DataFrame, closed: DataFrame) -> DataFrame:
    """Greatest depth of each node below a root; roots have 0."""
    deep = closed.groupBy(F.col("des").alias("pid")).agg(F.max("depth").alias("depth"))
    return nodes.join(deep, "pid", "left").select("pid", F.coalesce("depth", F.lit(0)).alias("depth"))


def deepest_parent_only(edges: DataFrame, nodes: DataFrame, closed: DataFrame) -> DataFrame:
    """Each child with its deepest parent alone; ties go to the smaller parent."""
    placed = edges.join(depths(nodes, closed).select(F.col("pid").alias("parent"), "depth"), "parent")
    nth = F.row_number().over(Window.partitionBy("child").orderBy(F.desc("depth"), "parent"))
    return placed.withColumn("nth", nth).where("nth = 1").select("parent", "child")


def pruned(edges: DataFrame, closed: DataFrame, gone: list[str]) -> DataFrame:
    """Edges without the named nodes and everything below them."""
    below = closed.where(F.col("anc").isin(gone)).select(F.col("des").alias("pid"))
    nodes = below.unionAll(edges.select(F.explode(F.array("parent", "child")).alias("pid")).where(F.col("pid").isin(gone))).distinct()
    return edges.join(nodes, edges.child == nodes.pid, "left_anti").join(nodes, edges.parent == nodes.pid, "left_anti").select("parent", "child")


def populated(occs: DataFrame, edges: DataFrame, cut: list[str] = ()) -> DataFrame:
    """Distinct pairs of each node and all below it; edges into the nodes in `cut` are not followed."""
    followed = edges.where(~F.col("child").isin(list(cut))) if cut else edges
    below = few(closure(followed).select(F.col("anc"), F.col("des").alias("pid")).distinct())
    up = occs.join(below, "pid").select(F.col("anc").alias("pid"), "h", "t")
    return occs.select("pid", "h", "t").unionByName(up).distinct()


def populated_counts(counts: DataFrame, closed: DataFrame) -> DataFrame:
    """Counts (pid, key, cnt) of each node and of all below it, once for each path down."""
    ways = closed.groupBy("anc", F.col("des").alias("pid")).agg(F.sum("paths").alias("paths"))
    up = counts.join(ways, "pid").select(F.col("anc").alias("pid"), "key", (F.col("cnt") * F.col("paths")).alias("cnt"))
    return counts.select("pid", "key", "cnt").unionByName(up).groupBy("pid", "key").agg(F.sum("cnt").alias("cnt"))


def subtree_lines(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each node with its children in order, joined by commas; nodes without children too."""
    own = edges.groupBy(F.col("parent").alias("pid")).agg(F.array_join(F.array_sort(F.collect_set("child")), ",").alias("children"))
    return nodes.join(own, "pid", "left").select("pid", F.coalesce("children", F.lit("")).alias("children"))


def _drawn(seed: str, pid: Column, below: str) -> Column:
    """Whether a pair (h, t) of a node falls into a share of all, by the first eight hexadecimal digits of a hash: '80000000' is a half."""
    return F.substring(F.md5(F.concat_ws("|", F.lit(seed), pid, "h", "t")), 1, 8) < below


def _by_pair(occs: DataFrame) -> DataFrame:
    """The nodes that hold each pair, as a sorted set: (h, t, pids)."""
    return occs.groupBy("h", "t").agg(F.array_sort(F.flatten(F.collect_set(F.array("pid")))).alias("pids"))


def _planned(occs: DataFrame, sets: DataFrame, nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Pairs with what is known of their nodes and all nodes above: (h, t, pids, plan); `nodes` (pid, node) has a struct a node, whose order is the plan's, `ways` (pid, anc) what is above."""
    at = sets.select("pids", F.explode("pids").alias("pid"))
    every = at.unionByName(at.join(ways, "pid").select("pids", F.col("anc").alias("pid"))).distinct()
    plans = few(every.join(nodes, every.pid.eqNullSafe(nodes.pid)).groupBy("pids").agg(F.array_sort(F.collect_list("node")).alias("plan")))
    return _by_pair(occs).join(plans, "pids")


def _parents(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("child").alias("pid")).agg(F.array_sort(F.collect_list("parent")).alias("parents"))


def _nodes(sets: DataFrame, edges: DataFrame) -> DataFrame:
    return sets.select(F.explode("pids").alias("pid")).unionByName(edges.select(F.explode(F.array("parent", "child")).alias("pid"))).distinct()


def completed_bottom_up(occs: DataFrame, edges: DataFrame, with_own: bool = False, seed: str = "third") -> DataFrame:
    """Occurrences (pid, h, t) for inner nodes, out of their children's: a third of the children's union, by hash, moves up and leaves them.

    Nodes of one height draw at once from what the levels below left, so a child of two such parents loses what either takes. A node's
    own occurrences count for leaves, and with `with_own` join what an inner node took. Pairs don't depend on each other: each goes through the
    nodes above its own in one row, which is as long as they are.
    """
    edges = checkpointed(edges.select("parent", "child").distinct())
    closed = checkpointed(closure(edges))
    sets = checkpointed(_by_pair(occs).select("pids").distinct())
    height = closed.groupBy(F.col("anc").alias("pid")).agg(F.max("depth").alias("height"))
    known = _nodes(sets, edges).join(height, "pid", "left").join(_parents(edges), "pid", "left")
    known = known.select("pid", F.struct(F.coalesce("height", F.lit(0)).alias("height"), "pid", F.coalesce("parents", F.array().cast("array<string>")).alias("parents")).alias("node"))
    planned = _planned(occs, sets, known, closed.select(F.col("des").alias("pid"), "anc").distinct())
    own = lambda x: F.exists("pids", lambda p: p.eqNullSafe(x["pid"]))

    def step(held: Column, level: Column) -> Column:
        below = F.flatten(F.transform(held, lambda c: c["parents"]))
        taken = F.filter("plan", lambda x: (x["height"] == level) & F.array_contains(below, x["pid"]) & _drawn(seed, x["pid"], "55555555"))
        new = F.array_union(taken, F.filter("plan", lambda x: (x["height"] == level) & own(x))) if with_own else taken
        return F.concat(F.filter(held, lambda c: ~F.arrays_overlap(c["parents"], F.transform(taken, lambda x: x["pid"]))), new)

    levels = F.filter(F.array_distinct(F.transform("plan", lambda x: x["height"])), lambda x: x > 0)
    held = F.aggregate(levels, F.filter("plan", lambda x: (x["height"] == 0) & own(x)), step)
    return planned.select(F.explode(F.transform(held, lambda x: x["pid"])).alias("pid"), "h", "t")


def completed_top_down(occs: DataFrame, edges: DataFrame, seed: str = "half") -> DataFrame:
    """Occurrences (pid, h, t) of each node and all below it, without overlap between a node and what is above it.

    From the roots on, a node keeps a half of what it may hold, by hash, and passes the rest; its children may hold only what all their
    parents passed, and leaves keep that whole. Nodes are done by their greatest depth, after all their parents. A parent that never held
    anything doesn't restrict its children. Pairs don't depend on each other: each goes through its nodes and those above in one row.
    """
    edges = checkpointed(edges.select("parent", "child").distinct())
    closed = checkpointed(closure(edges))
    ways = closed.select(F.col("des").alias("pid"), "anc").distinct()
    sets = checkpointed(_by_pair(occs).select("pids").distinct())
    at = sets.select(F.explode("pids").alias("pid")).distinct()
    held = at.unionByName(at.join(ways, "pid").select(F.col("anc").alias("pid"))).distinct()
    above = edges.join(held.withColumnRenamed("pid", "parent"), "parent", "left_semi")
    inner = edges.select(F.col("parent").alias("pid"), F.lit(True).alias("inner")).distinct()
    depth = closed.groupBy(F.col("des").alias("pid")).agg(F.max("depth").alias("depth"))
    known = _nodes(sets, edges).join(depth, "pid", "left").join(inner, "pid", "left").join(_parents(above), "pid", "left")
    known = known.select("pid", F.struct(F.coalesce("depth", F.lit(0)).alias("depth"), "pid", F.coalesce("inner", F.lit(False)).alias("inner"), F.coalesce("parents", F.array().cast("array<string>")).alias("parents")).alias("node"))
    drawn = F.transform("plan", lambda x: F.struct(x["pid"].alias("pid"), x["parents"].alias("parents"), (~x["inner"] | _drawn(seed, x["pid"], "80000000")).alias("keeps")))
    none = F.array().cast("array<string>")

    def step(done: Column, x: Column) -> Column:
        may = F.size(F.array_except(x["parents"], done["passed"])) == 0
        added = lambda to, when: F.when(may & when, F.concat(done[to], F.array(x["pid"]))).otherwise(done[to]).alias(to)
        return F.struct(added("kept", x["keeps"]), added("passed", ~x["keeps"]))

    kept = F.aggregate(drawn, F.struct(none.alias("kept"), none.alias("passed")), step)["kept"]
    return _planned(occs, sets, known, ways).select(F.explode(kept).alias("pid"), "h", "t")


def statistics(edges: DataFrame) -> DataFrame:
    """One row: parents, their children, and ordered pairs of siblings, n (n - 1) a parent."""
    own = edges.select("parent", "child").distinct().groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
    return own.agg(F.count(F.lit(1)).alias("parents"), F.coalesce(F.sum("n"), F.lit(0)).alias("children"), F.coalesce(F.sum(F.col("n") * (F.col("n") - 1)), F.lit(0)).alias("sibling_pairs"))
