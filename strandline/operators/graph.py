"""Graph operators on edges (src, dst) or triples (h, r, t): walks, layers, reachability, nearest tops, propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.loops import checkpointed
from strandline.operators.relations import numbered


def walks(seeds: DataFrame, triples: DataFrame, hops: int) -> DataFrame:
    """Every walk of at most `hops` steps from the seeds: (root, relations, id, depth, via). Nodes may repeat."""
    step = triples.select(F.col("h").alias("via"), "r", F.col("t").alias("next"))
    at = seeds.select(F.col("entity").alias("root"), F.array().cast("array<string>").alias("relations"), F.col("entity").alias("id"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via"))
    out = at
    for depth in range(1, hops + 1):
        at = at.select("root", "relations", F.col("id").alias("via")).join(step, "via").select(
            "root", F.concat("relations", F.array("r")).alias("relations"), F.col("next").alias("id"), F.lit(depth).alias("depth"), "via"
        )
        out = out.unionByName(at)
    return out


def one_hop(walked: DataFrame) -> DataFrame:
    """Edges of depth one: (root, r, t)."""
    return walked.where("depth = 1").select("root", F.try_element_at("relations", F.lit(-1)).alias("r"), F.col("id").alias("t"))


def layers(edges: DataFrame) -> DataFrame:
    """Layer of each node: one more than its highest source's. Nodes on cycles, and after them, have none and are absent (see `layers_of_all`)."""
    edges = checkpointed(edges.select("src", "dst").distinct())
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    left = checkpointed(edges.select(F.col("dst").alias("node"), "src"))
    layer = checkpointed(nodes.join(left.select("node"), "node", "left_anti"))
    done, depth, waiting = layer.withColumn("layer", F.lit(0)), 0, checkpointed(nodes.join(layer, "node", "left_anti"))
    while layer.limit(1).count():
        depth += 1
        left = checkpointed(left.join(layer.select(F.col("node").alias("src")), "src", "left_anti").select("node", "src"))
        layer = checkpointed(waiting.join(left.select("node"), "node", "left_anti"))
        waiting = checkpointed(waiting.join(layer, "node", "left_anti"))
        done = done.unionByName(layer.withColumn("layer", F.lit(depth)))
    return done


def layers_of_all(edges: DataFrame) -> DataFrame:
    """Layers as in `layers`; a node that stays without one, on a cycle or after it, takes that of the nearest node above that has one plus its distance.

    The search goes up through other nodes without a layer, too. Of several equally near, the lowest layer counts most; 0 where there is none.
    """
    edges = checkpointed(edges.select("src", "dst").distinct())
    known = checkpointed(layers(edges))
    rest = checkpointed(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(known, "node", "left_anti"))
    inner = checkpointed(edges.join(rest.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    last, found, distance = known.select("node", "layer"), None, 0
    while True:
        distance += 1
        below = inner.join(last.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("layer").alias("layer"))
        last = checkpointed(below if found is None else below.join(found.select("node"), "node", "left_anti"))
        placed = last.withColumn("at", F.col("layer") + distance)
        found = checkpointed(placed if found is None else found.unionByName(placed))
        if not last.limit(1).count():
            break
    cyclic = rest.join(found, "node", "left").select("node", F.coalesce("at", F.lit(0)).alias("layer"), F.lit(True).alias("cyclic"))
    return known.withColumn("cyclic", F.lit(False)).unionByName(cyclic)


def top_nodes(edges: DataFrame, most: int = 1000, levels: int = 2) -> DataFrame:
    """Roots of (child, parent) and their descendants of at most `levels` levels, fewer levels while there would be `most` nodes or more: (node)."""
    roots = edges.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")), "node", "left_anti")
    found = [checkpointed(roots)]
    for _ in range(levels):
        below = found[-1].join(edges, F.col("node") == F.col("parent")).select(F.col("child").alias("node"))
        found.append(checkpointed(found[-1].unionByName(below).distinct()))
    for nodes in reversed(found):
        if nodes.count() < most:
            return nodes
    return found[0]


def attached_instances(instances: DataFrame, placed: DataFrame) -> DataFrame:
    """The top node of each instance (entity, node): that of the first of its types, by name, that has one; -1 if none: (entity, top)."""
    tops = placed.where("top is not null").select("node", "top")
    met = instances.join(tops, "node", "left").groupBy("entity").agg(F.min_by("top", F.when(F.col("top").isNotNull(), F.col("node"))).alias("top"))
    return met.select("entity", F.coalesce("top", F.lit("-1")).alias("top"))


def reachable(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """Entities and pages that seeds reach by alternating links (page, entity): rows (node, rounds)."""
    links = checkpointed(links.select("page", "entity").distinct())
    frontier = checkpointed(seeds.select(F.col("entity").alias("node")).distinct())
    found, n = checkpointed(frontier.withColumn("rounds", F.lit(0))), 0
    while frontier.limit(1).count():
        n += 1
        pages = links.join(frontier.select(F.col("node").alias("entity")), "entity", "left_semi").select("page").distinct()
        frontier = checkpointed(links.join(pages, "page", "left_semi").select(F.col("entity").alias("node")).distinct().join(found.select("node"), "node", "left_anti"))
        found = checkpointed(found.unionByName(frontier.withColumn("rounds", F.lit(n))))
    return found


def ancestors_until_root(seeds: DataFrame, parents: DataFrame, roots: DataFrame) -> DataFrame:
    """Each seed's ancestors, layer by layer until none is new; a seed stops before the first layer that holds a root: rows (seed, node)."""
    up = parents.select(F.col("child").alias("node"), F.col("parent").alias("above"))
    found = checkpointed(seeds.select(F.col("node").alias("seed"), "node"))
    layer = found
    while True:
        nxt = layer.join(up, "node").select("seed", F.col("above").alias("node")).distinct().join(found, ["seed", "node"], "left_anti")
        stopped = nxt.join(roots, "node", "left_semi").select("seed").distinct()
        layer = checkpointed(nxt.join(stopped, "seed", "left_anti"))
        if not layer.limit(1).count():
            return found
        found = checkpointed(found.unionByName(layer))


def nearest_top(nodes: DataFrame, parents: DataFrame, tops: DataFrame) -> DataFrame:
    """Nearest of some top nodes above each node: (node, top, depth), ties to the smaller top; top is null and depth -1 without one."""
    up = parents.select(F.col("child").alias("node"), F.col("parent").alias("above")).distinct()
    found = checkpointed(tops.select("node", F.col("node").alias("top"), F.lit(0).alias("depth")))
    last, depth = found, 0
    while last.limit(1).count():
        depth += 1
        nxt = up.join(last.select(F.col("node").alias("above"), "top"), "above").groupBy("node").agg(F.min("top").alias("top"))
        last = checkpointed(nxt.join(found.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        found = checkpointed(found.unionByName(last))
    return nodes.select("node").distinct().join(found, "node", "left").select("node", "top", F.coalesce("depth", F.lit(-1)).alias("depth"))


def propagated(edges: DataFrame, values: DataFrame) -> DataFrame:
    """One step of symmetric normalised propagation with self loops: sum of x(u) / sqrt(d(u) d(v)) over v's neighbours and v."""
    # Links are dealt by source once: repeats go, degrees are counted and values met where they lie. Loops are one a node and go beside them.
    apart = edges.select("src", "dst").where("src <> dst")
    links = apart.unionAll(apart.select("dst", "src")).repartition("src").distinct()
    own = values.groupBy("node").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("loops"))
    near = links.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("links"))
    known = checkpointed(near.join(own, "node", "full").select("node", "x", "loops", (F.coalesce("links", F.lit(0)) + F.coalesce("loops", F.lit(0))).alias("d")))
    met = links.join(known.where("loops > 0").select(F.col("node").alias("src"), "x", F.col("d").alias("d_src")), "src")
    sent = met.join(known.select(F.col("node").alias("dst"), "d"), "dst").select(F.col("dst").alias("node"), (F.col("x") / F.sqrt(F.col("d") * F.col("d_src"))).alias("x"))
    loops = known.where("loops > 0").select("node", (F.col("loops") * F.col("x") / F.sqrt(F.col("d") * F.col("d"))).alias("x"))
    return sent.unionByName(loops).groupBy("node").agg(F.sum("x").alias("x"))


def edge_features(occs: DataFrame, triples: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Typed edges of each occurrence's surroundings: its pair, and the triples of head and tail under other relations.

    With `roots` (entity), the entities whose surroundings were read, an occurrence with another entity raises.
    """
    if roots is not None:
        ends = occs.select(F.explode(F.array("h", "t")).alias("entity")).distinct()
        missing = ends.join(roots.select("entity").distinct(), "entity", "left_anti").orderBy("entity").limit(3).collect()
        if missing:
            raise ValueError(f"no surroundings were read for {', '.join(r.entity for r in missing)}")
    pair = occs.select("pid", F.lit("one").alias("kind"), F.col("h").alias("src"), F.col("t").alias("dst")).distinct()
    # One row for each two entities, with the first and the last of their relations: of two that differ one is not the occurrence's. So no edge comes twice.
    other = triples.where("r is not null").select(F.col("h").alias("e"), F.col("t").alias("o"), "r").repartition("e").groupBy("e", "o").agg(F.min("r").alias("first"), F.max("r").alias("last"))
    sides = F.inline(F.array(F.struct(F.lit("head").alias("kind"), F.col("h").alias("e")), F.struct(F.lit("tail").alias("kind"), F.col("t").alias("e"))))
    ends = occs.select("pid", sides).distinct()
    around = ends.join(other, "e").where("first <> pid or last <> pid").select("pid", "kind", F.col("e").alias("src"), F.col("o").alias("dst"))
    return pair.unionByName(around)


def id_frequency(edges: DataFrame, sample: str = "pid") -> DataFrame:
    """Samples that each id occurs in, with an index by descending frequency, then id: (id, samples, ind)."""
    ids = edges.select(sample, F.explode(F.array("src", "dst")).alias("id")).distinct().groupBy("id").agg(F.count(F.lit(1)).alias("samples"))
    return numbered_by_count(ids, "id", "samples")


def numbered_by_count(df: DataFrame, key: str, count: str) -> DataFrame:
    """An index from 0 by descending count, then key. Counts repeat, so the table of counts is small; keys are numbered within one, those of a large one in ranges."""
    levels = df.groupBy(count).agg(F.count(F.lit(1)).alias("keys"))
    before = F.coalesce(F.sum("keys").over(Window.orderBy(F.desc(count)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = levels.select(count, before.alias("before"))
    sizes = levels.select(F.col(count).alias("pid"), F.col("keys").alias("n"))
    return numbered(df.withColumn("pid", F.col(count)), sizes, [key], "_nth").drop("pid").join(placed, count).withColumn("ind", F.col("before") + F.col("_nth") - 1).drop("_nth", "before")
