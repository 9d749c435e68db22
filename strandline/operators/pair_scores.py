"""Scores of relation pairs over all pairs of their occurrences' vectors, in blocks, and the ranking of relations by them.

Rows are (pid, id, vec). Each relation's vectors are dealt into blocks of a few hundred; two blocks meet in one task as matrices, and
only a number for each child and parent block leaves it. No occurrence is left out, and no relation is held in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import metrics as M
from strandline.operators import vectors as V

BLOCK_ROWS, BLOCKS_IN_CELL = 512, 64


def all_pairs(rows: DataFrame) -> DataFrame:
    """Every ordered pair of different relations: (p1, p2). Relations number in the hundreds."""
    names = rows.agg(F.collect_set("pid").alias("all"))
    one = names.select(F.explode("all").alias("p1"), "all")
    return one.select("p1", F.explode("all").alias("p2")).where("p1 <> p2")


def blocks(rows: DataFrame, size: int = BLOCK_ROWS) -> DataFrame:
    """The relations' vectors in blocks of about `size`: (pid, ids, data), data being the vectors one after the other."""
    counts = rows.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    dealt = rows.join(counts, "pid").withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / size)))
    held = dealt.groupBy("pid", "block").agg(F.collect_list(F.struct("id", F.col("vec").cast("array<double>").alias("vec"))).alias("rows"))
    return held.select("pid", F.transform("rows", lambda r: r["id"]).alias("ids"), F.flatten(F.transform("rows", lambda r: r["vec"])).alias("data"))


def _met(children: np.ndarray, parents: list[np.ndarray], scale: float) -> tuple[int, np.ndarray, np.ndarray]:
    """Parents met, each child's sum of distances to them, and ln of its sum of exp(-d2 / scale)."""
    met, distance, kernel = 0, np.zeros(len(children)), np.full(len(children), -np.inf)
    own = (children * children).sum(axis=1)[:, None]
    for y in parents:
        d2 = np.maximum(own + (y * y).sum(axis=1)[None, :] - 2 * children @ y.T, 0)
        low = d2.min(axis=1)
        met, distance = met + len(y), distance + np.sqrt(d2).sum(axis=1)
        kernel = np.logaddexp(kernel, np.log(np.exp((low[:, None] - d2) / scale).sum(axis=1)) - low / scale)
    return met, distance, kernel


def _cells(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """Of each cell the parents' blocks come first and are held; then each child block meets those it is wanted for."""
    key: tuple | None = None
    held: dict[str, list[np.ndarray]] = {}
    for batch in batches:
        for row in range(batch.num_rows):
            at = (batch.column("r")[row].as_py(), batch.column("c")[row].as_py())
            if at != key:
                key, held = at, {}
            pid, ids = batch.column("pid")[row].as_py(), batch.column("ids")[row].values
            x = np.asarray(batch.column("data")[row].values, dtype=np.float64).reshape(len(ids), -1)
            if not batch.column("side")[row].as_py():
                held.setdefault(pid, []).append(x)
                continue
            for other in batch.column("wanted")[row].as_py():
                if other in held:
                    met, distance, kernel = _met(x, held[other], scale)
                    n = len(ids)
                    yield pa.record_batch([pa.array([pid] * n), pa.array([other] * n), ids, pa.array(np.full(n, met)), pa.array(distance), pa.array(kernel)], ["p1", "p2", "c", "met", "distance", "kernel"])


def child_scores(rows: DataFrame, pairs: DataFrame, scale: float) -> DataFrame:
    """For each pair (p1: child, p2: parent) and occurrence c of the child: parents met, the sum of its distances to them, and ln sum exp(-d2 / scale).

    Blocks meet on a grid: a block stands in one row of cells as children and in one column as parents, so a vector travels as often as the grid
    is long, which is the root of the number of cells. A cell holds some sixty parent blocks, and gives one number a child and parent.
    """
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    counts = rows.groupBy("pid").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("n"))
    side = max(math.ceil((counts.agg(F.sum("n")).first()[0] or 0) / BLOCKS_IN_CELL), math.ceil(math.sqrt(parallel)))
    held = blocks(rows).withColumn("own", F.pmod(F.xxhash64("pid", "ids"), F.lit(side)))
    every = F.explode(F.sequence(F.lit(0), F.lit(side - 1)).cast("array<bigint>"))
    wanted = pairs.groupBy(F.col("p1").alias("pid")).agg(F.collect_set("p2").alias("wanted"))
    children = held.join(wanted, "pid").select(F.col("own").alias("r"), every.alias("c"), F.lit(1).alias("side"), "pid", "ids", "data", "wanted")
    parents = held.join(pairs.select(F.col("p2").alias("pid")).distinct(), "pid", "left_semi").select(every.alias("r"), F.col("own").alias("c"), F.lit(0).alias("side"), "pid", "ids", "data", F.lit(None).cast("array<string>").alias("wanted"))
    cells = parents.unionByName(children).repartition("r", "c").sortWithinPartitions("r", "c", "side")
    each = cells.mapInArrow(lambda b: _cells(b, scale), "p1 string, p2 string, c long, met long, distance double, kernel double")
    most = F.array_max("kernels")
    summed = each.groupBy("p1", "p2", "c").agg(F.sum("met").alias("met"), F.sum("distance").alias("distance"), F.collect_list("kernel").alias("kernels"))
    return summed.select("p1", "p2", "c", "met", "distance", (most + F.log(F.aggregate("kernels", F.lit(0.0), lambda s, k: s + F.exp(k - most)))).alias("kernel"))


def euclidean_mean(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Negative mean distance of all pairs of occurrences."""
    return child_scores(rows, pairs, 1.0).groupBy("p1", "p2").agg((-F.sum("distance") / F.sum("met")).alias("score"))


def expected_exponential(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mean over children of ln(mean over parents of exp(-d2))."""
    return child_scores(rows, pairs, 1.0).groupBy("p1", "p2").agg(F.avg(F.col("kernel") - F.log("met")).alias("score"))


def gaussian_mixture(rows: DataFrame, pairs: DataFrame, dims: int, variance: float = 1.0) -> DataFrame:
    """Log-likelihood of one relation's occurrences under equal Gaussians at the other's."""
    constant = -0.5 * dims * math.log(2 * math.pi * variance)
    return child_scores(rows, pairs, 2 * variance).groupBy("p1", "p2").agg(F.sum(F.col("kernel") - F.log("met") + constant).alias("score"))


def kernel_divergence(rows: DataFrame, pairs: DataFrame, dims: int, bandwidth: float) -> DataFrame:
    """Negative divergence of the parent's kernel density from the child's, at the child's occurrences; the kernel is a Gaussian."""
    constant = -0.5 * dims * math.log(2 * math.pi) - dims * math.log(bandwidth)
    own_pairs = pairs.select("p1").distinct().select("p1", F.col("p1").alias("p2"))
    density = child_scores(rows, pairs.select("p1", "p2").unionByName(own_pairs), 2 * bandwidth**2).withColumn("ln", F.col("kernel") - F.log("met") + constant)
    own = density.where("p1 = p2").select("p1", "c", F.col("ln").alias("own"))
    return density.where("p1 <> p2").join(own, ["p1", "c"]).groupBy("p1", "p2").agg((-F.sum(F.exp("own") * (F.col("own") - F.col("ln")))).alias("score"))


def drawn(rows: DataFrame, top: int | None, seed: int = 0) -> DataFrame:
    """At most `top` occurrences of each relation in an order by the hash of seed and id; all of them without a bound."""
    if top is None:
        return rows
    nth = F.row_number().over(Window.partitionBy("pid").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id"))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= top).drop("_nth")


def pair_vectors(occs: DataFrame, entities: DataFrame, minus: bool = False, unit: bool = False) -> DataFrame:
    """Vectors (pid, id, vec) of occurrences (pid, h, t) of which both entities (entity, vec) have one: head and tail in a row, or their difference."""
    side = lambda s: entities.select(F.col("entity").alias(s), F.col("vec").cast("array<double>").alias(f"v_{s}"))
    both = occs.join(side("h"), "h").join(side("t"), "t")
    vec = F.zip_with("v_h", "v_t", lambda a, b: a - b) if minus else F.concat("v_h", "v_t")
    out = both.select("pid", F.xxhash64("h", "t").alias("id"), vec.alias("vec"))
    return out.withColumn("vec", F.transform("vec", lambda x: x / (V.norm(F.col("vec")) + 1e-10))) if unit else out


METHODS = {
    "cosine": lambda rows, pairs, **_: V.pairwise_cosine(rows),
    "mean_cosine": lambda rows, pairs, **_: V.mean_scores(rows).select("p1", "p2", F.col("cosine").alias("score")),
    "mean_distance": lambda rows, pairs, **_: V.mean_scores(rows).select("p1", "p2", F.col("distance").alias("score")),
    "mean_dot": lambda rows, pairs, **_: V.mean_scores(rows).select("p1", "p2", F.col("dot").alias("score")),
    "euc": lambda rows, pairs, **_: euclidean_mean(rows, pairs),
    "expeuc": lambda rows, pairs, **_: expected_exponential(rows, pairs),
    "mixgau": lambda rows, pairs, dims=0, sigma=1.0: gaussian_mixture(rows, pairs, dims, sigma),
    "kde": lambda rows, pairs, dims=0, sigma=1.0: kernel_divergence(rows, pairs, dims, sigma),
}


def ranked_labels(
    rows: DataFrame, props: DataFrame, labels: DataFrame, parents: DataFrame, ancestors: DataFrame, method: str = "cosine", top: int | None = None, least: int = 1, seed: int = 0, **more: float
) -> DataFrame:
    """Labels ranked for each property by a score of METHODS: (p1, rank, p2, score, rel), rel being parent, ancestor or *.

    Properties and labels (pid) need `least` occurrences, and a property a parent among the labels. `top` draws so many occurrences of each;
    the default is all. A label is never ranked for itself; ties go to the smaller label.
    """
    known = rows.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("pid")
    label = labels.select("pid").distinct().join(known, "pid", "left_semi")
    prop = props.select("pid").distinct().join(known, "pid", "left_semi")
    held = parents.join(label.select(F.col("pid").alias("p2")), "p2", "left_semi").select(F.col("p1").alias("pid"))
    prop = prop.join(held, "pid", "left_semi")
    everyone = label.agg(F.collect_set("pid").alias("all"))
    pairs = prop.select(F.col("pid").alias("p1")).crossJoin(F.broadcast(everyone)).select("p1", F.explode("all").alias("p2")).where("p1 <> p2")
    scores = METHODS[method](drawn(rows, top, seed), pairs, **more).join(pairs, ["p1", "p2"], "left_semi")
    return M.tagged_ranks(scores, parents, ancestors)


def leaking_pairs(occs: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Pairs (anc, des, common) of an ancestor and a descendant that share distinct occurrences (pid, h, t)."""
    own = occs.select("pid", "h", "t").distinct()
    above = own.join(ancestors.select("anc", F.col("des").alias("pid")).distinct(), "pid").select("anc", F.col("pid").alias("des"), "h", "t")
    return above.join(own.withColumnRenamed("pid", "anc"), ["anc", "h", "t"]).groupBy("anc", "des").agg(F.count(F.lit(1)).alias("common"))
