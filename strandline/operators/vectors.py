"""Similarity of relations by the vectors of their occurrences: rows (id, pid, vec)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def mean_vectors(rows: DataFrame, unit: bool = False) -> DataFrame:
    """Mean vector of each relation, of vectors scaled to unit length if `unit`; summed by dimension in the tasks first."""
    scaled = rows.withColumn("vec", F.transform("vec", lambda x: x.cast("double") / norm(F.col("vec")))) if unit else rows
    long = scaled.select("pid", F.posexplode("vec").alias("dim", "x")).groupBy("pid", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return long.groupBy("pid").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda p: p.x).alias("vec"))


def own_vectors(props: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations (pid) by a vector of their own (entity, vec) in place of their occurrences': (id, pid, vec); those without one are left out."""
    return props.select("pid").distinct().join(entities.select(F.col("entity").alias("pid"), "vec"), "pid").select(F.lit(0).cast("long").alias("id"), "pid", "vec")


def _pairs(means: DataFrame) -> DataFrame:
    """Pairs of different relations; relations number in the hundreds, so this side is small whatever the occurrences' count."""
    return means.select(F.col("pid").alias("p1"), F.col("vec").alias("x")).join(means.select(F.col("pid").alias("p2"), F.col("vec").alias("y")), F.col("p1") != F.col("p2"))


def mean_scores(rows: DataFrame) -> DataFrame:
    """Cosine, negative distance and dot product of the relations' mean vectors."""
    p = _pairs(mean_vectors(rows))
    return p.select("p1", "p2", (dot(F.col("x"), F.col("y")) / (norm(F.col("x")) * norm(F.col("y")))).alias("cosine"), (-F.sqrt(squared_distance(F.col("x"), F.col("y")))).alias("distance"), dot(F.col("x"), F.col("y")).alias("dot"))


def pairwise_cosine(rows: DataFrame) -> DataFrame:
    """Mean cosine of all pairs of occurrences of two relations: the dot product of their mean unit vectors, without any pair."""
    return _pairs(mean_vectors(rows, unit=True)).select("p1", "p2", dot(F.col("x"), F.col("y")).alias("score"))


def nearest_relations(rows: DataFrame, k: int) -> DataFrame:
    """The k relations of the highest cosine of mean vectors: (p1, rank, p2, cosine)."""
    rank = F.row_number().over(Window.partitionBy("p1").orderBy(F.desc("cosine"), "p2"))
    return mean_scores(rows).select("p1", "p2", "cosine").withColumn("rank", rank).where(F.col("rank") <= k)


def central_member(means: DataFrame, groups: DataFrame, method: str = "middle", seed: int = 1) -> DataFrame:
    """Of each group (grp, pid) the relation that its mean cosine to all members singles out: (grp, pid).

    `min` takes the lowest, `middle` the one in the middle, `top_m` the one after m lower ones (or the highest, if there are fewer), and `random`
    the first in the order of a hash of seed, group and relation. Equal ones go by the relation.
    """
    own = groups.join(means, "pid")
    n = F.count(F.lit(1)).over(Window.partitionBy("grp"))
    if method == "random":
        central = own.select("grp", "pid", F.md5(F.concat_ws("|", F.lit(str(seed)), "grp", "pid")).alias("central"))
    else:
        met = own.select("grp", F.col("pid"), F.col("vec").alias("x")).join(own.select("grp", F.col("vec").alias("y")), "grp")
        central = met.groupBy("grp", "pid").agg(F.avg(dot(F.col("x"), F.col("y")) / (norm(F.col("x")) * norm(F.col("y")))).alias("central"))
    if method in ("min", "random"):
        wanted = F.lit(1)
    elif method == "middle":
        wanted = F.floor(F.col("n") / 2) + 1
    elif method.startswith("top_"):
        wanted = F.least(F.lit(int(method.removeprefix("top_")) + 1), F.col("n"))
    else:
        raise ValueError("method must be min, middle, top_ and a number, or random")
    nth = F.row_number().over(Window.partitionBy("grp").orderBy("central", "pid"))
    return central.withColumn("nth", nth).withColumn("n", n).where(F.col("nth") == wanted).select("grp", "pid")


def middle_member(means: DataFrame, groups: DataFrame) -> DataFrame:
    """Of each group of relations the one whose mean cosine to all its members is the middle one: (grp, pid)."""
    return central_member(means, groups, "middle")


def swapped(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges (parent, child) after the relations of each pair (a, b) have changed names, everywhere at once. A relation may stand in one pair."""
    new = pairs.where("a <> b")
    new = new.select(F.col("a").alias("was"), F.col("b").alias("now")).unionByName(new.select(F.col("b").alias("was"), F.col("a").alias("now")))
    for side in ("parent", "child"):
        edges = edges.join(new.select(F.col("was").alias(side), "now"), side, "left").withColumn(side, F.coalesce("now", side)).drop("now")
    return edges


def covariances(rows: DataFrame) -> DataFrame:
    """Mean vector and sample covariance matrix of each relation's vectors (pid, vec): (pid, n, i, j, mean_i, covariance), null with one vector.

    Tasks sum blocks of products, one d x d matrix a relation and task, around the mean of all vectors, which keeps the sums small; Spark adds the
    blocks up. Vectors that are null, or have null components, are left out; all others must be of one length.
    """
    whole = rows.where(F.col("pid").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull())).select(F.col("pid").cast("string").alias("pid"), F.col("vec").cast("array<double>").alias("vec"))
    means = whole.select(F.posexplode("vec").alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("x")).orderBy("dim").collect()
    centre = np.array([r.x for r in means])  # as many rows as dimensions

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            pids = np.array(batch.column("pid").to_pylist(), dtype=object)
            x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(pids), len(centre)) - centre
            for pid in set(pids):
                own = x[pids == pid]
                n, total, products = held.get(pid, (0, 0, 0))
                held[pid] = (n + len(own), total + own.sum(axis=0), products + own.T @ own)
        for pid, (n, total, products) in held.items():
            for i in range(len(centre)):
                yield pa.record_batch({"pid": [pid], "n": pa.array([n], pa.int64()), "i": pa.array([i], pa.int32()), "total": pa.array([total.tolist()]), "products": pa.array([products[i].tolist()])})

    parts = whole.mapInArrow(moments, "pid string, n long, i int, total array<double>, products array<double>")
    each = parts.select("pid", "n", "i", F.get("total", F.col("i")).alias("total_i"), F.inline(F.arrays_zip(F.col("total").alias("total_j"), F.col("products").alias("product"), F.sequence(F.lit(0), F.size("total") - 1).alias("j"))))
    summed = each.groupBy("pid", "i", "j").agg(F.sum("n").alias("n"), F.sum("total_i").alias("a"), F.sum("total_j").alias("b"), F.sum("product").alias("p"))
    mean = F.get(F.array(*[F.lit(float(x)) for x in centre]), F.col("i")) + F.col("a") / F.col("n") if len(centre) else F.lit(None).cast("double")
    covariance = F.when(F.col("n") > 1, (F.col("p") - F.col("a") * F.col("b") / F.col("n")) / (F.col("n") - 1))
    return summed.select("pid", "n", "i", "j", mean.alias("mean_i"), covariance.alias("covariance"))


def gaussians(rows: DataFrame) -> DataFrame:
    """Mean and variance of each relation's vectors by dimension."""
    return rows.select("pid", F.posexplode("vec").alias("dim", "x")).groupBy("pid", "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.var_samp(F.col("x").cast("double")).alias("variance"))
