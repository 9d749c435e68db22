"""Evaluation of predictions (p1, p2, p), several for one pair, against true pairs (p1, p2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _judged(rows: DataFrame, truth: DataFrame) -> DataFrame:
    known = truth.select("p1", "p2", F.lit(1).alias("true")).distinct()
    return rows.join(known, ["p1", "p2"], "left").withColumn("true", F.coalesce("true", F.lit(0)))


def pair_scores(predictions: DataFrame) -> DataFrame:
    """Mean score of each ordered pair: (p1, p2, score)."""
    return predictions.groupBy("p1", "p2").agg(F.avg("p").alias("score"))


def sample_accuracy(predictions: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Share of the single predictions that are on the right side of the threshold; without any, 0."""
    right = (F.col("p") >= threshold) == (F.col("true") == 1)
    return _judged(predictions, truth).agg((F.count_if(right) / (F.count(F.lit(1)) + F.lit(1e-10))).alias("accuracy"))


def endpoint_precision(scores: DataFrame, truth: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """Area under the precision-recall curve and average precision of each relation with a true pair: (pid, auc, ap).

    A pair's score stands in the rankings of both its relations (of those in `among` (pid), if given). Equal scores count together. The
    curve begins at recall 0 and precision 1, and its area is that of trapezoids.
    """
    judged = _judged(scores, truth)
    both = judged.select(F.explode(F.array("p1", "p2")).alias("pid"), "score", "true")
    both = both if among is None else both.join(among.select("pid").distinct(), "pid", "left_semi")
    levels = both.groupBy("pid", "score").agg(F.sum("true").alias("hits"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("pid").orderBy(F.desc("score"))
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    curve = levels.withColumn("precision", F.sum("hits").over(run) / F.sum("n").over(run))
    curve = curve.withColumn("before", F.coalesce(F.lag("precision").over(order), F.lit(1.0)))
    areas = curve.groupBy("pid").agg(
        F.sum("hits").alias("positives"), F.sum(F.col("hits") * (F.col("precision") + F.col("before")) / 2).alias("auc"), F.sum(F.col("hits") * F.col("precision")).alias("ap")
    )
    return areas.where("positives > 0").select("pid", (F.col("auc") / F.col("positives")).alias("auc"), (F.col("ap") / F.col("positives")).alias("ap"))


def coverage(rows: DataFrame) -> DataFrame:
    """Mean of the ratios and ratio of the sums of (found, wanted): macro and micro; rows that want nothing are left out."""
    some = rows.where("wanted > 0")
    return some.agg(F.avg(F.col("found") / F.col("wanted")).alias("macro"), (F.sum("found") / F.sum("wanted")).alias("micro"))


def by_leaf(hits: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Accuracy of hits (pid, hit) apart for leaves and inner relations of the hierarchy (parent, child) reduced to parents in `labels` (pid): (leaf, n, accuracy)."""
    kept = edges.join(labels.select(F.col("pid").alias("parent")).distinct(), "parent", "left_semi")
    inner = kept.select(F.col("parent").alias("pid"), F.lit(False).alias("leaf")).distinct()
    found = hits.join(inner, "pid", "left").withColumn("leaf", F.coalesce("leaf", F.lit(True)))
    return found.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("hit").cast("double")).alias("accuracy"))


def masked_means(sequences: DataFrame, vectors: DataFrame, weighted: bool = False) -> DataFrame:
    """Mean vector of each sequence (sample, key[, weight]) over the keys that have one: (sample, vec). Padding and unknown keys don't count."""
    weight = F.col("weight").cast("double") if weighted else F.lit(1.0)
    met = sequences.withColumn("_w", weight).join(vectors.select("key", "vec"), "key").select("sample", "_w", F.posexplode("vec").alias("dim", "x"))
    mean = met.groupBy("sample", "dim").agg((F.sum(F.col("x").cast("double") * F.col("_w")) / F.sum("_w")).alias("x"))
    return mean.groupBy("sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("vec"))


def message_sums(edges: DataFrame, states: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Sum of the sources' states at each edge's target, by a weight an edge kind: (node, dim, x)."""
    weight = F.create_map(*[F.lit(v) for pair in weights.items() for v in pair])[F.col("kind")]
    sent = edges.join(states.select(F.col("node").alias("src"), "dim", "x"), "src").withColumn("x", F.col("x") * weight)
    return sent.groupBy(F.col("dst").alias("node"), "dim").agg(F.sum("x").alias("x"))
