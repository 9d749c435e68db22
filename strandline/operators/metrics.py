"""Ranking and classification metrics over scored pairs (p1, p2, score) and true pairs (p1, p2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(scores: DataFrame) -> DataFrame:
    """Candidates of each query by descending score, then name."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("p1").orderBy(F.desc("score"), "p2")))


def tagged_ranks(scores: DataFrame, parents: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Each ranked candidate as parent, ancestor or other (*)."""
    direct = parents.select("p1", "p2", F.lit("parent").alias("direct")).distinct()
    above = ancestors.select("p1", "p2", F.lit("ancestor").alias("above")).distinct()
    return ranked(scores).join(direct, ["p1", "p2"], "left").join(above, ["p1", "p2"], "left").select("p1", "rank", "p2", "score", F.coalesce("direct", "above", F.lit("*")).alias("rel"))


def rank_metrics(tagged: DataFrame) -> DataFrame:
    """Accuracy at 1 and 3 and mean reciprocal rank of the first parent; queries without one count 0."""
    first = tagged.groupBy("p1").agg(F.min(F.when(F.col("rel") == "parent", F.col("rank"))).alias("first"))
    share = lambda test: F.avg(F.when(test, 1.0).otherwise(0.0))
    return first.agg(share(F.col("first") == 1).alias("acc1"), share(F.col("first") <= 3).alias("acc3"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))


def confusion(scores: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts of true and false positives and negatives, and accuracy."""
    known = truth.select("p1", "p2", F.lit(True).alias("true")).distinct()
    flags = scores.join(known, ["p1", "p2"], "left").select((F.col("score") >= threshold).alias("said"), F.coalesce("true", F.lit(False)).alias("true"))
    n = lambda said, true: F.count_if((F.col("said") == said) & (F.col("true") == true))
    return flags.agg(n(True, True).alias("tp"), n(False, False).alias("tn"), n(True, False).alias("fp"), n(False, True).alias("fn"), F.avg(F.when(F.col("said") == F.col("true"), 1.0).otherwise(0.0)).alias("accuracy"))


def average_precision(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """Average precision of each query with a true candidate; equal scores count together."""
    known = truth.select("p1", "p2", F.lit(1).alias("true")).distinct()
    by = scores.join(known, ["p1", "p2"], "left").groupBy("p1", "score").agg(F.sum(F.coalesce("true", F.lit(0))).alias("hits"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("p1").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    run = by.withColumn("precision", F.sum("hits").over(w) / F.sum("n").over(w))
    return run.groupBy("p1").agg((F.sum(F.col("precision") * F.col("hits")) / F.sum("hits")).alias("ap"), F.sum("hits").alias("positives")).where("positives > 0").select("p1", "ap")


def best_is_true(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of the queries whose best candidate is true."""
    best = ranked(scores).where("rank = 1").select("p1", "p2")
    known = truth.select("p1", "p2", F.lit(1.0).alias("true")).distinct()
    return best.join(known, ["p1", "p2"], "left").agg(F.count(F.lit(1)).alias("queries"), F.avg(F.coalesce("true", F.lit(0.0))).alias("accuracy"))


def nway_accuracy(logits: DataFrame, k: int = 3) -> DataFrame:
    """Macro and micro top-k accuracy of samples (sample, pid, label, candidate, logit); a sample's own relation is no candidate."""
    rank = F.row_number().over(Window.partitionBy("sample").orderBy(F.desc("logit"), "candidate"))
    hits = logits.where("candidate <> pid").withColumn("rank", rank).groupBy("sample", "pid").agg(F.max(F.when((F.col("rank") <= k) & (F.col("candidate") == F.col("label")), 1.0).otherwise(0.0)).alias("hit"))
    macro = hits.groupBy("pid").agg(F.avg("hit").alias("hit"), F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("n"))
    return macro.agg(F.avg("hit").alias("macro"), (F.sum("hits") / F.sum("n")).alias("micro"))


def pointwise_flags(scores: DataFrame, parents: DataFrame, ancestors: DataFrame) -> DataFrame:
    """For each child: whether its best candidate is a parent, whether a parent reaches a half while no other than an ancestor does, and
    whether every ancestor stands before every other candidate."""
    t = tagged_ranks(scores, parents, ancestors)
    other = F.col("rel") == "*"
    return t.groupBy("p1").agg(
        F.max((F.col("rank") == 1) & (F.col("rel") == "parent")).alias("best"),
        (F.max((F.col("rel") == "parent") & (F.col("score") >= 0.5)) & ~F.max(other & (F.col("score") >= 0.5))).alias("product"),
        (F.coalesce(F.max(F.when(~other, F.col("rank"))), F.lit(0)) < F.coalesce(F.min(F.when(other, F.col("rank"))), F.lit(1 << 30))).alias("in_order"),
    )
