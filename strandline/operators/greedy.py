"""Choices that a sequential pass would make, in rounds: relations whose nearest is a sibling, dealt to test and train."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.loops import checkpointed


def first_independent_set(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Which nodes a pass in the order of `order` takes, if it skips a node next to one taken before: (node, taken).

    `nodes` has node and an order without ties, `edges` (a, b) both ways. A round takes every open node that comes before all its open
    neighbours, and drops the neighbours; those choices don't depend on anything still open, so they are the pass's own.
    """
    edges = checkpointed(edges.select("a", "b").where("a <> b").distinct())
    open_ = checkpointed(nodes.select("node", "order"))
    done = None
    while open_.limit(1).count():
        near = edges.join(open_.select(F.col("node").alias("a")), "a", "left_semi").join(open_.select(F.col("node").alias("b"), F.col("order").alias("theirs")), "b")
        first = near.groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("theirs"))
        taken = checkpointed(open_.join(first, "node", "left").where("theirs is null or order < theirs").select("node"))
        out = edges.join(taken.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct().join(open_, "node", "left_semi").select("node")
        out = checkpointed(out)
        new = taken.withColumn("taken", F.lit(True)).unionByName(out.withColumn("taken", F.lit(False)))
        done = checkpointed(new if done is None else done.unionByName(new))
        open_ = checkpointed(open_.join(done, "node", "left_anti"))
    return nodes.select("node", F.lit(None).cast("boolean").alias("taken")).limit(0) if done is None else done


def nearest_of_each(scores: DataFrame) -> DataFrame:
    """The other relation of the highest score of each, the smaller one of equals: (p1, p2, score)."""
    best = scores.groupBy("p1").agg(F.min(F.struct((-F.col("score")).alias("below"), "p2")).alias("x"))
    return best.select("p1", "x.p2", (-F.col("x.below")).alias("score"))


def easy_siblings(scores: DataFrame, siblings: DataFrame) -> DataFrame:
    """Relations dealt to test and train by nearness: (pid, split).

    Scores are (p1, p2, score) of all pairs, siblings (a, b) both ways. Relations whose nearest is a sibling are gone through from the nearest pair on: one goes to
    test and its nearest to train, unless it is in train or its nearest in test already. Then all siblings of test relations that aren't in test
    join train. Equal scores go by the relation. A relation's place in the pass depends on the pairs that share a relation with it only, so the pass is an
    independent set.
    """
    near = nearest_of_each(scores)
    easy = checkpointed(near.join(siblings.select(F.col("a").alias("p1"), F.col("b").alias("p2")), ["p1", "p2"], "left_semi"))
    nodes = easy.select(F.col("p1").alias("node"), F.struct((-F.col("score")).alias("below"), F.col("p1").alias("pid")).alias("order"))
    # A pair keeps others from test whose nearest it is, and from train those whose relation it is: both share one relation.
    met = easy.select(F.col("p1").alias("a"), F.col("p2").alias("b")).join(easy.select(F.col("p1").alias("b")), "b").select("a", "b")
    chosen = first_independent_set(nodes, met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    test = checkpointed(chosen.where("taken").select(F.col("node").alias("pid")))
    return _with_siblings(test, scores, siblings)


def _with_siblings(test: DataFrame, scores: DataFrame, siblings: DataFrame) -> DataFrame:
    """Test relations, and as train all others with scores that are a sibling of one."""
    near = siblings.join(test.select(F.col("pid").alias("a")), "a", "left_semi").select(F.col("b").alias("pid")).distinct()
    train = near.join(scores.select(F.col("p1").alias("pid")), "pid", "left_semi").join(test, "pid", "left_anti")
    return test.withColumn("split", F.lit("test")).unionByName(train.withColumn("split", F.lit("train")))


def hard_siblings(scores: DataFrame, siblings: DataFrame, nearest: int = 10) -> DataFrame:
    """Relations with siblings, none of which is among their nearest, as test, and their siblings as train: (pid, split)."""
    nth = F.row_number().over(Window.partitionBy("p1").orderBy(F.desc("score"), "p2"))
    close = scores.withColumn("nth", nth).where(F.col("nth") <= nearest).select(F.col("p1").alias("a"), F.col("p2").alias("b"))
    known = scores.select(F.col("p1").alias("pid")).distinct()
    some = siblings.select(F.col("a").alias("pid")).distinct().join(known, "pid", "left_semi")
    met = close.join(siblings, ["a", "b"], "left_semi").select(F.col("a").alias("pid"))
    test = checkpointed(some.join(met, "pid", "left_anti"))
    return _with_siblings(test, scores, siblings)


def with_dev_half(splits: DataFrame, seed: int = 1) -> DataFrame:
    """The first half of the test relations, in the order of a hash, becomes dev; relations number in the thousands at most."""
    order = Window.partitionBy("split").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "pid")), "pid")
    n = F.count(F.lit(1)).over(Window.partitionBy("split"))
    dev = (F.col("split") == "test") & (F.col("nth") <= F.floor(F.col("n") / 2))
    return splits.withColumn("nth", F.row_number().over(order)).withColumn("n", n).select("pid", F.when(dev, F.lit("dev")).otherwise(F.col("split")).alias("split"))
