"""Data sets for learning: disjoint splits, proportional assignment, n-way and pointwise samples, padded inputs."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.relations import numbered


def disjoint(test: DataFrame, dev: DataFrame, train: DataFrame, key: str = "pid") -> DataFrame:
    """Test keys, dev keys without them, train keys without both: (key, split)."""
    t, d = test.select(key).distinct(), dev.select(key).distinct()
    d2 = d.join(t, key, "left_anti")
    r = train.select(key).distinct().join(t, key, "left_anti").join(d, key, "left_anti")
    return t.withColumn("split", F.lit("test")).unionByName(d2.withColumn("split", F.lit("dev"))).unionByName(r.withColumn("split", F.lit("train")))


def dealing_pattern(shares: list[float], longest: int = 10_000) -> tuple[list[int], list[int]]:
    """Which split each member of a group goes to by its number: the first round, and the round that repeats ever after.

    The next member goes to the split that lags most behind its share, the first of equals. A round is as long as the shares' common
    denominator, after which every split has exactly its share; a longer one than `longest` raises.
    """
    exact = [Fraction(str(s)) for s in shares]
    length = math.lcm(*[s.denominator for s in exact])
    if length > longest or sum(exact) != 1:
        raise ValueError("shares must sum to one and have a small common denominator")
    have, chosen = [0] * len(exact), []
    for i in range(2 * length):
        pick = max(range(len(exact)), key=lambda j: (exact[j] * max(i, 1) - have[j] if i else exact[j], -j))
        have[pick] += 1
        chosen.append(pick)
    if have != [2 * length * s for s in exact]:
        raise ValueError("the dealing doesn't repeat")
    return chosen[:length], chosen[length:]


def proportional_split(groups: DataFrame, shares: list[tuple[str, float]]) -> DataFrame:
    """Members of each group (grp, member, order) dealt one by one to the split that lags most behind its share: (grp, member, split)."""
    first, ever = dealing_pattern([s for _, s in shares])
    names = F.array(*[F.lit(s) for s, _ in shares])
    pick = F.when(F.col("nth") < len(first), F.get(F.lit(first), F.col("nth"))).otherwise(F.get(F.lit(ever), F.col("nth") % len(ever)))
    sizes = groups.groupBy(F.col("grp").alias("pid")).agg(F.count(F.lit(1)).alias("n"))
    own = numbered(groups.withColumn("pid", F.col("grp")), sizes, ["order", "member"], "nth").withColumn("nth", F.col("nth") - 1)
    return own.select("grp", "member", F.get(names, pick).alias("split"))


def nway_samples(chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """Chunks of occurrences with the parent of their relation as label: (label, pid, chunk, n)."""
    return chunks.join(parents.select(F.col("child").alias("pid"), F.col("parent").alias("label")), "pid").select("label", "pid", "chunk", "n")


def pointwise_pairs(parents: DataFrame, candidates: DataFrame, closed: DataFrame) -> DataFrame:
    """Every candidate relation against every parent, different ones: (parent, child, label) with 1 for ancestors."""
    truth = closed.select(F.col("anc").alias("parent"), F.col("des").alias("child"), F.lit(1).alias("label")).distinct()
    met = parents.select(F.col("pid").alias("parent")).join(candidates.select(F.col("pid").alias("child")), F.col("parent") != F.col("child"))
    return met.join(truth, ["parent", "child"], "left").fillna(0, ["label"])


def first_pairs_without_overlap(samples: DataFrame, quota: int) -> DataFrame:
    """The first rows of each pair (p1, p2) up to the quota, and of those the rows whose occurrences don't meet."""
    nth = F.row_number().over(Window.partitionBy("p1", "p2").orderBy("pos"))
    return samples.where("p1 <> p2").withColumn("nth", nth).where(F.col("nth") <= quota).where(~F.arrays_overlap("occs1", "occs2")).drop("nth")


def log_weights(edges: DataFrame) -> DataFrame:
    """ln(count + 1) of each id in a relation's surroundings."""
    ids = edges.select("pid", F.explode(F.array("src", "dst")).alias("id")).groupBy("pid", "id").agg(F.count(F.lit(1)).alias("cnt"))
    return ids.select("pid", "id", F.log1p(F.col("cnt").cast("double")).alias("weight"))


def padded(column: str, length: int, fill: int = 0) -> Column:
    """An array cut or filled to a length."""
    a = F.slice(F.col(column), 1, length)
    return F.concat(a, F.array_repeat(F.lit(fill), F.greatest(F.lit(length) - F.size(a), F.lit(0))))


def positives_and_some_negatives(rows: DataFrame, ratio: float, key: str, seed: int = 1, ranges: int = 1024) -> DataFrame:
    """All rows with label 1 and, in the order of a hash of the key, exactly `ratio` negatives to a positive, rounded down, or all there are.

    The hash is cut into ranges that are counted apart; whole ranges are taken, and only the one that holds the last negative is sorted.
    """
    place = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 12), 16, 10).cast("long")
    keyed = rows.withColumn("_at", F.when(F.col("label") == 1, None).otherwise(place)).withColumn("_range", F.floor(F.col("_at") / F.lit((1 << 48) // ranges)))
    counts = keyed.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    wanted = F.floor(F.sum(F.when(F.col("_range").isNull(), F.col("n")).otherwise(0)).over(Window.partitionBy()) * ratio)
    by = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row a range: a thousand or so.
    left = counts.withColumn("wanted", wanted).where("_range is not null").withColumn("left", F.col("wanted") - F.coalesce(F.sum("n").over(by), F.lit(0))).select("_range", "n", "left")
    met = keyed.join(F.broadcast(left), "_range", "left")
    whole = met.where("_range is null or n <= left")
    part = met.where("n > left and left > 0").withColumn("_nth", F.row_number().over(Window.partitionBy("_range").orderBy("_at", key))).where("_nth <= left")
    return whole.select(*rows.columns).unionByName(part.select(*rows.columns))
