"""Relational operators on triples and occurrences: filters, sets, counts, samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.loops import checkpointed, few, written

#: Ids of entities.
ENTITY = "^Q[0-9]+$"
#: Rows beyond which a relation is numbered in ranges and not in one window.
LARGE_RELATION = 5_000_000


def entity_pairs(occs: DataFrame) -> DataFrame:
    """Occurrences with an entity on both sides; duplicates stay."""
    return occs.where(F.col("h").rlike(ENTITY) & F.col("t").rlike(ENTITY))


def with_relations(triples: DataFrame, relations: list[str]) -> DataFrame:
    return triples.where(F.col("r").isin(relations))


def useful_triples(triples: DataFrame, useful: DataFrame, entities: DataFrame, instance_of: str = "P31") -> DataFrame:
    """Distinct triples of useful relations whose head is known and whose tail is known too, or whose relation is `instance_of`."""
    known = entities.select("entity").distinct()
    out = triples.distinct().join(useful.select(F.col("pid").alias("r")).distinct(), "r", "left_semi")
    out = out.join(known.select(F.col("entity").alias("h")), "h", "left_semi")
    tails = known.select(F.col("entity").alias("t"), F.lit(True).alias("known"))
    return out.join(tails, "t", "left").where((F.col("r") == instance_of) | F.col("known")).select("h", "r", "t")


def judged_relations(triples: DataFrame, relations: DataFrame) -> DataFrame:
    """Each relation judged by its first triple, by head and tail: useful if both are entities, useless if not, miss without any."""
    first = triples.groupBy("r").agg(F.min(F.struct("h", "t")).alias("first"))
    both = F.col("first.h").rlike(ENTITY) & F.col("first.t").rlike(ENTITY)
    out = relations.join(first, relations.pid == first.r, "left")
    return out.select("pid", F.when(F.col("first").isNull(), "miss").when(both, "useful").otherwise("useless").alias("verdict"))


def distinct_entities(triples: DataFrame) -> DataFrame:
    return triples.select(F.explode(F.array("h", "t")).alias("entity")).where(F.col("entity").rlike(ENTITY)).distinct()


def entity_degree(triples: DataFrame) -> DataFrame:
    """How often each entity is a head or a tail."""
    return triples.select(F.explode(F.array("h", "t")).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("cnt"))


def relation_counts(triples: DataFrame, key: str = "r") -> DataFrame:
    return triples.groupBy(key).agg(F.count(F.lit(1)).alias("cnt"))


def contained_share(entities: DataFrame, popularity: DataFrame) -> DataFrame:
    """How many entities there are, and how many of them the popularity table has."""
    known = popularity.select("entity", F.lit(1).alias("one")).distinct()
    joined = entities.select("entity").distinct().join(known, "entity", "left")
    return joined.agg(F.count(F.lit(1)).alias("entities"), F.count("one").alias("contained"))


def with_ancestors(occs: DataFrame, closure: DataFrame) -> DataFrame:
    """Distinct occurrences of each relation and of all its ancestors."""
    above = occs.join(few(closure.select(F.col("des").alias("pid"), "anc").distinct()), "pid").select(F.col("anc").alias("pid"), "h", "t")
    return occs.select("pid", "h", "t").unionByName(above).distinct()


def minus(occs: DataFrame, main: str, others: list[str]) -> DataFrame:
    """Distinct pairs of one relation that none of the others has."""
    pairs = lambda pids: occs.where(F.col("pid").isin(pids)).select("h", "t")
    return pairs([main]).distinct().join(pairs(others), ["h", "t"], "left_anti")


def without_descendants(occs: DataFrame, closure: DataFrame) -> DataFrame:
    """A relation with descendants keeps its distinct pairs that none of them has; others keep all rows, duplicates too."""
    parents = few(closure.select(F.col("anc").alias("pid")).distinct())
    below = occs.join(few(closure.select(F.col("des").alias("pid"), "anc").distinct()), "pid").select(F.col("anc").alias("pid"), "h", "t")
    inner = occs.join(parents, "pid", "left_semi").distinct().join(below, ["pid", "h", "t"], "left_anti")
    return inner.unionByName(occs.join(parents, "pid", "left_anti"))


def overlap_ratio(occs: DataFrame, closure: DataFrame) -> DataFrame:
    """Share of each descendant's distinct pairs that its ancestor has too: rows (anc, des, ratio)."""
    own = occs.select("pid", "h", "t").distinct()
    pairs = closure.select("anc", "des").distinct()
    sizes = own.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    des = own.join(pairs, own.pid == pairs.des).select("anc", "des", "h", "t")
    common = des.join(own.select(F.col("pid").alias("anc"), "h", "t"), ["anc", "h", "t"]).groupBy("anc", "des").agg(F.count(F.lit(1)).alias("both"))
    out = pairs.join(sizes, pairs.des == sizes.pid).join(common, ["anc", "des"], "left")
    return out.select("anc", "des", (F.coalesce("both", F.lit(0)) / F.col("n")).alias("ratio"))


def first_per_key(df: DataFrame, key: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each key in a total order."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_nth", nth).where(F.col("_nth") <= n).drop("_nth")


def numbered(df: DataFrame, sizes: DataFrame, order: list[Column | str], name: str, large: int = LARGE_RELATION, distinct: bool = False) -> DataFrame:
    """Rows numbered from 1 within each relation (pid), in a total order; `sizes` (pid, n) has at least each relation's rows.

    Rows that repeat count once if `distinct`, for which the order must have all columns. Where none has over `large` rows, relations are numbered in a window. Else all rows are dealt once, in sorted ranges of relation and order; a
    row's place in its range and what stands in the ranges before give its number, so no task holds a relation and nothing is dealt again.
    """
    if not sizes.where(F.col("n") > large).limit(1).count():
        return (df.distinct() if distinct else df).withColumn(name, F.row_number().over(Window.partitionBy("pid").orderBy(*order)))
    ranged = df.repartitionByRange("pid", *order)
    if distinct:
        # Equal rows are in one range, so nothing is dealt for this.
        ranged = ranged.distinct()
    # The id has the range in its upper bits and the place in the lower 33. A checkpoint would hold the rows uncompressed, ten times the table's size.
    ranged = written(ranged.sortWithinPartitions("pid", *order).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    counts = ranged.groupBy(F.col("pid").alias("_pid"), F.col("_part").alias("_of")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    # One row a relation and range.
    before = F.sum("_n").over(Window.partitionBy("_pid").orderBy("_of")) - F.col("_n")
    starts = few(counts.select("_pid", "_of", (before - F.col("_first")).alias("_before")))
    placed = ranged.join(starts, F.col("pid").eqNullSafe(F.col("_pid")) & (F.col("_part") == F.col("_of")))
    return placed.select(*df.columns, (F.col("_at") + F.col("_before") + 1).alias(name))


def downsample(occs: DataFrame, large: int = LARGE_RELATION) -> DataFrame:
    """The first min(n, sqrt(n) * 10) of each relation's n rows, in the order of head and tail."""
    counts = occs.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    bound = F.floor(F.least(F.col("n"), F.sqrt("n") * 10))
    return numbered(occs.select("pid", "h", "t"), counts, ["h", "t"], "nth", large).join(counts, "pid").where(F.col("nth") <= bound).select("pid", "h", "t")


def downsample_by_popularity(occs: DataFrame, popularity: DataFrame, most: int = 100_000, large: int = LARGE_RELATION) -> DataFrame:
    """Distinct pairs of each relation with the highest harmonic popularity 1 / (1 / c(h) + 1 / c(t)); a missing one counts 0.

    The bound min(n, sqrt(min(n, most)) * 10) takes n with duplicates; ties go to the smaller head, then tail.
    """
    counts = occs.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    of = lambda side: popularity.select(F.col("entity").alias(side), F.col("cnt").alias(f"c_{side}"))
    scored = occs.select("pid", "h", "t").distinct().join(of("h"), "h", "left").join(of("t"), "t", "left")
    score = F.coalesce(1 / (1 / F.col("c_h") + 1 / F.col("c_t")), F.lit(0.0))
    bound = F.floor(F.least(F.col("n"), F.sqrt(F.least(F.col("n"), F.lit(most))) * 10))
    order, highest = [F.desc("score"), "h", "t"], int(most**0.5 * 10)
    if highest > large:
        return numbered(scored.withColumn("score", score), counts, order, "nth", large).join(counts, "pid").where(F.col("nth") <= bound).select("pid", "h", "t")
    # No bound is above `highest`, so each task keeps that many rows of a relation at most before they meet; Spark does so up to a limit of the session.
    conf, name = occs.sparkSession.conf, "spark.sql.optimizer.windowGroupLimitThreshold"
    conf.set(name, str(max(int(conf.get(name)), highest)))
    nth = F.row_number().over(Window.partitionBy("pid").orderBy(*order))
    first = scored.withColumn("score", score).withColumn("nth", nth).where(F.col("nth") <= highest)
    return first.join(F.broadcast(counts), "pid").where(F.col("nth") <= bound).select("pid", "h", "t")


def drop_consecutive(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from that of the row before."""
    before = F.lag(value).over(Window.partitionBy(*key).orderBy(*order))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_before", before).withColumn("_nth", nth).where((F.col("_nth") == 1) | ~F.col(value).eqNullSafe(F.col("_before"))).drop("_before", "_nth")


def chunked(occs: DataFrame, size: int, large: int = LARGE_RELATION) -> DataFrame:
    """Distinct pairs of each relation in chunks of a fixed size: (pid, chunk, n, first_h)."""
    counts = occs.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    out = numbered(occs.select("pid", "h", "t").distinct(), counts, ["h", "t"], "nth", large).withColumn("chunk", F.floor((F.col("nth") - 1) / size).cast("long"))
    return out.groupBy("pid", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("first_h"))


def deepest_type(types: DataFrame) -> DataFrame:
    """The type of the greatest depth of each entity, the first in position on ties."""
    best = types.groupBy("entity").agg(F.max_by("type", F.struct("depth", -F.col("pos"))).alias("type"))
    return best


def type_keys(occs: DataFrame, types: DataFrame) -> DataFrame:
    """Distinct occurrences with the deepest types of head and tail ('Q' without any)."""
    best = deepest_type(types)
    out = occs.select("pid", "h", "t").distinct()
    out = out.join(best.select(F.col("entity").alias("h"), F.col("type").alias("h_type")), "h", "left").join(best.select(F.col("entity").alias("t"), F.col("type").alias("t_type")), "t", "left")
    return out.select("pid", "h", "t", F.coalesce("h_type", F.lit("Q")).alias("h_type"), F.coalesce("t_type", F.lit("Q")).alias("t_type"))


def split_names(keyed: DataFrame, share: float = 0.01, major_keeps_name: bool = False) -> DataFrame:
    """New relation names by type key: rows (pid, h_type, t_type, n, name).

    A key with `share` of its relation's rows becomes pid_H_T unless it is the relation's smallest; the rest stay pid. With
    `major_keeps_name` the largest key stays pid, and small keys become pid_LONGTAIL. Ties are broken by the types.
    """
    keys = keyed.groupBy("pid", "h_type", "t_type").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("pid"))
    least = F.row_number().over(Window.partitionBy("pid").orderBy("n", "h_type", "t_type"))
    most = F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("n"), "h_type", "t_type"))
    own = F.concat_ws("_", "pid", "h_type", "t_type")
    large = (F.col("n") >= share * F.col("total")) & (F.col("least") > 1)
    name = F.when(F.col("most") == 1, F.col("pid")).when(large, own).otherwise(F.concat("pid", F.lit("_LONGTAIL"))) if major_keeps_name else F.when(large, own).otherwise(F.col("pid"))
    return keys.withColumns({"total": total, "least": least, "most": most}).select("pid", "h_type", "t_type", "n", name.alias("name"))


def split_by_type(occs: DataFrame, types: DataFrame, share: float = 0.01, major_keeps_name: bool = False) -> DataFrame:
    """Distinct occurrences under their new names: (pid, h, t, name)."""
    keyed = type_keys(occs, types)
    names = split_names(keyed, share, major_keeps_name).select("pid", "h_type", "t_type", "name")
    return keyed.join(few(names), ["pid", "h_type", "t_type"]).select("pid", "h", "t", "name")


def split_counts(occs: DataFrame, types: DataFrame, share: float = 0.01, major_keeps_name: bool = False) -> DataFrame:
    """Distinct occurrences under each new name: (pid, name, cnt). Type keys are counted once, and their counts summed by name."""
    return split_names(type_keys(occs, types), share, major_keeps_name).groupBy("pid", "name").agg(F.sum("n").alias("cnt"))


def parallel_relations(triples: DataFrame, least: int = 3) -> DataFrame:
    """Relations that run against others over the same pairs: (r, against, cnt) with `least` pairs."""
    own = triples.where(F.col("h").rlike(ENTITY) & F.col("t").rlike(ENTITY)).distinct()
    back = own.select(F.col("t").alias("h"), F.col("h").alias("t"), F.col("r").alias("against"))
    return own.join(back, ["h", "t"]).where("r <> against").groupBy("r", "against").agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") >= least)


def parallel_by_sample(occs: DataFrame, triples: DataFrame, least: int = 3) -> DataFrame:
    """Relations that run back over a sample's occurrences (sample, pid, h, t): (sample, r, cnt) with `least` occurrences; the sample's own relation is none."""
    # Both sides are dealt by the pair once: repeats go where they meet.
    back = triples.select(F.col("t").alias("h"), F.col("h").alias("t"), "r").repartition("h", "t").distinct()
    own = occs.select("sample", "pid", "h", "t").repartition("h", "t").distinct()
    return own.join(back, ["h", "t"]).where("r <> pid").groupBy("sample", "r").agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") >= least)


def last_wins(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """A map: of the rows of one key, the value of the last."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def cumulative_seeds(counts: DataFrame, key: str, ratio: float) -> DataFrame:
    """Keys by descending count, before the one at which the running sum reaches `ratio` of the total.

    The running sum goes by count first: counts repeat, so their table is small, and keys of one count follow each other by name in
    windows of that count alone, or in ranges where it has many.
    """
    per_count = counts.groupBy("cnt").agg(F.count(F.lit(1)).alias("keys"))
    before = F.coalesce(F.sum(F.col("cnt") * F.col("keys")).over(Window.orderBy(F.desc("cnt")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = per_count.select("cnt", before.alias("before"), F.sum(F.col("cnt") * F.col("keys")).over(Window.partitionBy()).alias("total"))
    own = numbered(counts.withColumn("pid", F.col("cnt")), per_count.select(F.col("cnt").alias("pid"), F.col("keys").alias("n")), [key], "nth").drop("pid")
    through = own.join(levels, "cnt").withColumn("through", F.col("before") + F.col("nth") * F.col("cnt"))
    return through.where(F.col("through") < ratio * F.col("total")).select(key, "cnt", "through")


def trailing_mean(df: DataFrame, key: list[str], order: list[str], value: str, rows: int = 10) -> DataFrame:
    """Mean of the last `rows` values; a key's first `rows` rows have none and go."""
    w = Window.partitionBy(*key).orderBy(*order)
    mean = F.avg(value).over(w.rowsBetween(1 - rows, 0))
    return df.withColumn("mean", mean).withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") > rows).drop("_nth")


def shuffled_sample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows in an order that depends on the seed and the key alone."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)
