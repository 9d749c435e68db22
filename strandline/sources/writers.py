"""Writers: occurrences by relation, delimited samples, rank tables, trees as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_by_relation(occs: DataFrame, folder: str) -> None:
    """One folder a relation; rows are dealt by relation and a salt, so a large relation has several writers."""
    occs.repartition(F.col("pid"), F.pmod(F.xxhash64("h"), F.lit(16))).write.mode("overwrite").partitionBy("pid").parquet(folder)


def nway_lines(samples: DataFrame) -> DataFrame:
    """Samples (label, pid, occs) as lines `label TAB pid h t h t ...`."""
    said = F.array_join(F.transform("occs", lambda o: F.concat_ws(" ", o.h, o.t)), " ")
    return samples.select(F.concat_ws("\t", F.col("label").cast("string"), F.concat_ws(" ", "pid", said)).alias("value"))


def rank_lines(ranked: DataFrame, k: int) -> DataFrame:
    """The first k candidates of each query by rank, joined by commas after it."""
    top = ranked.where(F.col("rank") <= k).groupBy("p1").agg(F.array_sort(F.collect_list(F.struct("rank", "p2"))).alias("found"))
    return top.select(F.concat_ws(",", "p1", F.array_join(F.transform("found", lambda x: x.p2), ",")).alias("value"))


def _two_decimals(x: Column) -> Column:
    """A number as the nearest of two decimals by its exact binary value, a tie to the even one, as C prints it: 0.495, which is a little less, as 0.49. Java's format would round what it shows in decimals.

    Both parts of a number cut at float precision are multiplied by 200 without error, so their sum has the sign of the distance to the middle of two.
    """
    size = F.abs(x)
    low, top = F.floor(size * 100), size.cast("float").cast("double")
    off = (top * 200 - (low * 2 + 1).cast("double")) + (size - top) * 200
    near = (low + F.when((off > 0) | ((off == 0) & (low % 2 == 1)), 1).otherwise(0)) / 100
    # Beyond 2^40 there is no rounding to speak of; not a number and infinity stay.
    return F.when(size < 2.0**40, near * F.when(x < 0, -1.0).otherwise(1.0)).otherwise(x)


def rank_table(ranked: DataFrame, k: int, names: DataFrame | None = None) -> DataFrame:
    """A table of the first k candidates (p1, rank, p2, score, rel) of each query: a head line, then `"query","candidate" score rel,...`: (nth, value) in the order of nth.

    Scores have two decimals, rounded by their exact value. Columns go as far as the longest row, k at the most. Names (pid, name) stand for relations where given. Queries number in the hundreds, and
    are in one window.
    """
    top = ranked.where(F.col("rank") <= k)
    if names is not None:
        said = lambda side: names.select(F.col("pid").alias(side), F.col("name").alias(f"{side}_name"))
        top = top.join(said("p1"), "p1", "left").join(said("p2"), "p2", "left")
    else:
        top = top.withColumn("p1_name", F.col("p1")).withColumn("p2_name", F.col("p2"))
    entry = F.format_string('"%s" %.2f %s', F.coalesce("p2_name", "p2"), _two_decimals(F.col("score").cast("double")), "rel")
    rows = top.groupBy("p1").agg(F.first(F.coalesce("p1_name", "p1")).alias("said"), F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry")))).alias("all"))
    lines = rows.select(F.row_number().over(Window.orderBy("p1")).alias("nth"), F.concat(F.lit('"'), "said", F.lit('",'), F.array_join(F.transform("all", lambda x: x["entry"]), ",")).alias("value"))
    head = top.agg(F.max("rank").alias("n")).where("n is not null").select(F.lit(0).alias("nth"), F.concat(F.lit("query,"), F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.concat(F.lit("pos_"), i.cast("string"))), ",")).alias("value"))
    return head.unionByName(lines)


def _said_occs(pid: str, occs: str) -> Column:
    """A relation and its occurrences in a row, by spaces; without occurrences the relation alone."""
    return F.concat_ws(" ", F.array(F.col(pid)), F.flatten(F.transform(occs, lambda o: F.array(o["h"], o["t"]))))


def pointwise_lines(pairs: DataFrame) -> DataFrame:
    """Labelled pairs of samples (label, p1, occs1, p2, occs2) as lines `label TAB p1 h t ... TAB p2 h t ...`."""
    return pairs.select(F.concat_ws("\t", F.col("label").cast("string"), _said_occs("p1", "occs1"), _said_occs("p2", "occs2")).alias("value"))


def label_occs_lines(labels: DataFrame, samples: DataFrame) -> DataFrame:
    """Each label (label, ind) with the occurrences of one sample of its relation (pid, occs) as lines `ind TAB label h t ...`."""
    met = labels.join(samples.select(F.col("pid").alias("label"), "occs"), "label", "left")
    none = F.array().cast("array<struct<h:string,t:string>>")
    return met.withColumn("occs", F.coalesce("occs", none)).select(F.concat_ws("\t", F.col("ind").cast("string"), _said_occs("label", "occs")).alias("value"))


def tree_lines(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Each root's tree as lines indented by depth, in the order of paths: (path, value). A cycle raises."""
    from strandline.operators.loops import checkpointed

    level = checkpointed(roots.select("pid", F.array("pid").alias("path")))
    out = level
    step = edges.select(F.col("parent").alias("pid"), "child")
    fine = F.when(F.array_contains("path", F.col("child")), F.raise_error(F.lit("the hierarchy has a cycle"))).otherwise(F.col("child"))
    while True:
        level = checkpointed(level.join(step, "pid").select(fine.alias("pid"), F.concat("path", F.array("child")).alias("path")))
        if not level.limit(1).count():
            break
        out = out.unionByName(level)
    return out.select(F.array_join("path", "/").alias("path"), F.concat(F.repeat(F.lit("\t"), F.size("path") - 1), F.col("pid")).alias("value"))


def label_index(labels: DataFrame) -> DataFrame:
    """Labels numbered from 0 in their order; one row a label."""
    return labels.select("label").distinct().select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("ind"))


def shuffled_heads(occs: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """The first n occurrences of each relation in an order by the hash of seed, head and tail."""
    nth = F.row_number().over(Window.partitionBy("pid").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "h", F.lit("|"), "t")), "h", "t"))
    return occs.withColumn("_nth", nth).where(F.col("_nth") <= n).select("pid", "h", "t")


def tree_json(edges: DataFrame, predicted: DataFrame) -> DataFrame:
    """A JSON object a relation with its parent, the smallest of several and # without one, and the predicted one (pid, predicted): (pid, value)."""
    own = edges.groupBy(F.col("child").alias("pid")).agg(F.min("parent").alias("parent"))
    top = edges.select(F.col("parent").alias("pid")).distinct().join(own, "pid", "left_anti").withColumn("parent", F.lit("#"))
    both = own.unionByName(top).join(predicted, "pid", "left")
    return both.select("pid", F.to_json(F.struct(F.col("pid").alias("id"), "parent", F.coalesce("predicted", F.lit("#")).alias("predicted"))).alias("value"))
