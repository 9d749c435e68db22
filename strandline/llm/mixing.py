"""Mixing sources to target weights: hash-random keys, range sort, distributed prefix sums, exact budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import WORD, shared_checkpoint, text_of, unused

#: A source's words are repeated at most so often.
MOST_EPOCHS = 3
#: Equal ranges of the hash key, by the table's rows; within a source each is sorted and summed on its own.
LEAST_RANGES, ROWS_IN_RANGE = 1024, 50_000


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Targets of sources: rows (source, source_size, target) from rows (source, source_size).

    Sources in code-point order, null last, take the weights in turn and share the sum of all sizes. No target exceeds `most_epochs`
    times its source's size; the excess is shared by weight among the others until none is above. In the order of size to weight the
    sources that reach their cap come first, so one running sum over the sources finds the level at which the rest share.
    The table has one row a source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * most_epochs
    by_ratio = Window.orderBy(cap / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    stepped = ranked.withColumn("level", level).withColumn("capped", F.col("level") * F.col("weight") > cap)
    settled = stepped.withColumn("shared", F.min(F.when(~F.col("capped"), F.struct(cap / F.col("weight"), F.col("level").alias("level")))).over(everything)["level"])
    target = F.when(F.col("capped"), cap.cast("double")).otherwise(F.least(F.col("shared") * F.col("weight"), cap.cast("double")))
    return settled.select("source", "source_size", target.cast("double").alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most_epochs: int = MOST_EPOCHS, seed: str = "mix", ranges: int | None = None) -> DataFrame:
    """Words that a mix of the sources takes from each document.

    Takes any frame with doc_id, source and text. Returns doc_id, source, size, source_size, target, taken, epochs (whole passes),
    part (words of the last, partial pass).

    A source's budget is its target rounded down to a whole word. It is filled by whole passes over the source, then in the order of the
    hash of (seed, doc_id) up to the exact word. Null texts have size 0, null sources are one source, null ids hash alike and follow in
    the order of size and text. Rows equal in all these share their words in any order. An empty table gives no rows.
    """
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = docs.select("doc_id", "source", F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"), key.alias("key"), F.xxhash64(text_of()).alias("tie"))
    rows = shared_checkpoint(rows.withColumn("name", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))))
    # The key's leading 32 bits, cut into equal ranges: as many as rows ask for, so the same in every run.
    ranges = ranges or max(LEAST_RANGES, rows.count() // ROWS_IN_RANGE)
    rows = rows.withColumn("range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32)).cast("int"))

    sums = shared_checkpoint(rows.groupBy("name", "range").agg(F.first("source").alias("source"), F.sum("size").alias("words")))
    offsets = sums.withColumn("offset", F.sum("words").over(Window.partitionBy("name").orderBy("range")) - F.col("words"))
    sizes = sums.groupBy("name").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    targets = source_targets(sizes.select("source", "source_size"), weights, most_epochs)
    targets = targets.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("name"), "source_size", "target")
    placed = offsets.join(targets, "name").select("name", "range", "offset", "source_size", "target")

    within = Window.partitionBy("name", "range").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("through", F.sum("size").over(within)).join(placed, ["name", "range"])
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    summed = summed.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - (F.col("offset") + F.col("through") - F.col("size"))))
    summed = summed.withColumn("part", part.cast("long"))
    return summed.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), "epochs", "part", "tie")


def _row_key(tie: Column | str) -> Column:
    """Equal for rows of equal id, source and text."""
    parts = [F.coalesce(F.concat(F.lit("v"), x.cast("string")), F.lit("n")) for x in (F.col("doc_id"), F.col(tie) if isinstance(tie, str) else tie, F.col("source"))]
    return F.md5(F.concat_ws("|", *parts))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """The documents as often as the mix takes them; columns are unchanged.

    A document appears once for each whole pass, and once more if the last pass takes at least half of its words: texts stay whole, so
    a source departs from its budget by half a document at most. Documents without words appear once for each whole pass. Null texts have
    no words, a null source is one of its own, null ids and repeated rows share their copies; an empty table gives no rows.
    """
    key, own_copies, nth, copy = unused(docs, "key", "copies", "nth", "copy")
    copies = F.col("epochs") + F.when((F.col("part") > 0) & (F.col("part") * 2 >= F.col("size")), 1).otherwise(0)
    counted = mix(docs, weights).select(_row_key("tie").alias(key), copies.alias(own_copies)).groupBy(key).agg(F.sum(own_copies).alias(own_copies), F.count(F.lit(1)).alias(nth))
    several = counted.where(F.col(nth) > 1)
    keyed = docs.withColumn(key, _row_key(F.xxhash64(text_of())))
    found = keyed.join(counted, key)
    if several.limit(1).count():
        # Equal rows share their copies as evenly as whole numbers allow: those after the first ones have one less.
        number = F.row_number().over(Window.partitionBy(key).orderBy(key))
        alone, equal = found.where(F.col(nth) == 1).drop(nth), found.where(F.col(nth) > 1)
        share = F.floor(F.col(own_copies) / F.col(nth)) + F.when(number <= F.col(own_copies) % F.col(nth), 1).otherwise(0)
        found = alone.unionByName(equal.withColumn(own_copies, share).drop(nth))
    repeated = found.withColumn(copy, F.explode(F.when(F.col(own_copies) > 0, F.sequence(F.lit(1), F.col(own_copies).cast("int"))).otherwise(F.array().cast("array<int>"))))
    return repeated.select(*docs.columns)
