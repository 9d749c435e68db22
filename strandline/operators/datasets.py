"""Data sets from hierarchies and samples: tiers split, labelled pairs, weights fitted on one split and used on others, contexts of relation sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.loops import checkpointed
from strandline.operators.samples import proportional_split

SPLITS = ("train", "dev", "test")


def _hashed(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *columns))


def _drawn(hashed: Column, shares: tuple[float, float, float]) -> Column:
    """A split by the first eight digits of a hash, as a number from 0 to 1."""
    x = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    return F.when(x < shares[0], SPLITS[0]).when(x < shares[0] + shares[1], SPLITS[1]).otherwise(SPLITS[2])


def split_within(edges: DataFrame, shares: tuple[float, float, float], known: DataFrame | None = None, one_by_one: bool = False, empty_splits: bool = False, seed: int = 1) -> DataFrame:
    """Each parent's children dealt to train, dev and test: (parent, child, split).

    Children stand in the order of a hash. `one_by_one` gives the next to the split that lags most behind its share; otherwise each split gets
    its share of the children, rounded down, and what is left is drawn by hash, as are all children of a parent of which a split would get none. Only
    relations in `known` (pid) take part, where given, as parents and as children. Without `empty_splits` parents go of which a split has no child.
    """
    own = edges.select("parent", "child").distinct()
    if known is not None:
        ids = known.select("pid").distinct()
        own = own.join(ids.select(F.col("pid").alias("parent")), "parent", "left_semi").join(ids.select(F.col("pid").alias("child")), "child", "left_semi")
    own = own.select("parent", "child", _hashed(seed, "parent", "child").alias("place"))
    if one_by_one:
        dealt = proportional_split(own.select(F.col("parent").alias("grp"), F.col("child").alias("member"), F.col("place").alias("order")), list(zip(SPLITS, shares, strict=True)))
        dealt = dealt.select(F.col("grp").alias("parent"), F.col("member").alias("child"), "split")
    else:
        by = Window.partitionBy("parent")
        nth, n = F.row_number().over(by.orderBy("place", "child")), F.count(F.lit(1)).over(by)
        whole = [F.floor(F.col("n") * s) for s in shares]
        drawn = _drawn(_hashed(seed + 1, "parent", "child"), shares)
        first = F.when(F.col("nth") <= whole[0], SPLITS[0]).when(F.col("nth") <= whole[0] + whole[1], SPLITS[1]).when(F.col("nth") <= whole[0] + whole[1] + whole[2], SPLITS[2]).otherwise(drawn)
        held = own.withColumn("nth", nth).withColumn("n", n).withColumn("first", first).withColumn("drawn", drawn)
        dealt = held.withColumn("whole", F.size(F.collect_set("first").over(by)) == len(SPLITS)).select("parent", "child", F.when(F.col("whole"), F.col("first")).otherwise(F.col("drawn")).alias("split"))
    if empty_splits:
        return dealt
    full = dealt.groupBy("parent").agg(F.countDistinct("split").alias("n")).where(F.col("n") == len(SPLITS))
    return dealt.join(full.select("parent"), "parent", "left_semi")


def split_by_tree(edges: DataFrame, shares: tuple[float, float, float], seed: int = 1) -> DataFrame:
    """Whole trees dealt to train, dev and test: (pid, split). Trees stand in the order of a hash of their root; each split gets its share, rounded down, and test the rest.

    A relation in several trees goes to test before dev, and to dev before train. Roots are held in one window; they are as many as trees.
    """
    from strandline.operators.hierarchy import closure

    tops = edges.select(F.col("parent").alias("root")).distinct().join(edges.select(F.col("child").alias("root")), "root", "left_anti")
    n = F.count(F.lit(1)).over(Window.partitionBy())
    placed = tops.withColumn("nth", F.row_number().over(Window.orderBy(_hashed(seed, "root"), "root"))).withColumn("n", n)
    train, dev = F.floor(F.col("n") * shares[0]), F.floor(F.col("n") * shares[1])
    dealt = checkpointed(placed.select("root", F.when(F.col("nth") <= train, SPLITS[0]).when(F.col("nth") <= train + dev, SPLITS[1]).otherwise(SPLITS[2]).alias("split")))
    below = closure(edges).select(F.col("anc").alias("root"), F.col("des").alias("pid")).distinct().join(dealt, "root").select("pid", "split")
    return single_split(dealt.select(F.col("root").alias("pid"), "split").unionByName(below))


def single_split(rows: DataFrame) -> DataFrame:
    """Each relation once: in test if it is there, else in dev, else in train: (pid, split)."""
    order = F.when(F.col("split") == "test", 0).when(F.col("split") == "dev", 1).otherwise(2)
    return rows.groupBy("pid").agg(F.min_by("split", order).alias("split"))


def sibling_pairs(splits: DataFrame, siblings: DataFrame, with_train: bool = False) -> DataFrame:
    """Unordered pairs of relations of one split, with 1 for siblings: (split, p1, p2, label); with `with_train` also dev and test against train.

    Relations number in the hundreds or thousands; every pair is a sample, so the pairs are what is wanted.
    """
    own = splits.select("split", F.col("pid").alias("p1"))
    other = splits.select("split", F.col("pid").alias("p2"))
    pairs = own.join(other, "split").where("p1 < p2")
    if with_train:
        train = other.where("split = 'train'").select("p2")
        pairs = pairs.unionByName(own.where("split <> 'train'").join(train, F.col("p1") != F.col("p2")).select("split", "p1", "p2"))
    truth = siblings.select(F.col("a").alias("p1"), F.col("b").alias("p2"), F.lit(1).alias("label")).distinct()
    return pairs.join(truth, ["p1", "p2"], "left").select("split", "p1", "p2", F.coalesce("label", F.lit(0)).alias("label"))


def neighbour_terms(occs: DataFrame, triples: DataFrame) -> DataFrame:
    """Relations around each sample's occurrences (sample, pid, h, t) and how often: (doc, term, cnt). Those with the sample's root relation are left out.

    What is around an entity is one row, and stays one when it is dealt to the entity's samples.
    """
    root = lambda c: F.substring_index(c, "_", 1)
    around = triples.where("r is not null").groupBy(F.col("h").alias("e"), "r").agg(F.count(F.lit(1)).alias("n"))
    around = around.groupBy("e").agg(F.sort_array(F.collect_list(F.concat(F.col("n").cast("string"), F.lit(":"), F.col("r")))).alias("terms"))
    ends = occs.select("sample", root("pid").alias("root"), F.explode(F.array("h", "t")).alias("e"))
    met = ends.join(around, "e").select("sample", "root", "terms").repartition("sample")
    one = met.select(F.col("sample").alias("doc"), "root", F.explode("terms").alias("x"))
    one = one.select("doc", "root", F.expr("substr(x, instr(x, ':') + 1)").alias("term"), F.substring_index("x", ":", 1).cast("long").alias("n"))
    return one.where(root(F.col("term")) != F.col("root")).groupBy("doc", "term").agg(F.sum("n").alias("cnt"))


def fitted_idf(counts: DataFrame, documents: DataFrame | None = None, shortest: int = 2) -> DataFrame:
    """Inverse document frequencies ln((1 + n) / (1 + df)) + 1 of the terms of (doc, term, cnt): (term, idf). Terms of less than `shortest` characters are no terms.

    `documents` (doc) are all that were fitted on, those without a term too; else those of the counts.
    """
    n = (counts if documents is None else documents).select("doc").distinct().agg(F.count(F.lit(1)).alias("n"))
    df = counts.where(F.length("term") >= shortest).groupBy("term").agg(F.countDistinct("doc").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def weighted_by(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """Weights cnt * idf of unit length a document, with frequencies fitted elsewhere: (doc, term, weight). Terms that weren't seen there are dropped."""
    raw = counts.join(idf, "term").select("doc", "term", (F.col("cnt") * F.col("idf")).alias("w"))
    return raw.select("doc", "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))).alias("weight"))


def sentence_contexts(sentences: DataFrame, distance: int, most: int | None = None, order: list[str] = ("h", "t")) -> DataFrame:
    """Words between head and tail of each relation's sentences and how often: (pid, word, cnt).

    Sentences are (pid, h, t, h_span, t_span, tokens) with spans as lists of places. Spans that overlap, touch, or lie more than `distance` words apart
    have no words between them. Of a relation the first `most` sentences by `order` count, where given.
    """
    rows = sentences
    if most is not None:
        nth = F.row_number().over(Window.partitionBy("pid").orderBy(*order))
        rows = rows.withColumn("_nth", nth).where(F.col("_nth") <= most)
    start = F.least(F.array_max("h_span"), F.array_max("t_span")) + 1
    stop = F.greatest(F.array_min("h_span"), F.array_min("t_span"))
    between = rows.withColumn("_from", start).withColumn("_to", stop).where((F.col("_to") > F.col("_from")) & (F.col("_to") - F.col("_from") <= distance))
    words = between.select("pid", F.explode(F.slice("tokens", F.col("_from") + 1, F.col("_to") - F.col("_from"))).alias("word"))
    return words.groupBy("pid", "word").agg(F.count(F.lit(1)).alias("cnt"))


def known_bags(contexts: DataFrame, vocabulary: DataFrame, samples: DataFrame) -> DataFrame:
    """Bags of numbered words for samples (sample, pid): (sample, ind, cnt), by the root of the sample's relation.

    Words that the vocabulary (word, ind) lacks are counted together under 0.
    """
    met = contexts.join(vocabulary, "word", "left").groupBy("pid", F.coalesce("ind", F.lit(0)).alias("ind")).agg(F.sum("cnt").alias("cnt"))
    return samples.select("sample", F.substring_index("pid", "_", 1).alias("pid")).join(met, "pid").select("sample", "ind", "cnt")


def all_of_one_root(edges: DataFrame) -> DataFrame:
    """Whether all of a relation's children have their name from it: (parent, split)."""
    return edges.groupBy("parent").agg(F.bool_and(F.substring_index("child", "_", 1) == F.substring_index("parent", "_", 1)).alias("split"))


def in_both(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Pairs (p1, p2) of which both relations are among the ids (pid)."""
    known = ids.select("pid").distinct()
    return pairs.join(known.select(F.col("pid").alias("p1")), "p1", "left_semi").join(known.select(F.col("pid").alias("p2")), "p2", "left_semi")

