"""Operators on sets of samples, contexts and names: capped keys, grouped lists, filters by vector and sub-graph, pairs of samples, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.loops import few
from strandline.operators.relations import numbered


def capped_keys(counts: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """Of each relation the first `most` keys to appear (smallest `order`, then key), with all their counts: (pid, key, cnt)."""
    seen = counts.groupBy("pid", key).agg(F.sum("cnt").alias("cnt"), F.min(order).alias("first"))
    nth = F.row_number().over(Window.partitionBy("pid").orderBy("first", key))
    return seen.withColumn("_nth", nth).where(F.col("_nth") <= most).select("pid", key, "cnt")


def grouped_lists(rows: DataFrame, key: str, value: str, known: DataFrame | None = None, separator: str = " ") -> DataFrame:
    """Each key's distinct values in ascending order as one line: (key, n, line); keys that `known` lacks are dropped."""
    own = rows.select(key, value).distinct()
    own = own if known is None else own.join(known.select(key).distinct(), key, "left_semi")
    held = own.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.col(value).cast("string"))).alias("all"))
    return held.select(key, "n", F.array_join("all", separator).alias("line"))


def count_statistics(counts: DataFrame) -> DataFrame:
    """Mean and sum of each relation's counts: (pid, keys, mean, total)."""
    return counts.groupBy("pid").agg(F.count(F.lit(1)).alias("keys"), F.avg("cnt").alias("mean"), F.sum("cnt").alias("total"))


def name_words(occs: DataFrame, names: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Counts (pid, word, cnt) of the lower-case words of the names (entity, name) of occurrences' heads and tails that the vocabulary has."""
    named = [occs.join(names.select(F.col("entity").alias(side), "name"), side).select("pid", "name") for side in ("h", "t")]
    words = named[0].unionByName(named[1]).select("pid", F.explode(F.split(F.lower("name"), "\\s+")).alias("word")).where("word <> ''")
    return words.join(vocabulary.select("word").distinct(), "word", "left_semi").groupBy("pid", "word").agg(F.count(F.lit(1)).alias("cnt"))


def whole_subgraphs(subgraphs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Roots of sub-graphs (root, id) of which every id has a vector (key)."""
    lacking = subgraphs.join(vectors.select(F.col("key").alias("id")).distinct(), "id", "left_anti").select("root").distinct()
    return subgraphs.select("root").distinct().join(lacking, "root", "left_anti")


def with_subgraph_and_vector(occs: DataFrame, subgraphs: DataFrame, vectors: DataFrame, most: int | None = None) -> DataFrame:
    """Distinct occurrences whose relation has a vector (key) and whose entities have one and a sub-graph without gaps; the first `most` of each relation."""
    keys = vectors.select("key").distinct()
    fine = whole_subgraphs(subgraphs, vectors).join(keys.withColumnRenamed("key", "root"), "root", "left_semi")
    # Many keys and few relations: which of them have a vector is found first.
    pids = few(occs.select("pid").distinct().join(keys.withColumnRenamed("key", "pid"), "pid", "left_semi"))
    out = occs.select("pid", "h", "t").distinct().join(pids, "pid", "left_semi")
    for side in ("h", "t"):
        out = out.join(fine.withColumnRenamed("root", side), side, "left_semi")
    if most is None:
        return out.select("pid", "h", "t")
    nth = F.row_number().over(Window.partitionBy("pid").orderBy("h", "t"))
    return out.withColumn("_nth", nth).where(F.col("_nth") <= most).select("pid", "h", "t")


def literal_ids(lines: DataFrame, predicate: str) -> DataFrame:
    """Subject and literal object of the N-Triples lines (value) with one predicate whose object begins with /m/: (id, mid)."""
    found = lambda pattern: F.regexp_extract("value", pattern, 1)
    rows = lines.select(found(r"^<[^>]*/([^/>]+)>").alias("id"), found(r"^\S+\s+<[^>]*/([^/>]+)>").alias("r"), found(r'^\S+\s+\S+\s+"(/m/[^"]*)"').alias("mid"))
    return rows.where((F.col("r") == predicate) & (F.col("mid") != "") & (F.col("id") != "")).select("id", "mid")


def relations_of_kind(definitions: DataFrame, kind: str = "wikibase-item") -> DataFrame:
    """Ids of the property definitions (id, datatype) of another data type."""
    return definitions.where(~F.col("datatype").eqNullSafe(kind)).select("id").distinct()


def known_or_pad(samples: DataFrame, column: str, top: DataFrame, pad: str = "<PAD>") -> DataFrame:
    """Ids outside the top ones (id) become padding; ids that are no entity or relation raise."""
    known = top.select(F.col("id").alias(column), F.lit(True).alias("_known")).distinct()
    fine = F.col(column).rlike("^[QP][0-9]")
    value = F.when(~fine, F.raise_error(F.concat(F.lit("no entity or relation: "), F.col(column)))).when(F.col("_known"), F.col(column)).otherwise(F.lit(pad))
    return samples.join(known, column, "left").withColumn(column, value).drop("_known")


def filtered_samples(samples: DataFrame, leaves: DataFrame | None = None, labels: DataFrame | None = None, first_only: bool = False) -> DataFrame:
    """Samples (pid, label, sample) without those of leaf relations, with labels of a set only, and the first of each relation, as asked for."""
    out = samples if leaves is None else samples.join(leaves.select("pid").distinct(), "pid", "left_anti")
    out = out if labels is None else out.join(labels.select("label").distinct(), "label", "left_semi")
    if not first_only:
        return out
    nth = F.row_number().over(Window.partitionBy("pid").orderBy("sample", "label"))
    return out.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def common_labels(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.select("label").intersect(test.select("label"))


def either_side(h: DataFrame, t: DataFrame) -> DataFrame:
    """Sentences (pid, sid) of head or tail with whether both have them, those of both first: (pid, sid, both, nth)."""
    sides = h.select("pid", "sid", F.lit(1).alias("side")).unionByName(t.select("pid", "sid", F.lit(2).alias("side"))).distinct()
    both = sides.groupBy("pid", "sid").agg((F.count(F.lit(1)) == 2).alias("both"))
    return numbered(both, both.groupBy("pid").agg(F.count(F.lit(1)).alias("n")), [F.desc("both"), "sid"], "nth")


def merged_lists(frames: list[DataFrame], key: str, value: str) -> DataFrame:
    """The lists that several sources have under one key, one after the other: (key, values), in the order of source and place."""
    tagged = [f.select(key, F.lit(i).alias("source"), F.posexplode(value).alias("place", "value")) for i, f in enumerate(frames)]
    out = tagged[0]
    for f in tagged[1:]:
        out = out.unionByName(f)
    held = out.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("source", "place", "value"))).alias("all"))
    return held.select(key, F.transform("all", lambda x: x["value"]).alias(value))


def sample_pairs(chunks: DataFrame, pairs: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Pairs of occurrence chunks (pid, chunk) of each pair of relations (p1, p2): (p1, p2, c1, c2).

    All of them where they are at most `n`; else `n` draws with replacement by the hash of seed, pair and number of the draw. Chunks are
    numbered from 0 in each relation, so a draw is a number and no chunk is held to draw from.
    """
    sizes = chunks.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    side = lambda i: sizes.select(F.col("pid").alias(f"p{i}"), F.col("n").alias(f"n{i}"))
    both = pairs.select("p1", "p2").distinct().join(side(1), "p1").join(side(2), "p2")
    every = both.where(F.col("n1") * F.col("n2") <= n)
    every = every.withColumn("c1", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n1") - 1))).withColumn("c2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n2") - 1)))
    draws = both.where(F.col("n1") * F.col("n2") > n).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def drawn(side: int) -> Column:
        key = F.md5(F.concat_ws("|", F.lit(f"{seed}:{side}"), "p1", "p2", F.col("draw").cast("string")))
        return F.pmod(F.conv(F.substring(key, 1, 12), 16, 10).cast("long"), F.col(f"n{side}"))

    some = draws.withColumns({"c1": drawn(1), "c2": drawn(2)})
    return every.select("p1", "p2", "c1", "c2").unionByName(some.select("p1", "p2", "c1", "c2"))


def mapped_counts(counts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Counts (h, t, pid, cnt) under foreign ids, summed by relation over the pairs of which both sides are mapped (foreign, own)."""
    side = lambda s: mapping.select(F.col("foreign").alias(s), F.col("own").alias(f"own_{s}"))
    return counts.join(side("h"), "h").join(side("t"), "t").groupBy("pid").agg(F.sum("cnt").alias("cnt"), F.count_distinct("own_h", "own_t").alias("pairs"))


def zipped(left: DataFrame, right: DataFrame, at: str = "line") -> DataFrame:
    """Two numbered files line by line; a line that one of them lacks raises."""
    met = left.withColumn("_left", F.lit(True)).join(right.withColumn("_right", F.lit(True)), at, "full")
    lone = F.raise_error(F.concat(F.lit("the other file lacks line "), F.col(at).cast("string"))).cast("boolean")
    return met.where(F.when(F.col("_left") & F.col("_right"), F.lit(True)).otherwise(lone)).drop("_left", "_right")


def split_labels(names: DataFrame, labels: DataFrame, entities: DataFrame) -> DataFrame:
    """Labels of relations split by type: the base relation's label and the type entities' names (the id where unknown), joined by _: (name, label)."""
    parts = names.select("name", F.posexplode(F.split("name", "_")).alias("pos", "part"))
    base = labels.select(F.col("pid").alias("part"), "label")
    known = entities.groupBy(F.col("entity").alias("part")).agg(F.min("name").alias("known"))
    said = parts.join(base, "part", "left").join(known, "part", "left")
    piece = F.when(F.col("pos") == 0, F.coalesce("label", "part")).otherwise(F.coalesce("known", "part"))
    held = said.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece")))).alias("all"))
    return held.select("name", F.array_join(F.transform("all", lambda x: x["piece"]), "_").alias("label"))


def by_number(df: DataFrame, column: str) -> DataFrame:
    """Rows in the order of the number in an id: P9 before P10."""
    return df.orderBy(F.substring(F.col(column), 2, 1_000).cast("long"), column)


def halves_down_the_tree(occs: DataFrame, edges: DataFrame, seed: str = "half") -> DataFrame:
    """Occurrences without overlap between a parent and its children: of what two of them share, a half by hash stays with the parent, the other with the child.

    Rows (pid, h, t, kept). A pair's half is the parity of the hash of seed, parent, head and tail.
    """
    own = occs.select("pid", "h", "t").distinct()
    half = lambda p: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), p, "h", "t")), 1, 8), 16, 10).cast("long") % 2
    up = own.join(edges.select(F.col("child").alias("pid"), "parent").distinct(), "pid")
    shared = up.join(own.select(F.col("pid").alias("parent"), "h", "t"), ["parent", "h", "t"]).withColumn("half", half("parent"))
    lost = shared.select(F.when(F.col("half") == 0, F.col("pid")).otherwise(F.col("parent")).alias("pid"), "h", "t").distinct().withColumn("lost", F.lit(True))
    return own.join(lost, ["pid", "h", "t"], "left").select("pid", "h", "t", F.col("lost").isNull().alias("kept"))


def surface_forms(entities: DataFrame) -> DataFrame:
    """Surface forms of entities (entity, name, aliases): the name without its parenthesis, and distinct aliases: (entity, surface, canonical)."""
    bare = F.trim(F.regexp_replace("name", r"\s*\([^()]*\)\s*$", ""))
    all_forms = F.array_distinct(F.concat(F.array(bare), F.coalesce("aliases", F.array().cast("array<string>"))))
    return entities.where("name is not null").select("entity", F.posexplode(all_forms).alias("nth", "surface")).where("surface <> ''").select("entity", "surface", (F.col("nth") == 0).alias("canonical"))


def plain_prompts(prompts: DataFrame, stop_words: list[str], slots: tuple[str, str] = ("[X]", "[Y]"), marks: str = r"^[\p{Punct}]+$") -> DataFrame:
    """Prompts (prompt) with a word besides stop words, punctuation and slots, not bounded by slots on both ends, and without capitals outside slots."""
    words = F.split("prompt", " ")
    is_slot = lambda w: w.isin(*slots)
    some = F.exists(words, lambda w: ~(is_slot(w) | F.lower(w).isin(stop_words) | w.rlike(marks)))
    bounded = is_slot(F.element_at(words, 1)) & is_slot(F.element_at(words, -1))
    capital = F.exists(words, lambda w: ~is_slot(w) & w.rlike("[A-Z]"))
    return prompts.where(some & ~bounded & ~capital)


def only_by_path(prompts: DataFrame, least: int = 10, slots: tuple[str, str] = ("[X]", "[Y]")) -> DataFrame:
    """Prompts (prompt, cnt) that are frequent and that a path alone gives: not bounded by slots on both ends, and without a word that begins with a capital.

    Full stops and blanks at the end don't count.
    """
    bare = F.trim(F.regexp_replace("prompt", r"\.+$", ""))
    bounded = lambda end: F.greatest(*[end(bare, F.lit(s)) for s in slots])
    capital = F.exists(F.split(bare, " "), lambda w: w.rlike(r"^\p{Lu}"))
    return prompts.where((F.col("cnt") >= least) & ~(bounded(F.startswith) & bounded(F.endswith)) & ~capital)


def tokens_of(tokens: DataFrame, sentences: DataFrame, key: str = "sid") -> DataFrame:
    """Token rows of the named sentences alone."""
    return tokens.join(sentences.select(key).distinct(), key, "left_semi")
