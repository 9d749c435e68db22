"""Readers of the relation, feature, vector and annotation file formats, all over Spark's text and JSON sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators.loops import checkpointed
from strandline.operators.relations import ENTITY


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with a number in the order in which tasks read them, and their place in the order of files: path, first byte of the task's block, number."""
    nth = F.monotonically_increasing_id()
    place = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), nth.alias("nth"))
    return spark.read.text(path).select("value", F.input_file_name().alias("file"), nth.alias("pos"), place.alias("place"))


def _field(i: int, sep: str = "\t") -> Column:
    return F.get(F.split("value", sep), F.lit(i))


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated triples; lines with another number of fields are left out."""
    rows = spark.read.text(path).where(F.size(F.split("value", "\t")) == 3)
    return rows.select(_field(0).alias("h"), _field(1).alias("r"), _field(2).alias("t"))


def read_occurrences(spark: SparkSession, path: str, named: bool = False, entities_only: bool = True, most: int | None = None) -> DataFrame:
    """Occurrences of relations, a file each and named by it: h, t, or with `named` h, its name, t, its name.

    `most` rows of each file are kept after the filter, duplicates included.
    """
    rows = _lines(spark, path)
    h, t = (0, 2) if named else (0, 1)
    out = rows.select(F.regexp_extract("file", r"([^/]+?)\.txt(\.order)?$", 1).alias("pid"), "place", _field(h).alias("h"), _field(t).alias("t"), *([_field(1).alias("h_label"), _field(3).alias("t_label")] if named else []))
    if entities_only:
        out = out.where(F.col("h").rlike(ENTITY) & F.col("t").rlike(ENTITY))
    if most is not None:
        out = out.withColumn("nth", F.row_number().over(Window.partitionBy("pid").orderBy("place"))).where(F.col("nth") <= most).drop("nth")
    return out.drop("place")


def prefer(first: DataFrame, fallback: DataFrame, key: str = "pid") -> DataFrame:
    """Rows of the first source, and of the fallback those of keys that the first lacks."""
    return first.unionByName(fallback.join(first.select(key).distinct(), key, "left_anti"))


def read_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a parent and its children, each `id,label`; labels may hold commas."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("parts"))
    label = lambda c: F.when(F.instr(c, ",") > 0, F.regexp_replace(c, "^[^,]*,", ""))
    own = rows.select(F.get("parts", F.lit(0)).alias("parent_said"), F.posexplode(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0)))).alias("pos", "child_said"))
    p, c = F.col("parent_said"), F.col("child_said")
    return own.select(F.substring_index(p, ",", 1).alias("parent"), label(p).alias("parent_label"), F.substring_index(c, ",", 1).alias("child"), label(c).alias("child_label"), "pos")


def read_subgraphs(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a root and its edges `e1 p e2`; roots without edges have an empty list, a root's last line wins."""
    rows = _lines(spark, path).select(_field(0).alias("root"), "place", F.split("value", "\t").alias("parts"))
    edges = F.transform(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), lambda x: F.struct(F.split(x, " ")[0].alias("e1"), F.split(x, " ")[1].alias("p"), F.split(x, " ")[2].alias("e2")))
    return rows.groupBy("root").agg(F.max_by(edges, "place").alias("adj"))


def _pairs_from(parts: Column, first: int) -> Column:
    """Pairs (h, t) of consecutive entries."""
    n = F.floor((F.size(parts) - first) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(parts, i * 2 + first).alias("h"), F.get(parts, i * 2 + first + 1).alias("t")))).otherwise(F.array().cast("array<struct<h:string,t:string>>"))


def read_nway(spark: SparkSession, path: str, relations: DataFrame | None = None, per_relation: int | None = None, one_per_label: bool = False) -> DataFrame:
    """Samples `label TAB pid h t h t ...`: semi-join on relations, the first rows of each, runs of a label collapsed."""
    rows = _lines(spark, path).select("pos", _field(0).cast("int").alias("label"), F.split(_field(1), " ").alias("parts"))
    out = rows.select("pos", "label", F.get("parts", F.lit(0)).alias("pid"), _pairs_from(F.col("parts"), 1).alias("occs"))
    if relations is not None:
        out = out.join(relations, "pid", "left_semi")
    if per_relation is not None:
        out = out.withColumn("nth", F.row_number().over(Window.partitionBy("pid").orderBy("pos"))).where(F.col("nth") <= per_relation).drop("nth")
    if one_per_label:
        out = _runs_collapsed(out)
    return out.select("pos", "label", "pid", "occs")


def _runs_collapsed(rows: DataFrame) -> DataFrame:
    """Rows whose label differs from that of the row before. A task reads a stretch of the file, whose rows it numbers in a row; only the last label of each stretch goes on."""
    stretch = F.shiftright("pos", 33)
    held = checkpointed(rows.withColumn("_part", stretch))
    last = held.groupBy("_part").agg(F.max_by("label", "pos").alias("end"))
    # One row a stretch.
    before = last.select("_part", F.lag("end").over(Window.orderBy("_part")).alias("_before"), F.lit(True).alias("_any"))
    own = F.lag(F.struct("label")).over(Window.partitionBy("_part").orderBy("pos"))
    met = held.withColumn("_own", own).join(F.broadcast(before), "_part")
    first = F.col("_own").isNull() & (F.col("_part") == F.lit(0))
    was = F.when(F.col("_own").isNotNull(), F.col("_own.label")).otherwise(F.col("_before"))
    return met.where(~F.col("label").eqNullSafe(was) | first).select(*rows.columns)


def one_per_pair(samples: DataFrame, order: str = "pos") -> DataFrame:
    """Of the samples of one unordered pair of relations (p1, p2) the first."""
    nth = F.row_number().over(Window.partitionBy(F.least("p1", "p2"), F.greatest("p1", "p2")).orderBy(order, "p1"))
    return samples.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Relation ids: the first column."""
    return spark.read.text(path).where("value <> ''").select(_field(0).alias("pid"))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counted pairs: a, b and cnt by tabs."""
    return spark.read.text(path).where("value <> ''").select(_field(0).alias("a"), _field(1).alias("b"), _field(2).cast("long").alias("cnt"))


def read_list_map(spark: SparkSession, path: str, separator: str = "|||") -> DataFrame:
    """A key and its list: (key, vals). Of equal keys the last wins."""
    rows = _lines(spark, path).where("value <> ''").select(_field(0).alias("key"), F.split(_field(1), "".join(f"[{c}]" for c in separator)).alias("vals"), "place")
    return rows.groupBy("key").agg(F.max_by("vals", "place").alias("vals"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Articles in JSON lines (id, title, sections) as one text each, white space collapsed; articles without an id are left out: (id, text)."""
    rows = spark.read.schema("id string, title string, sections array<string>").json(path).where("id is not null and id <> ''")
    whole = F.array_join(F.concat(F.array(F.coalesce("title", F.lit(""))), F.coalesce("sections", F.array().cast("array<string>"))), " ")
    return rows.select("id", F.trim(F.regexp_replace(whole, r"[\x20\x09-\x0D]+", " ")).alias("text"))


def sampled_files(spark: SparkSession, path: str, n: int, seed: int = 0) -> DataFrame:
    """Lines of n of a folder's files, drawn by the hash of seed and name, with the file that each comes from: (file, value)."""
    files = spark.read.format("binaryFile").load(path).select("path").distinct()
    some = files.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.regexp_extract("path", "[^/]*$", 0))), "path").limit(n)
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), "value")
    return rows.join(F.broadcast(some.select(F.regexp_extract("path", "[^/]*$", 0).alias("_name"))), F.regexp_extract("file", "[^/]*$", 0) == F.col("_name"), "left_semi")


def read_see_also(lines: DataFrame, edges: DataFrame, split_of: DataFrame, split: str | None = None) -> DataFrame:
    """Neighbours (pid, other) of relations from lines (pid, other), ids of split relations (name, pid) mapped to their base relation.

    With `split`, relations of that split (split, pid) have their siblings in it instead.
    """
    base = lambda c: F.substring_index(c, "_", 1)
    own = lines.select(base("pid").alias("pid"), base("other").alias("other")).where("pid <> other").distinct()
    if split is None:
        return own
    there = split_of.where(F.col("split") == split).select("pid").distinct()
    a = edges.join(there.withColumnRenamed("pid", "child"), "child", "left_semi")
    met = a.select("parent", F.col("child").alias("pid")).join(a.select("parent", F.col("child").alias("other")), "parent").where("pid <> other").select("pid", "other").distinct()
    return own.join(met.select("pid").distinct(), "pid", "left_anti").unionByName(met)


def read_pointwise(spark: SparkSession, path: str) -> DataFrame:
    """Samples `label TAB p1 h t ... TAB p2 h t ...` of different relations."""
    rows = _lines(spark, path).select("pos", _field(0).cast("int").alias("label"), F.split(_field(1), " ").alias("x"), F.split(_field(2), " ").alias("y"))
    out = rows.select("pos", "label", F.get("x", F.lit(0)).alias("p1"), _pairs_from(F.col("x"), 1).alias("occs1"), F.get("y", F.lit(0)).alias("p2"), _pairs_from(F.col("y"), 1).alias("occs2"))
    return out.where("p1 <> p2")


def read_bags(spark: SparkSession, path: str) -> DataFrame:
    """A bag `id count TAB id count ...` a line; blank lines are empty bags and keep their number."""
    rows = _lines(spark, path)
    entries = F.filter(F.split("value", "\t"), lambda x: x != "")
    return rows.select(F.col("pos").alias("sample_id"), F.transform(entries, lambda x: F.struct(F.split(x, " ")[0].cast("int").alias("wid"), F.split(x, " ")[1].cast("int").alias("cnt"))).alias("bag"))


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """Sentences and their counts in turn, by tabs: `w w w TAB count TAB ...`."""
    rows = _lines(spark, path).select(F.col("pos").alias("sample_id"), F.split("value", "\t").alias("parts"))
    n = F.floor(F.size("parts") / 2).cast("int")
    sents = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.transform(F.split(F.get("parts", i * 2), " "), lambda x: x.cast("int")).alias("toks"), F.get("parts", i * 2 + 1).cast("int").alias("cnt")))
    return rows.select("sample_id", F.when(n > 0, sents).otherwise(F.array().cast("array<struct<toks:array<int>,cnt:int>>")).alias("sents"))


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """Two columns by tab; blank lines are left out and of equal keys the last wins."""
    rows = _lines(spark, path).where("value <> ''").select(_field(0).alias("key"), _field(1).alias("val"), "place")
    return rows.groupBy("key").agg(F.max_by("val", "place").alias("val"))


def read_vectors(spark: SparkSession, path: str, size: int, sep: str = "\t", unwrap: bool = False, header: bool = False) -> DataFrame:
    """Vectors of a fixed size as text; a line of another size raises. `unwrap` takes the last part of `<.../id>`.

    With `header` the lines of two numbers after a word, or of two numbers alone, which tell the file's size, are left out.
    """
    parts = F.split("value", sep)
    own = F.regexp_extract(parts[0], r"([^/<>]+)>?$", 1) if unwrap else parts[0]
    vec = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).cast("array<float>")
    checked = F.when(F.size(vec) == size, vec).otherwise(F.raise_error(F.lit(f"a vector is not of size {size}")).cast("array<float>"))
    rows = spark.read.text(path).where("value <> ''")
    rows = rows.where(~F.col("value").rlike(r"^(\S+\s+)?[0-9]+\s+[0-9]+\s*$")) if header else rows
    return rows.select(own.alias("id"), checked.alias("vec"))


def indexed_vectors(vectors: DataFrame, pad: str = "<PAD>") -> DataFrame:
    """Vectors with an index from 1 in the order of their ids, and a padding row of zeros at 0: (ind, id, vec).

    Ids are numbered in ranges, so no task holds them all.
    """
    ranged = checkpointed(vectors.repartitionByRange("id").withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    # One row a range.
    before = counts.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy("id"))
    numbered = ranged.withColumn("_nth", nth).join(F.broadcast(before), "_part").select((F.col("before") + F.col("_nth")).alias("ind"), "id", "vec")
    first = vectors.limit(1).select(F.lit(0).cast("long").alias("ind"), F.lit(pad).alias("id"), F.transform("vec", lambda x: F.lit(0.0).cast("float")).alias("vec"))
    return first.unionByName(numbered)


def read_mentions(spark: SparkSession, path: str) -> DataFrame:
    """Mentions of documents: `sid TAB start end id TAB ...`."""
    rows = spark.read.text(path).select(_field(0).cast("long").alias("sid"), F.split("value", "\t").alias("parts"))
    one = rows.select("sid", F.explode(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0)))).alias("m")).select("sid", F.split("m", " ").alias("m"))
    return one.select("sid", F.col("m")[0].cast("int").alias("start"), F.col("m")[1].cast("int").alias("end"), F.col("m")[2].alias("wdid"))


LINKED = "url string, id array<bigint>, text string, annotations array<struct<offset:int,surface_form:string,uri:string>>"


def read_linked_articles(spark: SparkSession, path: str) -> DataFrame:
    """Annotations of linked articles in JSON lines, bz2 too: the span ends where the surface form does."""
    rows = spark.read.schema(LINKED).json(path).select("url", F.explode("annotations").alias("a"))
    return rows.select("url", F.col("a.offset").alias("start"), (F.col("a.offset") + F.length("a.surface_form")).alias("end"), "a.surface_form", "a.uri")


def read_relation_sentences(spark: SparkSession, path: str) -> DataFrame:
    """Sentences by relation in one JSON object a file: head and tail with a single span."""
    schema = "map<string,array<struct<tokens:array<string>,h:array<string>,t:array<string>>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)).alias("pid", "sents"))
    one = rows.select("pid", F.explode("sents").alias("s"))
    span = lambda side: F.from_json(F.col(f"s.{side}")[2], "array<array<int>>")
    out = one.select("pid", "s.tokens", F.col("s.h")[1].alias("h"), F.col("s.t")[1].alias("t"), span("h").alias("hs"), span("t").alias("ts"))
    return out.where((F.size("hs") == 1) & (F.size("ts") == 1)).select("pid", "h", "t", F.col("hs")[0].alias("h_span"), F.col("ts")[0].alias("t_span"), "tokens")


#: A field of an INSERT tuple: quoted with escapes, or up to the next comma.
_FIELD = r"'(?:[^'\\]|\\.)*'|[^,()]+"
_TUPLE = rf"\(((?:{_FIELD})(?:,(?:{_FIELD}))*)\)"


def dump_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names of a dump's first CREATE TABLE statement, in its order: the quoted names that lines begin with, up to the first key or the end.

    Lines keep their order by file and place; those that can hold a name are as many as the tables have columns, and come to the driver.
    """
    lines = _lines(spark, path).where(r"value rlike '^(CREATE TABLE|\\s*`|\\s*(PRIMARY|UNIQUE|KEY|INDEX|CONSTRAINT|FULLTEXT)|\\))' and not value like 'INSERT%'")
    found: list[str] | None = None
    for (value,) in lines.orderBy("place").select(F.substring("value", 1, 1000)).collect():
        if value.startswith("CREATE TABLE"):
            if found is not None:
                break
            found = []
        elif found is not None:
            if not value.lstrip().startswith("`"):
                break
            found.append(value.split("`")[1])
    if not found:
        raise ValueError("the dump has no CREATE TABLE statement with quoted column names")
    return found


def _insert_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("value like 'INSERT INTO%'").select(F.expr("substring(value, instr(value, 'VALUES') + 6)").alias("value"))


def read_dump(spark: SparkSession, path: str, columns: list[str] | None = None, keep: dict[str, str] | None = None) -> DataFrame:
    """Rows of a database dump's INSERT lines, gzip too. Quoted fields may hold commas, brackets and escapes.

    Columns are those of the dump's CREATE TABLE, unless the caller names them. Tuples with another number of fields are left out
    (`dump_faults` counts them); `keep` holds values that columns must have.
    """
    columns = columns or dump_columns(spark, path)
    tuples = _insert_lines(spark, path).select(F.explode(F.regexp_extract_all("value", F.lit(_TUPLE), F.lit(1))).alias("t"))
    fields = tuples.select(F.regexp_extract_all("t", F.lit(_FIELD), F.lit(0)).alias("f")).where(F.size("f") == len(columns))
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"^'|'$", ""), r"\\(.)", "$1")
    out = fields.select(*[plain(F.col("f")[i]).alias(c) for i, c in enumerate(columns)])
    for c, v in (keep or {}).items():
        out = out.where(F.col(c) == v)
    return out


def dump_faults(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """One row: tuples of a dump, those with another number of fields than its columns, and stretches between tuples that are none."""
    columns = columns or dump_columns(spark, path)
    lines = _insert_lines(spark, path)
    found = lines.select(F.explode(F.regexp_extract_all("value", F.lit(_TUPLE), F.lit(1))).alias("t")).select((F.size(F.regexp_extract_all("t", F.lit(_FIELD), F.lit(0))) != len(columns)).cast("long").alias("other"))
    left = lines.select(F.explode(F.split(F.regexp_replace("value", _TUPLE, "\u0001"), "\u0001")).alias("rest")).where(r"not rest rlike '^[\\s,;]*$'")
    counts = found.agg(F.count(F.lit(1)).alias("tuples"), F.coalesce(F.sum("other"), F.lit(0)).alias("malformed"))
    return counts.crossJoin(F.broadcast(left.agg(F.count(F.lit(1)).alias("broken"))))


def read_names(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """Names of known entities, `id TAB name TAB alias||alias`: the name first."""
    rows = spark.read.text(path).select(_field(0).alias("entity"), _field(1).alias("name"), F.coalesce(_field(2), F.lit("")).alias("aka"))
    names = F.array_distinct(F.concat(F.array("name"), F.filter(F.split("aka", r"\|\|"), lambda x: x != "")))
    return rows.join(known.select("entity").distinct(), "entity", "left_semi").select("entity", names.alias("names"))
