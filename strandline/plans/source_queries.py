"""Queries that write a table in one of the file formats and read it back, each with the SQL of the table itself."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.loops import checkpointed
from strandline.sources import bindings as B
from strandline.sources import readers as R
from strandline.sources import writers as W


def written(lines: DataFrame) -> str:
    """A new folder of text files with the lines (value), under the checkpoint folder, which executors share."""
    spark = lines.sparkSession
    checkpointed(spark.range(1))  # names the checkpoint folder where the session has none
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/written-{uuid.uuid4().hex}"
    lines.select("value").write.text(folder)
    return folder


def _read(reader, lines: DataFrame, *more, **named) -> DataFrame:
    return reader(lines.sparkSession, written(lines), *more, **named)


def _tabs(*columns) -> Column:
    return F.concat_ws("\t", *[c if not isinstance(c, str) else F.col(c).cast("string") for c in columns]).alias("value")


def _orders_by_customer(s, d):
    own = B.table(s, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("o"))
    return own


def _sample_lines(s, d):
    """N-way samples: a customer's orders as pairs of key and status, labelled by nation."""
    pairs = F.array_join(F.transform("o", lambda x: F.concat_ws(" ", x["o_orderkey"].cast("string"), x["o_orderstatus"])), " ")
    return _orders_by_customer(s, d).select(_tabs(F.col("o_custkey") % 7, F.concat_ws(" ", F.concat(F.lit("P"), F.col("o_custkey").cast("string")), pairs)))


def _tree(s, d):
    edges = B.tree(s, d)
    own = edges.groupBy("parent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "child"))), lambda x: F.concat(x["child"], F.lit(",a, b of "), x["child"])), "\t").alias("children"))
    return own.select(F.concat_ws("\t", F.concat("parent", F.lit(",top "), F.col("parent")), "children").alias("value"))


def _vector_lines(s, d):
    return B.vectors(s, d).select(F.concat_ws("\t", F.concat(F.lit("<http://kb.example/"), F.col("id").cast("string"), F.lit(">")), F.array_join(F.transform("vec", lambda x: x.cast("string")), "\t")).alias("value"))


def _articles(s, d):
    """Linked articles: a document's first word is its annotation."""
    docs = B.table(s, d, "documents").where("length(text) > 0")
    note = F.struct(F.lit(0).alias("offset"), F.regexp_extract("text", r"^\S*", 0).alias("surface_form"), F.col("lang").alias("uri"))
    row = F.struct(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.array("doc_id").alias("id"), "text", F.array(note).alias("annotations"))
    return docs.select(F.to_json(row).alias("value"))


#: A dump's statement before its rows, one line a column.
_DUMP_HEAD = ["-- dump", "CREATE TABLE `page` (", "  `page_id` int NOT NULL,", "  `page_namespace` int,", "  `page_title` varbinary(255) DEFAULT '',", "  `more` text,", "  PRIMARY KEY (`page_id`),", "  KEY `more` (`more`)", ");"]


def _dump_head(s):
    """The statement's lines in one file, in their order: no shuffle, which would take them as blocks arrive."""
    return s.createDataFrame([(x,) for x in _DUMP_HEAD], "value string").coalesce(1)


def _dump_lines(s, d, faults=False):
    """Customers as tuples of a dump; with `faults` every line has one of three fields and a stretch that is no tuple."""
    quoted = lambda c: F.concat(F.lit("'"), F.regexp_replace(F.col(c), "'", "\\\\'"), F.lit("'"))
    one = F.concat(F.lit("("), F.col("c_custkey").cast("string"), F.lit(",0,"), quoted("c_name"), F.lit(",'a, (b) \\'c\\''"), F.lit(")"))
    rows = B.table(s, d, "customer").groupBy((F.col("c_custkey") % 50).alias("k")).agg(F.array_join(F.collect_list(one), ",").alias("v"))
    more = F.lit(",(1,0,'short'),((torn") if faults else F.lit("")
    head = _dump_head(s)
    return head.unionAll(rows.select(F.concat(F.lit("INSERT INTO `page` VALUES "), F.col("v"), more, F.lit(";")).alias("value")))


def _mention_lines(s, d):
    own = B.mentions(s, d).groupBy("sid").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", F.col("start").cast("string"), F.col("end").cast("string"), "wdid"))), "\t").alias("m"))
    return own.select(_tabs("sid", F.col("m")))


CATALOG = {
    "read_triples": (lambda s, d: _read(R.read_triples, B.triples(s, d).select(_tabs("h", "r", "t")).unionAll(s.createDataFrame([("one\ttwo",), ("",), ("a\tb\tc\td",)], "value string"))), B.with_views("triples", "SELECT h, r, t FROM triples")),
    "read_hierarchy": (
        lambda s, d: _read(R.read_hierarchy, _tree(s, d)).select("parent", "parent_label", "child", "child_label", F.col("pos").cast("long").alias("pos")),
        B.with_views("tree", "SELECT parent, 'top ' || parent AS parent_label, child, 'a, b of ' || child AS child_label, row_number() OVER (PARTITION BY parent ORDER BY pos) - 1 AS pos FROM tree"),
    ),
    "read_subgraphs": (
        lambda s, d: _read(R.read_subgraphs, _orders_by_customer(s, d).select(_tabs(F.col("o_custkey").cast("string"), F.array_join(F.transform("o", lambda x: F.concat_ws(" ", F.col("o_custkey").cast("string"), x["o_orderstatus"], x["o_orderkey"].cast("string"))), "\t"))))
        .select("root", F.explode("adj").alias("e")).select("root", "e.*"),
        "SELECT CAST(o_custkey AS VARCHAR) AS root, CAST(o_custkey AS VARCHAR) AS e1, o_orderstatus AS p, CAST(o_orderkey AS VARCHAR) AS e2 FROM orders",
    ),
    "read_nway": (
        lambda s, d: _read(R.read_nway, _sample_lines(s, d)).select(F.col("label").cast("long").alias("label"), "pid", F.explode("occs").alias("o")).select("label", "pid", "o.h", "o.t"),
        "SELECT o_custkey % 7 AS label, 'P' || CAST(o_custkey AS VARCHAR) AS pid, CAST(o_orderkey AS VARCHAR) AS h, o_orderstatus AS t FROM orders",
    ),
    "write_nway": (
        lambda s, d: W.nway_lines(_read(R.read_nway, _sample_lines(s, d))).select("value"),
        "SELECT CAST(o_custkey % 7 AS VARCHAR) || chr(9) || 'P' || CAST(o_custkey AS VARCHAR) || ' ' || string_agg(CAST(o_orderkey AS VARCHAR) || ' ' || o_orderstatus, ' ' ORDER BY o_orderkey) AS value FROM orders GROUP BY o_custkey",
    ),
    "read_pointwise": (
        lambda s, d: _read(R.read_pointwise, B.table(s, d, "orders").select(_tabs(F.col("o_orderkey") % 2, F.concat(F.lit("P1 Q1 Q"), F.col("o_orderkey").cast("string")), F.concat(F.lit("P"), (F.col("o_orderkey") % 3).cast("string"), F.lit(" Q2 Q3 Q4 Q"), F.col("o_custkey").cast("string")))))
        .select(F.col("label").cast("long").alias("label"), "p2", F.col("occs1")[0]["t"].alias("t1"), F.size("occs2").cast("long").alias("n2"), F.col("occs2")[1]["t"].alias("t2")),
        "SELECT o_orderkey % 2 AS label, 'P' || CAST(o_orderkey % 3 AS VARCHAR) AS p2, 'Q' || CAST(o_orderkey AS VARCHAR) AS t1, CAST(2 AS BIGINT) AS n2, 'Q' || CAST(o_custkey AS VARCHAR) AS t2 FROM orders WHERE o_orderkey % 3 <> 1",
    ),
    "read_pointwise_once": (
        lambda s, d: R.one_per_pair(_read(R.read_pointwise, B.table(s, d, "lineitem").select(_tabs(F.col("l_orderkey"), F.concat(F.lit("P"), (F.col("l_suppkey") % 5).cast("string"), F.lit(" Q1 Q2")), F.concat(F.lit("P"), (F.col("l_partkey") % 5).cast("string"), F.lit(" Q3 Q4"))))), "label")
        .select(F.col("label").cast("long").alias("label"), F.least("p1", "p2").alias("a"), F.greatest("p1", "p2").alias("b")),
        "SELECT min(l_orderkey) AS label, least(x, y) AS a, greatest(x, y) AS b FROM (SELECT l_orderkey, 'P' || CAST(l_suppkey % 5 AS VARCHAR) AS x, 'P' || CAST(l_partkey % 5 AS VARCHAR) AS y FROM lineitem) WHERE x <> y GROUP BY 2, 3",
    ),
    "read_bags": (
        lambda s, d: _read(R.read_bags, _orders_by_customer(s, d).select(F.array_join(F.transform("o", lambda x: F.concat_ws(" ", x["o_orderkey"].cast("string"), F.col("o_custkey").cast("string"))), "\t").alias("value"))).select(F.explode("bag").alias("b")).select(F.col("b.wid").cast("long").alias("wid"), F.col("b.cnt").cast("long").alias("cnt")),
        "SELECT o_orderkey AS wid, o_custkey AS cnt FROM orders",
    ),
    "read_sentences": (
        lambda s, d: _read(R.read_sentences, B.table(s, d, "orders").select(_tabs(F.concat_ws(" ", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")), F.col("o_custkey") % 9, "o_orderkey", F.lit("1")))).select(F.explode("sents").alias("s")).select(F.array_join("s.toks", " ").alias("toks"), F.col("s.cnt").cast("long").alias("cnt")),
        "SELECT CAST(o_orderkey AS VARCHAR) || ' ' || CAST(o_custkey AS VARCHAR) AS toks, o_custkey % 9 AS cnt FROM orders UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 1 FROM orders",
    ),
    "read_map": (lambda s, d: _read(R.read_map, B.table(s, d, "customer").select(_tabs("c_custkey", "c_name")).unionAll(s.createDataFrame([("",)], "value string"))), "SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS val FROM customer"),
    "read_vectors": (
        lambda s, d: _read(R.read_vectors, _vector_lines(s, d), 64, unwrap=True).select("id", F.posexplode("vec").alias("dim", "x")).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("x").cast("double") * (F.col("dim") + 1)), 3).alias("x")),
        B.with_views("vectors", "SELECT CAST(id AS VARCHAR) AS id, CAST(count(*) AS BIGINT) AS n, round(sum(x * (dim + 1)), 3) AS x FROM (SELECT id, unnest(range(64)) AS dim, CAST(unnest(vec) AS DOUBLE) AS x FROM vectors) GROUP BY id"),
    ),
    "indexed_vectors": (
        lambda s, d: R.indexed_vectors(_read(R.read_vectors, s.createDataFrame([("w 1 2",)], "value string").unionAll(_vector_lines(s, d)), 64, header=True, unwrap=True)).select(F.col("ind").cast("long").alias("ind"), "id", F.size("vec").cast("long").alias("n")),
        B.with_views("vectors", "SELECT row_number() OVER (ORDER BY CAST(id AS VARCHAR)) AS ind, CAST(id AS VARCHAR) AS id, CAST(64 AS BIGINT) AS n FROM vectors UNION ALL SELECT 0, '<PAD>', 64"),
    ),
    "read_mentions": (
        lambda s, d: _read(R.read_mentions, _mention_lines(s, d)).select("sid", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "wdid"),
        B.with_views("tokens lexicon mentions", 'SELECT sid, start, end_ AS "end", wdid FROM mentions'),
    ),
    "read_linked_articles": (
        lambda s, d: _read(R.read_linked_articles, _articles(s, d)).select("url", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "surface_form", "uri"),
        r"""SELECT 'u' || CAST(doc_id AS VARCHAR) AS url, CAST(0 AS BIGINT) AS start, length(w) AS "end", w AS surface_form, lang AS uri FROM (SELECT doc_id, lang, regexp_extract(text, '^[^\x20\x09-\x0D]*') AS w FROM documents WHERE length(text) > 0)""",
    ),
    "read_dump": (
        lambda s, d: _read(R.read_dump, _dump_lines(s, d), keep={"page_namespace": "0"}),
        "SELECT CAST(c_custkey AS VARCHAR) AS page_id, '0' AS page_namespace, c_name AS page_title, 'a, (b) ''c''' AS more FROM customer",
    ),
    "dump_faults": (
        lambda s, d: _read(R.dump_faults, _dump_lines(s, d, faults=True)),
        "SELECT count(*) + count(DISTINCT c_custkey % 50) AS tuples, count(DISTINCT c_custkey % 50) AS malformed, count(DISTINCT c_custkey % 50) AS broken FROM customer",
    ),
    "read_names": (
        lambda s, d: _read(R.read_names, B.table(s, d, "part").select(_tabs(B.entity(5, "p_partkey"), "p_name", F.concat_ws("||", "p_brand", "p_name", "p_type"))), B.table(s, d, "part").where("p_size > 10").select(B.entity(5, "p_partkey").alias("entity"))).select("entity", F.array_join("names", "|").alias("names")),
        "SELECT 'Q' || CAST(5000000000 + p_partkey AS VARCHAR) AS entity, p_name || '|' || p_brand || '|' || p_type AS names FROM part WHERE p_size > 10",
    ),
    "read_ids": (lambda s, d: _read(R.read_ids, B.table(s, d, "nation").select(_tabs("n_nationkey", "n_name"))), "SELECT CAST(n_nationkey AS VARCHAR) AS pid FROM nation"),
    "read_counts": (
        lambda s, d: _read(R.read_counts, B.table(s, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n")).select(_tabs("o_orderpriority", "o_orderstatus", "n"))),
        "SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS cnt FROM orders GROUP BY 1, 2",
    ),
    "read_list_map": (
        lambda s, d: _read(R.read_list_map, B.table(s, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), "|||").alias("v")).select(_tabs("n_regionkey", F.col("v")))).select("key", F.explode("vals").alias("val")),
        "SELECT CAST(n_regionkey AS VARCHAR) AS key, n_name AS val FROM nation",
    ),
    "read_corpus": (
        lambda s, d: _read(R.read_corpus, B.table(s, d, "documents").select(F.to_json(F.struct(F.when(F.length("text") == 0, "").otherwise(F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("T "), F.col("lang")).alias("title"), F.array("text", F.lit("  end \n x ")).alias("sections"))).alias("value"))).select("id", F.length("text").cast("long").alias("n")),
        r"""SELECT CAST(doc_id AS VARCHAR) AS id, length(trim(regexp_replace('T ' || lang || ' ' || text || '   end x ', '[\x20\x09-\x0D]+', ' ', 'g'))) AS n FROM documents WHERE length(text) > 0""",
    ),
    "shuffled_heads": (
        lambda s, d: W.shuffled_heads(B.occs(s, d).distinct(), 25, 4),
        B.with_views("occs", "SELECT pid, h, t FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY md5('4:' || h || '|' || t), h, t) AS k FROM (SELECT DISTINCT * FROM occs)) WHERE k <= 25"),
    ),
    "tree_json": (
        lambda s, d: W.tree_json(B.tree(s, d), B.tree(s, d).where("pos = 0").select(F.col("child").alias("pid"), F.concat(F.lit("not "), F.max("parent").over(Window.partitionBy("child"))).alias("predicted")).distinct()),
        B.with_views("tree", """SELECT pid, '{"id":"' || pid || '","parent":"' || coalesce(parent, '#') || '","predicted":"' || coalesce(p, '#') || '"}' AS value FROM (SELECT child AS pid, min(parent) AS parent FROM tree GROUP BY child UNION SELECT parent, NULL FROM tree WHERE parent NOT IN (SELECT child FROM tree))
          LEFT JOIN (SELECT child AS q, 'not ' || max(parent) AS p FROM tree WHERE pos = 0 GROUP BY child) ON q = pid"""),
    ),
}
