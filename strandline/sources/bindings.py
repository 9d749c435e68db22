"""Logical views of the engine's data model over the star-schema tables, as DataFrames and as SQL for the oracles.

Entity ids are 'Q' followed by kind * 1,000,000,000 + key; kinds: 1 region, 2 nation, 3 customer, 4 supplier, 5 part, 6 order, 7 type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators.loops import checkpointed

GIGA = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entity(kind: int, key: str) -> Column:
    return F.concat(F.lit("Q"), (F.lit(kind * GIGA) + F.col(key)).cast("string"))


def _edges(df: DataFrame, head: Column, relation: str, tail: Column) -> DataFrame:
    return df.select(head.alias("h"), F.lit(relation).alias("r"), tail.alias("t"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples (h, r, t); P5 and P6 keep duplicates, P99 has literal tails."""
    t = lambda n: table(spark, sf_dir, n)
    part = t("part")
    parts = [
        _edges(t("customer"), entity(3, "c_custkey"), "P1", entity(2, "c_nationkey")),
        _edges(t("supplier"), entity(4, "s_suppkey"), "P2", entity(2, "s_nationkey")),
        _edges(t("nation"), entity(2, "n_nationkey"), "P3", entity(1, "n_regionkey")),
        _edges(t("orders"), entity(6, "o_orderkey"), "P4", entity(3, "o_custkey")),
        _edges(t("lineitem"), entity(5, "l_partkey"), "P5", entity(4, "l_suppkey")),
        _edges(t("lineitem"), entity(6, "l_orderkey"), "P6", entity(5, "l_partkey")),
        _edges(part, entity(5, "p_partkey"), "P31", entity(7, "p_size")),
        _edges(part, entity(7, "p_size"), "P279", F.concat(F.lit("Q"), (F.lit(7 * GIGA + 100) + F.col("p_size") % 5).cast("string"))).distinct(),
        _edges(part, F.concat(F.lit("Q"), (F.lit(7 * GIGA + 100) + F.col("p_size") % 5).cast("string")), "P279", F.lit("Q7000000200")).distinct(),
        _edges(part, entity(5, "p_partkey"), "P99", F.concat(F.lit("size "), F.col("p_size").cast("string"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


TRIPLES = """
  SELECT 'Q' || CAST(3000000000 + c_custkey AS VARCHAR) AS h, 'P1' AS r, 'Q' || CAST(2000000000 + c_nationkey AS VARCHAR) AS t FROM customer
  UNION ALL SELECT 'Q' || CAST(4000000000 + s_suppkey AS VARCHAR), 'P2', 'Q' || CAST(2000000000 + s_nationkey AS VARCHAR) FROM supplier
  UNION ALL SELECT 'Q' || CAST(2000000000 + n_nationkey AS VARCHAR), 'P3', 'Q' || CAST(1000000000 + n_regionkey AS VARCHAR) FROM nation
  UNION ALL SELECT 'Q' || CAST(6000000000 + o_orderkey AS VARCHAR), 'P4', 'Q' || CAST(3000000000 + o_custkey AS VARCHAR) FROM orders
  UNION ALL SELECT 'Q' || CAST(5000000000 + l_partkey AS VARCHAR), 'P5', 'Q' || CAST(4000000000 + l_suppkey AS VARCHAR) FROM lineitem
  UNION ALL SELECT 'Q' || CAST(6000000000 + l_orderkey AS VARCHAR), 'P6', 'Q' || CAST(5000000000 + l_partkey AS VARCHAR) FROM lineitem
  UNION ALL SELECT 'Q' || CAST(5000000000 + p_partkey AS VARCHAR), 'P31', 'Q' || CAST(7000000000 + p_size AS VARCHAR) FROM part
  UNION ALL SELECT DISTINCT 'Q' || CAST(7000000000 + p_size AS VARCHAR), 'P279', 'Q' || CAST(7000000100 + p_size % 5 AS VARCHAR) FROM part
  UNION ALL SELECT DISTINCT 'Q' || CAST(7000000100 + p_size % 5 AS VARCHAR), 'P279', 'Q7000000200' FROM part
  UNION ALL SELECT 'Q' || CAST(5000000000 + p_partkey AS VARCHAR), 'P99', 'size ' || CAST(p_size AS VARCHAR) FROM part
"""


def occs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences (pid, h, t) of four overlapping part-supplier relations, duplicates kept."""
    pair = [entity(5, "l_partkey").alias("h"), entity(4, "l_suppkey").alias("t")]
    item = table(spark, sf_dir, "lineitem")
    tests = {"P10": F.col("l_discount") >= 0.05, "P11": F.col("l_returnflag") == "R", "P12": F.col("l_returnflag") == "A", "P13": F.col("l_linestatus") == "O"}
    pids = F.filter(F.array(*[F.when(test, F.lit(pid)) for pid, test in tests.items()]), lambda p: p.isNotNull())
    return item.select(F.explode(pids).alias("pid"), *pair)


_PAIR = "'Q' || CAST(5000000000 + l_partkey AS VARCHAR) AS h, 'Q' || CAST(4000000000 + l_suppkey AS VARCHAR) AS t FROM lineitem WHERE"
OCCS = f"""
  SELECT 'P10' AS pid, {_PAIR} l_discount >= 0.05
  UNION ALL SELECT 'P11', {_PAIR} l_returnflag = 'R'
  UNION ALL SELECT 'P12', {_PAIR} l_returnflag = 'A'
  UNION ALL SELECT 'P13', {_PAIR} l_linestatus = 'O'
"""

#: (parent, child, position); P11 has two parents, P30 stands alone in `PROPERTIES`.
SUBPROPS = [("P100", "P10", 0), ("P100", "P20", 1), ("P100", "P11", 2), ("P10", "P11", 0), ("P10", "P12", 1), ("P20", "P13", 0)]
PROPERTIES = ["P10", "P100", "P11", "P12", "P13", "P20", "P30"]


def subprops(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SUBPROPS, "parent string, child string, pos int")


def properties(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in PROPERTIES], "pid string")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hierarchy that the tables hold, as edges (parent, child, pos): places down to a nation's market segments, and goods, where each name has two parents."""
    part, nation = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    quality, kind = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    edge = lambda df, a, b: df.select(a.alias("parent"), b.alias("child"))
    placed = nation.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sold = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    edges = [
        edge(table(spark, sf_dir, "region"), F.lit("world"), F.col("r_name")),
        edge(placed, F.col("r_name"), F.col("n_name")),
        edge(sold, F.col("n_name"), F.concat_ws("|", "n_name", "c_mktsegment")),
        edge(part, F.lit("goods"), kind),
        edge(part, F.lit("qualities"), quality),
        edge(part, kind, F.col("p_name")),
        edge(part, quality, F.col("p_name")),
        edge(part, F.col("p_name"), F.concat_ws("|", "p_name", "p_brand")),
    ]
    out = edges[0]
    for e in edges[1:]:
        out = out.unionAll(e)
    return out.distinct().withColumn("pos", F.row_number().over(Window.partitionBy("parent").orderBy("child")) - 1)


TREE = """
  SELECT parent, child, CAST(row_number() OVER (PARTITION BY parent ORDER BY child) - 1 AS INTEGER) AS pos FROM (
    SELECT 'world' AS parent, r_name AS child FROM region
    UNION SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION SELECT n_name, n_name || '|' || c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION SELECT 'goods', split_part(p_name, ' ', 2) FROM part
    UNION SELECT 'qualities', split_part(p_name, ' ', 1) FROM part
    UNION SELECT split_part(p_name, ' ', 2), p_name FROM part
    UNION SELECT split_part(p_name, ' ', 1), p_name FROM part
    UNION SELECT p_name, p_name || '|' || p_brand FROM part)
"""


def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the hierarchy (pid), and order priorities, which stand alone."""
    inner = tree(spark, sf_dir).select(F.explode(F.array("parent", "child")).alias("pid"))
    return inner.unionAll(table(spark, sf_dir, "orders").select("o_orderpriority")).distinct()


def tree_occs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences (pid, h, t) on the hierarchy of goods: part and supplier under name and brand, and of returned items under their kind."""
    item = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    pair = [entity(5, "l_partkey").alias("h"), entity(4, "l_suppkey").alias("t")]
    own = item.select(F.concat_ws("|", "p_name", "p_brand").alias("pid"), *pair)
    back = item.where("l_returnflag = 'R'").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("pid"), *pair)
    return own.unionAll(back).distinct()


TREE_OCCS = """
  SELECT DISTINCT p_name || '|' || p_brand AS pid, 'Q' || CAST(5000000000 + l_partkey AS VARCHAR) AS h, 'Q' || CAST(4000000000 + l_suppkey AS VARCHAR) AS t
    FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION SELECT split_part(p_name, ' ', 2), 'Q' || CAST(5000000000 + l_partkey AS VARCHAR), 'Q' || CAST(4000000000 + l_suppkey AS VARCHAR)
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'
"""


def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types (entity, type, depth, pos): a part's deep and shallow type, a supplier's nation."""
    part = table(spark, sf_dir, "part")
    return (
        part.select(entity(5, "p_partkey").alias("entity"), F.col("p_type").alias("type"), F.lit(2).alias("depth"), F.lit(1).alias("pos"))
        .unionAll(part.select(entity(5, "p_partkey"), F.lit("item"), F.lit(0), F.lit(0)))
        .unionAll(table(spark, sf_dir, "supplier").select(entity(4, "s_suppkey"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")), F.lit(1), F.lit(0)))
    )


TYPES = """
  SELECT 'Q' || CAST(5000000000 + p_partkey AS VARCHAR) AS entity, p_type AS type, 2 AS depth, 1 AS pos FROM part
  UNION ALL SELECT 'Q' || CAST(5000000000 + p_partkey AS VARCHAR), 'item', 0, 0 FROM part
  UNION ALL SELECT 'Q' || CAST(4000000000 + s_suppkey AS VARCHAR), 'N' || CAST(s_nationkey AS VARCHAR), 1, 0 FROM supplier
"""

WORDS_AND_ENDS = r"\p{L}+|[.!?]"


def token_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token lists (sid, toks) of all documents: words of any letters and sentence ends, lower case."""
    found = F.regexp_extract_all(F.lower(F.col("text")), F.lit(WORDS_AND_ENDS), F.lit(0))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sid"), found.alias("toks"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens (sid, pos, tok) of all documents."""
    return token_lists(spark, sf_dir).select("sid", F.posexplode("toks").alias("pos", "tok"))


TOKENS = f"""
  SELECT doc_id AS sid, CAST(unnest(range(len(w))) AS BIGINT) AS pos, unnest(w) AS tok
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '{WORDS_AND_ENDS}') AS w FROM documents)
"""

LEXICON_WORDS = 200


def lexicon(spark: SparkSession, sf_dir: str, toks: DataFrame | None = None) -> DataFrame:
    """The most frequent long words as entities: (word, wdid, rank). Two hundred rows, found once and held by the driver."""
    df = (tokens(spark, sf_dir) if toks is None else toks).where("length(tok) >= 7").groupBy("tok").agg(F.countDistinct("sid").alias("df"))
    top = df.orderBy(F.desc("df"), "tok").limit(LEXICON_WORDS)
    rows = [(r.tok, i, f"W{i}") for i, r in enumerate(top.collect(), 1)]
    return spark.createDataFrame(rows, "word string, rank int, wdid string")


LEXICON = f"""
  SELECT tok AS word, 'W' || CAST(rank AS VARCHAR) AS wdid, rank FROM (
    SELECT tok, row_number() OVER (ORDER BY df DESC, tok) AS rank FROM (
      SELECT tok, count(DISTINCT sid) AS df FROM tokens WHERE length(tok) >= 7 GROUP BY tok)) WHERE rank <= {LEXICON_WORDS}
"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions (sid, start, end, wdid): tokens that are in the lexicon, of a fixed two hundred words."""
    return Annotated(spark, sf_dir).mentions


MENTIONS = "SELECT sid, pos AS start, pos + 1 AS end_, wdid FROM tokens JOIN lexicon ON tok = word"


def pair_relations(spark: SparkSession, sf_dir: str, lex: DataFrame | None = None) -> DataFrame:
    """A relation for a third of the lexicon's pairs: (h, t, pid)."""
    lex = lexicon(spark, sf_dir) if lex is None else lex
    a, b = lex.select(F.col("wdid").alias("h"), F.col("rank").alias("i")), lex.select(F.col("wdid").alias("t"), F.col("rank").alias("j"))
    pid = F.concat(F.lit("P"), ((F.col("i") * 7 + F.col("j")) % 10).cast("string"))
    return a.join(b, (F.col("i") + F.col("j")) % 3 == 0).select("h", "t", pid.alias("pid"))


PAIR_RELATIONS = """
  SELECT a.wdid AS h, b.wdid AS t, 'P' || CAST((a.rank * 7 + b.rank) % 10 AS VARCHAR) AS pid FROM lexicon a JOIN lexicon b ON (a.rank + b.rank) % 3 = 0
"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors (id, pid, vec) with their label as relation."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.concat(F.lit("P"), F.col("label").cast("string")).alias("pid"), F.col("embedding").alias("vec"))


VECTORS = "SELECT vec_id AS id, 'P' || CAST(label AS VARCHAR) AS pid, embedding AS vec FROM embeddings"


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links (page, entity): a page's url and the targets of its href attributes."""
    pages = table(spark, sf_dir, "pages")
    found = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))
    return pages.select(F.col("url").alias("page"), found.alias("entity"))


PAGE_LINKS = """SELECT url AS page, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS entity FROM pages"""

class Annotated:
    """All documents' tokens, found once and written to the checkpoint folder, and what is made of them: lists, tokens, lexicon, mentions and relations."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.lists = checkpointed(token_lists(spark, sf_dir))
        self.tokens = self.lists.select("sid", F.posexplode("toks").alias("pos", "tok"))
        self.lexicon = lexicon(spark, sf_dir, self.tokens)
        words = F.broadcast(self.lexicon.select(F.col("word").alias("tok"), "wdid"))
        self.mentions = self.tokens.join(words, "tok").select("sid", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "wdid")
        self.relations = pair_relations(spark, sf_dir, self.lexicon)


_SQL = {
    "triples": ((), TRIPLES),
    "occs": ((), OCCS),
    "subprops": ((), "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {i})" for a, b, i in SUBPROPS) + ") AS v(parent, child, pos)"),
    "properties": ((), "SELECT * FROM (VALUES " + ", ".join(f"('{p}')" for p in PROPERTIES) + ") AS v(pid)"),
    "tree": ((), TREE),
    "tree_nodes": (("tree",), "SELECT parent AS pid FROM tree UNION SELECT child FROM tree UNION SELECT o_orderpriority FROM orders"),
    "tree_occs": ((), TREE_OCCS),
    "tree_closure": (("tree",), "SELECT parent AS anc, child AS des, 1 AS depth FROM tree UNION ALL SELECT c.anc, s.child, c.depth + 1 FROM tree_closure c JOIN tree s ON s.parent = c.des"),
    "types": ((), TYPES),
    "tokens": ((), TOKENS),
    "lexicon": (("tokens",), LEXICON),
    "mentions": (("tokens", "lexicon"), MENTIONS),
    "pair_relations": (("tokens", "lexicon"), PAIR_RELATIONS),
    "vectors": ((), VECTORS),
    "page_links": ((), PAGE_LINKS),
    "closure": (("subprops",), "SELECT parent AS anc, child AS des, 1 AS depth FROM subprops UNION ALL SELECT c.anc, s.child, c.depth + 1 FROM closure c JOIN subprops s ON s.parent = c.des"),
}


def with_views(names: str, body: str) -> str:
    """The oracle's SQL with the named views, and those they need, before it."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _SQL[name][0]:
            add(n)
        if name not in order:
            order.append(name)

    for n in names.split():
        add(n)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({_SQL[n][1]})" for n in order) + " " + body.strip()
