"""Queries on samples, contexts, names and evaluation, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import contexts as X
from strandline.operators import corpus as C
from strandline.operators import evaluation as E
from strandline.operators import pair_scores as P
from strandline.operators import relations as R
from strandline.operators import text as T
from strandline.operators import vectors as V
from strandline.plans.relation_queries import _after, _closed
from strandline.plans.vector_queries import _LONG, _SCORED, _ancestors, _parents
from strandline.sources import bindings as B

_V = B.with_views


def _predictions(s, d):
    """Three predictions a pair of relations: its score, and two around it."""
    scores = V.mean_scores(B.vectors(s, d)).select("p1", "p2", F.round((F.col("cosine") + 1) / 2, 5).alias("score"))
    return scores.select("p1", "p2", F.explode(F.array(F.col("score"), F.col("score") / 2, F.lit(0.75))).alias("p"))


_PREDICTED = _SCORED + ", predicted AS (SELECT p1, p2, unnest([round(score, 5), round(score, 5) / 2, 0.75]) AS p, parent FROM scored)"


def _counted(s, d):
    """Words of the documents by language, with the first document of each."""
    words = _words(s, d)
    return words.groupBy("pid", "word", "sid").agg(F.count(F.lit(1)).alias("cnt"))


def _words(s, d):
    docs = B.table(s, d, "documents")
    return docs.select(F.coalesce("lang", F.lit("none")).alias("pid"), F.col("doc_id").alias("sid"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))).alias("word"))


_COUNTED = r"counted AS (SELECT coalesce(lang, 'none') AS pid, doc_id AS sid, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')) AS word FROM documents)"


def _names(s, d):
    part = B.table(s, d, "part").select(B.entity(5, "p_partkey").alias("entity"), F.col("p_name").alias("name"))
    return part.unionAll(B.table(s, d, "supplier").select(B.entity(4, "s_suppkey"), F.col("s_name")))


_NAMED = """names AS (SELECT 'Q' || CAST(5000000000 + p_partkey AS VARCHAR) AS entity, p_name AS name FROM part UNION ALL SELECT 'Q' || CAST(4000000000 + s_suppkey AS VARCHAR), s_name FROM supplier),
  vocab AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part)"""


def _vectors_of_entities(s, d):
    """Vectors of parts and suppliers: those whose key is no multiple of seven."""
    parts = B.table(s, d, "part").where("p_partkey % 7 <> 0").select(B.entity(5, "p_partkey").alias("key"))
    return parts.unionAll(B.table(s, d, "supplier").where("s_suppkey % 7 <> 0").select(B.entity(4, "s_suppkey"))).unionAll(s.createDataFrame([("P10",), ("P11",), ("P12",)], "key string"))


def _subgraphs(s, d):
    """A part's sub-graph holds itself and the next part, a supplier's itself."""
    part = B.table(s, d, "part")
    own = part.select(B.entity(5, "p_partkey").alias("root"), B.entity(5, "p_partkey").alias("id"))
    nxt = part.select(B.entity(5, "p_partkey").alias("root"), F.concat(F.lit("Q"), (F.lit(5 * B.GIGA) + F.col("p_partkey") - F.col("p_partkey") % 2).cast("string")).alias("id"))
    return own.unionAll(nxt).unionAll(B.table(s, d, "supplier").select(B.entity(4, "s_suppkey"), B.entity(4, "s_suppkey")))


_GRAPHS = """keys AS (SELECT 'Q' || CAST(5000000000 + p_partkey AS VARCHAR) AS key FROM part WHERE p_partkey % 7 <> 0 UNION ALL SELECT 'Q' || CAST(4000000000 + s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 7 <> 0
    UNION ALL SELECT * FROM (VALUES ('P10'), ('P11'), ('P12')) AS v(key)),
  graphs AS (SELECT 'Q' || CAST(5000000000 + p_partkey AS VARCHAR) AS root, 'Q' || CAST(5000000000 + p_partkey AS VARCHAR) AS id FROM part
    UNION ALL SELECT 'Q' || CAST(5000000000 + p_partkey AS VARCHAR), 'Q' || CAST(5000000000 + p_partkey - p_partkey % 2 AS VARCHAR) FROM part
    UNION ALL SELECT 'Q' || CAST(4000000000 + s_suppkey AS VARCHAR), 'Q' || CAST(4000000000 + s_suppkey AS VARCHAR) FROM supplier),
  fine AS (SELECT root FROM graphs GROUP BY root HAVING count(*) = count(CASE WHEN id IN (SELECT key FROM keys) THEN 1 END) AND root IN (SELECT key FROM keys))"""


def _ntriples(s, d):
    """N-Triples lines made of customers: an id literal for two in three of them, another predicate for the rest."""
    name = F.concat(F.lit("<http://kb.example/entity/"), B.entity(3, "c_custkey"), F.lit("> <http://kb.example/prop/"), F.when(F.col("c_custkey") % 3 == 0, "P7").otherwise("P646"))
    return B.table(s, d, "customer").select(F.concat(name, F.lit('> "'), F.when(F.col("c_custkey") % 5 == 0, "/g/").otherwise("/m/"), F.col("c_custkey").cast("string"), F.lit('" .')).alias("value"))


def _middles(s, d):
    said = B.Annotated(s, d)
    return X.middle_contexts(said.mentions, said.relations, said.lists, 20)


def _paths_of_sentences(s, d):
    """Paths from the last to the second word of each sentence; a word hangs from the one at half its place, so paths go up and down a tree."""
    ends = B.token_lists(s, d).withColumn("ends", F.filter(F.sequence(F.lit(1), F.size("toks")), lambda i: F.get("toks", i - 1).isin(T.SENTENCE_ENDS)))
    cut = F.transform(F.concat(F.array(F.lit(0)), "ends"), lambda a, k: F.slice("toks", a + 1, F.coalesce(F.get("ends", k), F.size("toks")) - a))
    # Only sentences with a pair are searched.
    said = ends.select("sid", F.posexplode(cut).alias("sent", "toks")).where(F.size("toks") > 2)
    long = said.select(F.concat_ws(":", F.col("sid").cast("string"), F.col("sent").cast("string")).alias("sid"), "toks")
    words = long.select("sid", F.posexplode("toks").alias("pos", "word"))
    edges = words.where("pos > 0").select("sid", F.col("pos").alias("child"), F.floor((F.col("pos") - 1) / 2).cast("int").alias("head"), F.concat(F.lit("d"), (F.col("pos") % 3).cast("string")).alias("dep"))
    pairs = long.select("sid", F.lit(1).alias("pair"), F.array(F.size("toks") - 1).alias("starts"), F.array(F.lit(1)).alias("ends"))
    return X.dependency_paths(edges, words, pairs)


_SENTENCES = """said AS (SELECT sid, pos, tok, coalesce(sum(CASE WHEN tok IN ('.', '!', '?') THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent FROM tokens),
  words AS (SELECT CAST(sid AS VARCHAR) || ':' || CAST(CAST(sent AS BIGINT) AS VARCHAR) AS sid, row_number() OVER (PARTITION BY sid, sent ORDER BY pos) - 1 AS pos, tok AS word FROM said),
  climb AS (SELECT sid, max(pos) AS spot, CAST([] AS VARCHAR[]) AS path FROM words GROUP BY sid HAVING max(pos) > 1
    UNION ALL SELECT c.sid, (c.spot - 1) // 2, list_concat(c.path, CASE WHEN (c.spot - 1) // 2 = 1 THEN ['d' || CAST(c.spot % 3 AS VARCHAR)] ELSE ['d' || CAST(c.spot % 3 AS VARCHAR), w.word] END)
    FROM climb c JOIN words w ON w.sid = c.sid AND w.pos = (c.spot - 1) // 2 WHERE c.spot > 1)"""

#: Weights of relations in message sums.
_WEIGHTS = {"P1": 1.0, "P2": 0.5, "P3": 2.0, "P4": 0.25, "P5": 0.125, "P6": 0.75, "P31": 1.5, "P279": 3.0, "P99": 4.0}


def _prompted(s, d):
    """A sentence of each part's name: its first two words are head and tail, with a word between them and one at the end."""
    words = F.split("p_name", " ")
    tokens = F.concat(F.array(F.lit("the"), F.element_at(words, 1), F.lit("and")), F.slice(words, 2, F.size(words)), F.array(F.lit("ends")))
    return B.table(s, d, "part").select(F.concat("p_brand", F.lit("_split")).alias("pid"), tokens.alias("tokens"), *[F.lit(v).alias(c) for c, v in (("hs", 1), ("he", 2), ("ts", 3), ("te", 4))], F.array(F.lit("and"), F.lit("ends"), F.lit("nowhere")).alias("path"))


def _dated(s, d):
    return B.table(s, d, "orders").select(F.col("o_orderpriority").alias("pid"), F.col("o_orderkey").alias("sid"), F.col("o_custkey"))


CATALOG = {
    "pair_mean_scores": (
        lambda s, d: E.pair_scores(_predictions(s, d)).withColumn("score", F.round("score", 8)),
        _after("vectors", _PREDICTED, "SELECT p1, p2, round(avg(p), 8) AS score FROM predicted GROUP BY 1, 2"),
    ),
    "sample_accuracy": (
        lambda s, d: E.sample_accuracy(_predictions(s, d), _parents(s)).withColumn("accuracy", F.round("accuracy", 6)),
        _after("vectors", _PREDICTED, "SELECT round(avg(CASE WHEN (p >= 0.5) = parent THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM predicted"),
    ),
    "endpoint_auc_map": (
        lambda s, d: E.endpoint_precision(E.pair_scores(_predictions(s, d)).withColumn("score", F.round("score", 3)), _parents(s)).select("pid", F.round("auc", 6).alias("auc"), F.round("ap", 6).alias("ap")),
        _after("vectors", _PREDICTED + """, own AS (SELECT p1, p2, round(avg(p), 3) AS score, bool_or(parent) AS parent FROM predicted GROUP BY 1, 2),
          both_ AS (SELECT p1 AS pid, score, parent FROM own UNION ALL SELECT p2, score, parent FROM own), lv AS (SELECT pid, score, count(CASE WHEN parent THEN 1 END) AS hits, count(*) AS n FROM both_ GROUP BY 1, 2),
          curve AS (SELECT *, sum(hits) OVER w / sum(n) OVER w AS prec FROM lv WINDOW w AS (PARTITION BY pid ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
          stepped AS (SELECT *, coalesce(lag(prec) OVER (PARTITION BY pid ORDER BY score DESC), 1.0) AS before FROM curve)""",
          "SELECT pid, round(sum(hits * (prec + before) / 2) / sum(hits), 6) AS auc, round(sum(hits * prec) / sum(hits), 6) AS ap FROM stepped GROUP BY pid HAVING sum(hits) > 0"),
    ),
    "coverage_macro_micro": (
        lambda s, d: E.coverage(B.table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("found"), F.count(F.lit(1)).alias("wanted"))).select(F.round("macro", 6).alias("macro"), F.round("micro", 6).alias("micro")),
        "SELECT round(avg(f / w), 6) AS macro, round(sum(f) / sum(w), 6) AS micro FROM (SELECT l_orderkey, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS f, count(*) AS w FROM lineitem GROUP BY 1)",
    ),
    "accuracy_by_leaf": (
        lambda s, d: E.by_leaf(B.occs(s, d).select("pid", F.col("h").endswith("1").alias("hit")), B.subprops(s), s.createDataFrame([("P100",), ("P10",)], "pid string")).withColumn("accuracy", F.round("accuracy", 6)),
        _V("occs subprops", "SELECT pid NOT IN (SELECT parent FROM subprops WHERE parent IN ('P100', 'P10')) AS leaf, count(*) AS n, round(avg(CASE WHEN h LIKE '%1' THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM occs GROUP BY 1"),
    ),
    "kde_divergence": (
        lambda s, d: P.kernel_divergence(B.vectors(s, d), P.all_pairs(B.vectors(s, d)), 64, 0.4).withColumn("score", F.round("score", 3)),
        _after("vectors", """d2 AS (SELECT a.pid AS p1, b.pid AS p2, a.id AS c, pow(list_distance(CAST(a.vec AS DOUBLE[]), CAST(b.vec AS DOUBLE[])), 2) AS d2 FROM vectors a JOIN vectors b ON true),
          lows AS (SELECT p1, p2, c, min(d2) AS low FROM d2 GROUP BY 1, 2, 3),
          dens AS (SELECT p1, p2, c, ln(avg(exp((low - d2) / 0.32))) - min(low) / 0.32 - 32 * ln(2 * pi()) - 64 * ln(0.4) AS l FROM d2 JOIN lows USING (p1, p2, c) GROUP BY 1, 2, 3)""",
          "SELECT a.p1, a.p2, round(-sum(exp(o.l) * (o.l - a.l)), 3) AS score FROM dens a JOIN dens o ON o.p1 = a.p1 AND o.p2 = a.p1 AND o.c = a.c WHERE a.p1 <> a.p2 GROUP BY 1, 2"),
    ),
    "ranked_labels": (
        lambda s, d: P.ranked_labels(B.vectors(s, d), s.createDataFrame([(f"P{i}",) for i in range(10)], "pid string"), s.createDataFrame([(f"P{i}",) for i in range(6)], "pid string"), _parents(s), _ancestors(s), "mean_cosine", least=2)
        .select("p1", F.col("rank").cast("long").alias("rank"), "p2", "rel"),
        _after("vectors", _SCORED, """SELECT p1, row_number() OVER (PARTITION BY p1 ORDER BY score DESC, p2) AS rank, p2, CASE WHEN parent THEN 'parent' WHEN above THEN 'ancestor' ELSE '*' END AS rel
          FROM scored WHERE p2 < 'P6' AND p1 IN (SELECT pid FROM vectors GROUP BY pid HAVING count(*) >= 2) AND p2 IN (SELECT pid FROM vectors GROUP BY pid HAVING count(*) >= 2)"""),
    ),
    "leaking_pairs": (
        lambda s, d: P.leaking_pairs(B.occs(s, d), _closed(s)),
        _V("occs subprops closure", "SELECT anc, des, count(*) AS common FROM (SELECT DISTINCT anc, des FROM closure) JOIN (SELECT DISTINCT pid, h, t FROM occs) a ON a.pid = des JOIN (SELECT DISTINCT pid, h, t FROM occs) b ON b.pid = anc AND a.h = b.h AND a.t = b.t GROUP BY 1, 2"),
    ),
    "capped_keys": (lambda s, d: C.capped_keys(_counted(s, d), "word", "sid", 50), _after("tokens", _COUNTED, "SELECT pid, word, cnt FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY first, word) AS k FROM (SELECT pid, word, count(*) AS cnt, min(sid) AS first FROM counted GROUP BY 1, 2)) WHERE k <= 50")),
    "grouped_lists": (
        lambda s, d: C.grouped_lists(B.table(s, d, "orders").select("o_custkey", "o_orderpriority"), "o_custkey", "o_orderpriority", B.table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), "|"),
        "SELECT o_custkey, count(DISTINCT o_orderpriority) AS n, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS line FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1",
    ),
    "context_statistics": (
        lambda s, d: C.count_statistics(_words(s, d).groupBy("pid", "word").agg(F.count(F.lit(1)).alias("cnt"))).withColumn("mean", F.round("mean", 4)),
        _after("tokens", _COUNTED, "SELECT pid, count(*) AS keys, round(avg(cnt), 4) AS mean, CAST(sum(cnt) AS BIGINT) AS total FROM (SELECT pid, word, count(*) AS cnt FROM counted GROUP BY 1, 2) GROUP BY 1"),
    ),
    "name_words": (
        lambda s, d: C.name_words(B.occs(s, d), _names(s, d), B.table(s, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word"))),
        _after("occs", _NAMED, "SELECT pid, word, count(*) AS cnt FROM (SELECT pid, unnest(string_split(lower(name), ' ')) AS word FROM (SELECT pid, h AS e FROM occs UNION ALL SELECT pid, t FROM occs) JOIN names ON e = entity) WHERE word IN (SELECT word FROM vocab) GROUP BY 1, 2"),
    ),
    "subgraph_and_vector_filter": (
        lambda s, d: C.with_subgraph_and_vector(B.occs(s, d), _subgraphs(s, d), _vectors_of_entities(s, d), 40),
        _after("occs", _GRAPHS, "SELECT pid, h, t FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY h, t) AS k FROM (SELECT DISTINCT pid, h, t FROM occs WHERE pid IN (SELECT key FROM keys) AND h IN (SELECT root FROM fine) AND t IN (SELECT root FROM fine))) WHERE k <= 40"),
    ),
    "embedding_filter": (
        lambda s, d: R.distinct_entities(B.triples(s, d)).join(_vectors_of_entities(s, d).select(F.col("key").alias("entity")), "entity", "left_semi"),
        _after("triples", _GRAPHS, "SELECT DISTINCT entity FROM (SELECT h AS entity FROM triples UNION ALL SELECT t FROM triples) WHERE entity IN (SELECT key FROM keys)"),
    ),
    "literal_ids": (
        lambda s, d: C.literal_ids(_ntriples(s, d), "P646"),
        "SELECT 'Q' || CAST(3000000000 + c_custkey AS VARCHAR) AS id, '/m/' || CAST(c_custkey AS VARCHAR) AS mid FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0",
    ),
    "relations_of_other_kinds": (
        lambda s, d: C.relations_of_kind(B.table(s, d, "events").select(F.col("event_type").alias("id"), F.when(F.col("event_type").isin("click", "view"), "wikibase-item").otherwise(F.lit("string")).alias("datatype"))),
        "SELECT DISTINCT event_type AS id FROM events WHERE event_type NOT IN ('click', 'view') OR event_type IS NULL",
    ),
    "known_or_pad": (
        lambda s, d: C.known_or_pad(B.occs(s, d), "h", _vectors_of_entities(s, d).select(F.col("key").alias("id"))).groupBy("pid", "h").agg(F.count(F.lit(1)).alias("cnt")),
        _after("occs", _GRAPHS, "SELECT pid, CASE WHEN h IN (SELECT key FROM keys) THEN h ELSE '<PAD>' END AS h, count(*) AS cnt FROM occs GROUP BY 1, 2"),
    ),
    "sample_filters": (
        lambda s, d: C.filtered_samples(_dated(s, d).select("pid", F.concat(F.lit("L"), (F.col("sid") % 9).cast("string")).alias("label"), F.col("o_custkey").alias("sample")), s.createDataFrame([("1-URGENT",)], "pid string"), s.createDataFrame([("L1",), ("L4",), ("L7",)], "label string"), True),
        "SELECT pid, label, sample FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY sample, label) AS k FROM (SELECT o_orderpriority AS pid, 'L' || CAST(o_orderkey % 9 AS VARCHAR) AS label, o_custkey AS sample FROM orders) WHERE pid <> '1-URGENT' AND label IN ('L1', 'L4', 'L7')) WHERE k = 1",
    ),
    "common_labels": (
        lambda s, d: C.common_labels(B.table(s, d, "lineitem").select(F.col("l_suppkey").alias("label")), B.table(s, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("label"))),
        "SELECT l_suppkey AS label FROM lineitem INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0",
    ),
    "joint_sentences_first": (
        lambda s, d: C.either_side(_dated(s, d).where("o_custkey % 3 <> 0"), _dated(s, d).where("o_custkey % 3 <> 1")).where("nth <= 1000000000").select("pid", "sid", "both", F.col("nth").cast("long").alias("nth")),
        "SELECT pid, sid, both_ AS both, row_number() OVER (PARTITION BY pid ORDER BY both_ DESC, sid) AS nth FROM (SELECT DISTINCT o_orderpriority AS pid, o_orderkey AS sid, o_custkey % 3 = 2 AS both_ FROM orders)",
    ),
    "merged_lists": (
        lambda s, d: C.merged_lists([B.table(s, d, t).groupBy(F.col(k).alias("nation")).agg(F.sort_array(F.collect_list(n)).alias("names")) for t, k, n in (("customer", "c_nationkey", "c_name"), ("supplier", "s_nationkey", "s_name"))], "nation", "names").select("nation", F.size("names").cast("long").alias("n"), F.array_join("names", ",").alias("line")),
        "SELECT nation, count(*) AS n, string_agg(name, ',' ORDER BY src, name) AS line FROM (SELECT c_nationkey AS nation, c_name AS name, 0 AS src FROM customer UNION ALL SELECT s_nationkey, s_name, 1 FROM supplier) GROUP BY nation",
    ),
    "sample_pairs": (
        lambda s, d: C.sample_pairs(B.table(s, d, "nation").select(F.col("n_regionkey").cast("string").alias("pid"), F.col("n_nationkey").alias("chunk")), s.createDataFrame([("0", "1"), ("1", "2"), ("3", "4")], "p1 string, p2 string"), 12, 3),
        """WITH z AS (SELECT CAST(n_regionkey AS VARCHAR) AS pid, count(*) AS n FROM nation GROUP BY 1), b AS (SELECT p1, p2, x.n AS n1, y.n AS n2 FROM (VALUES ('0', '1'), ('1', '2'), ('3', '4')) AS v(p1, p2) JOIN z x ON x.pid = p1 JOIN z y ON y.pid = p2),
          f AS (SELECT *, unnest(range(12)) AS k FROM b WHERE n1 * n2 > 12)
          SELECT p1, p2, CAST(('0x' || substr(md5('3:1|' || p1 || '|' || p2 || '|' || k), 1, 12))::BIGINT % n1 AS BIGINT) AS c1, CAST(('0x' || substr(md5('3:2|' || p1 || '|' || p2 || '|' || k), 1, 12))::BIGINT % n2 AS BIGINT) AS c2 FROM f
          UNION ALL SELECT p1, p2, i, j FROM (SELECT *, unnest(range(n1)) AS i FROM b WHERE n1 * n2 <= 12) q, range(q.n2) t(j)""",
    ),
    "mapped_counts": (
        lambda s, d: C.mapped_counts(B.occs(s, d).groupBy("pid", "h", "t").agg(F.count(F.lit(1)).alias("cnt")), _vectors_of_entities(s, d).where("key like 'Q%'").select(F.col("key").alias("foreign"), F.concat(F.lit("/m/"), F.substring("key", 2, 99)).alias("own"))),
        _after("occs", _GRAPHS, "SELECT pid, count(*) AS cnt, count(DISTINCT (h, t)) AS pairs FROM occs WHERE h IN (SELECT key FROM keys) AND t IN (SELECT key FROM keys) GROUP BY pid"),
    ),
    "zipped_lines": (
        lambda s, d: C.zipped(B.table(s, d, "orders").select(F.col("o_orderkey").alias("line"), "o_custkey"), B.table(s, d, "orders").select(F.col("o_orderkey").alias("line"), "o_orderstatus")),
        "SELECT o_orderkey AS line, o_custkey, o_orderstatus FROM orders",
    ),
    "split_labels": (
        lambda s, d: C.split_labels(B.table(s, d, "nation").select(F.concat_ws("_", F.lit("P7"), B.entity(2, "n_nationkey"), F.lit("Qx")).alias("name")), s.createDataFrame([("P7", "lies in")], "pid string, label string"), B.table(s, d, "nation").select(B.entity(2, "n_nationkey").alias("entity"), F.col("n_name").alias("name"))),
        "SELECT 'P7_Q' || CAST(2000000000 + n_nationkey AS VARCHAR) || '_Qx' AS name, 'lies in_' || n_name || '_Qx' AS label FROM nation",
    ),
    "halves_down_the_tree": (
        lambda s, d: C.halves_down_the_tree(B.occs(s, d), B.subprops(s)).groupBy("pid", "kept").agg(F.count(F.lit(1)).alias("cnt"), F.min("h").alias("first_h")),
        _after("occs subprops", """own AS (SELECT DISTINCT pid, h, t FROM occs), met AS (SELECT s.parent, s.child, a.h, a.t, ('0x' || substr(md5('half|' || s.parent || '|' || a.h || '|' || a.t), 1, 8))::BIGINT % 2 AS half
            FROM subprops s JOIN own a ON a.pid = s.child JOIN own b ON b.pid = s.parent AND a.h = b.h AND a.t = b.t), lost AS (SELECT DISTINCT CASE WHEN half = 0 THEN child ELSE parent END AS pid, h, t FROM met)""",
          "SELECT o.pid, l.pid IS NULL AS kept, count(*) AS cnt, min(o.h) AS first_h FROM own o LEFT JOIN lost l ON l.pid = o.pid AND l.h = o.h AND l.t = o.t GROUP BY 1, 2"),
    ),
    "surface_forms": (
        lambda s, d: C.surface_forms(B.table(s, d, "part").select(B.entity(5, "p_partkey").alias("entity"), F.concat("p_name", F.lit(" ("), F.col("p_brand"), F.lit(")")).alias("name"), F.array("p_brand", "p_name", "p_brand").alias("aliases"))),
        "SELECT DISTINCT 'Q' || CAST(5000000000 + p_partkey AS VARCHAR) AS entity, surface, surface = p_name AS canonical FROM (SELECT p_partkey, p_name, unnest([p_name, p_brand]) AS surface FROM part)",
    ),
    "masked_means": (
        lambda s, d: E.masked_means(B.occs(s, d).select(F.col("pid").alias("sample"), (F.substring("t", 2, 12).cast("long") - 4 * B.GIGA).alias("key"), F.lit(2).alias("weight")), B.vectors(s, d).select(F.col("id").alias("key"), "vec"), True)
        .select("sample", F.posexplode("vec").alias("dim", "x")).select("sample", F.col("dim").cast("long").alias("dim"), F.round("x", 4).alias("x")),
        _after("occs vectors", "m AS (SELECT o.pid AS sample, CAST(unnest(range(len(vec))) AS BIGINT) AS dim, CAST(unnest(vec) AS DOUBLE) AS x FROM occs o JOIN vectors v ON v.id = CAST(substr(o.t, 2) AS BIGINT) - 4000000000)", "SELECT sample, dim, round(avg(x), 4) AS x FROM m GROUP BY 1, 2"),
    ),
    "message_sums": (
        lambda s, d: E.message_sums(B.triples(s, d).select(F.col("h").alias("src"), F.col("t").alias("dst"), F.col("r").alias("kind")), R.distinct_entities(B.triples(s, d)).select(F.col("entity").alias("node"), F.lit(0).alias("dim"), F.substring("entity", 11, 1).cast("double").alias("x")), _WEIGHTS)
        .select("node", F.col("dim").cast("long").alias("dim"), F.round("x", 4).alias("x")),
        _V("triples", "SELECT t AS node, CAST(0 AS BIGINT) AS dim, round(sum(CAST(substr(h, 11, 1) AS DOUBLE) * w), 4) AS x FROM triples JOIN (VALUES " + ", ".join(f"('{r}', {w})" for r, w in _WEIGHTS.items()) + ") AS v(kind, w) ON kind = r WHERE regexp_matches(h, '^Q[0-9]+$') GROUP BY t"),
    ),
    "middle_contexts": (
        lambda s, d: _middles(s, d).select("sid", "pid", "h", "t", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.array_join("toks", " ").alias("middle")),
        _after("tokens lexicon mentions pair_relations", """near AS (SELECT a.sid, a.wdid AS a, b.wdid AS b, a.end_ AS start, b.start AS end_ FROM mentions a JOIN mentions b ON a.sid = b.sid AND b.start > a.end_ AND b.start - a.end_ <= 20),
          rel AS (SELECT h, t, max(pid) AS pid FROM pair_relations GROUP BY h, t), met AS (SELECT sid, pid, h, t, start, end_ FROM (SELECT sid, a AS h, b AS t, start, end_ FROM near UNION ALL SELECT sid, b, a, start, end_ FROM near) JOIN rel USING (h, t)),
          best AS (SELECT sid, pid, h, t, start, end_ FROM (SELECT *, row_number() OVER (PARTITION BY sid, pid, h, t ORDER BY end_ - start, start) AS k FROM met) WHERE k = 1)""",
          """SELECT b.sid, pid, h, t, start, end_ AS "end", string_agg(k.tok, ' ' ORDER BY k.pos) AS middle FROM best b JOIN tokens k ON k.sid = b.sid AND k.pos >= start AND k.pos < end_ GROUP BY 1, 2, 3, 4, 5, 6"""),
    ),
    "dependency_paths": (
        lambda s, d: _paths_of_sentences(s, d).select(F.col("sid"), F.array_join("path", " ").alias("path")),
        # Up to the second word, or to the first and down from it.
        _after("tokens", _SENTENCES, "SELECT sid, array_to_string(CASE WHEN spot = 1 THEN path ELSE list_append(path, 'dep_d1') END, ' ') AS path FROM climb WHERE spot <= 1"),
    ),
    "mined_prompts": (
        lambda s, d: X.mined_prompts(_prompted(s, d), 20, 5).select("pid", "prompt", "cnt", F.col("rank").cast("long").alias("rank")),
        """WITH p AS (SELECT p_brand AS pid, string_split(p_name, ' ') AS w FROM part), q AS (SELECT pid, '[X] and [Y]' || CASE WHEN len(w) > 2 THEN ' ' || array_to_string(w[3:], ' ') ELSE '' END || ' ends .' AS prompt FROM p)
          SELECT * FROM (SELECT pid, prompt, count(*) AS cnt, row_number() OVER (PARTITION BY pid ORDER BY count(*) DESC, prompt) AS rank FROM q GROUP BY 1, 2) WHERE rank <= 5""",
    ),
    "feature_lines": (
        lambda s, d: X.feature_lines(B.table(s, d, "orders").select(F.col("o_custkey").alias("sample"), F.col("o_orderpriority").alias("key")).distinct(), B.table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("key"), F.col("o_orderstatus").alias("word")).agg(F.count(F.lit(1)).alias("cnt")), s.createDataFrame([("F", 1), ("O", 2)], "word string, ind int")),
        """WITH c AS (SELECT o_orderpriority AS key, o_orderstatus AS word, count(*) AS cnt FROM orders GROUP BY 1, 2), v AS (SELECT * FROM (VALUES ('F', 1), ('O', 2)) AS v(word, ind)), s AS (SELECT DISTINCT o_custkey AS sample, o_orderpriority AS key FROM orders)
          SELECT sample, string_agg(ind || ' ' || cnt, chr(9) ORDER BY cnt DESC, ind) AS line FROM s JOIN c USING (key) JOIN v USING (word) GROUP BY sample""",
    ),
    "date_forms": (
        lambda s, d: X.date_forms(B.table(s, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("string").alias("said")), "said").select("o_orderkey", "form"),
        "SELECT o_orderkey, unnest([strftime(o_orderdate, '%-d %B %Y'), strftime(o_orderdate, '%B %-d, %Y')]) AS form FROM orders",
    ),
    "plain_prompts": (
        lambda s, d: C.plain_prompts(B.table(s, d, "part").select(F.concat(F.lit("[X] "), F.regexp_replace("p_name", "^a", "A"), F.when(F.col("p_partkey") % 2 == 0, " [Y]").otherwise(F.lit(" the .")) ).alias("prompt")), T.STOP_WORDS),
        "SELECT '[X] ' || p_name || ' the .' AS prompt FROM part WHERE p_partkey % 2 = 1 AND NOT regexp_matches(regexp_replace(p_name, '^a', 'A'), '[A-Z]')",
    ),
}
