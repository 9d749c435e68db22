"""Queries on triples, occurrences and hierarchies, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import hierarchy as H
from strandline.operators import relations as R
from strandline.operators.loops import few
from strandline.operators import samples as S
from strandline.sources import bindings as B

USEFUL = ["P1", "P2", "P3", "P5", "P31"]


def _closed(s):
    return H.closure(B.subprops(s))


def _closed_tree(s, d):
    return H.closure(B.tree(s, d))


def _useful(s):
    return s.createDataFrame([(p,) for p in USEFUL], "pid string")


def _parts(s, d):
    return B.table(s, d, "part").where("p_size <= 25").select(B.entity(5, "p_partkey").alias("entity")).unionAll(B.table(s, d, "supplier").select(B.entity(4, "s_suppkey")))


PARTS = """SELECT 'Q' || CAST(5000000000 + p_partkey AS VARCHAR) AS entity FROM part WHERE p_size <= 25
  UNION ALL SELECT 'Q' || CAST(4000000000 + s_suppkey AS VARCHAR) FROM supplier"""
_KEYS = """best AS (SELECT entity, type FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY depth DESC, pos) AS n FROM types) WHERE n = 1),
  keyed AS (SELECT pid, o.h, o.t, coalesce(a.type, 'Q') AS h_type, coalesce(b.type, 'Q') AS t_type
            FROM (SELECT DISTINCT pid, h, t FROM occs) o LEFT JOIN best a ON a.entity = o.h LEFT JOIN best b ON b.entity = o.t),
  keys AS (SELECT pid, h_type, t_type, count(*) AS n FROM keyed GROUP BY pid, h_type, t_type),
  placed AS (SELECT *, sum(n) OVER (PARTITION BY pid) AS total, row_number() OVER (PARTITION BY pid ORDER BY n, h_type, t_type) AS least,
                    row_number() OVER (PARTITION BY pid ORDER BY n DESC, h_type, t_type) AS most FROM keys)"""
_OWN = "pid || '_' || h_type || '_' || t_type"
_NAME = f"CASE WHEN n >= 0.01 * total AND least > 1 THEN {_OWN} ELSE pid END"
_MAJOR = f"CASE WHEN most = 1 THEN pid WHEN n >= 0.01 * total AND least > 1 THEN {_OWN} ELSE pid || '_LONGTAIL' END"
_V = B.with_views


def _after(names: str, extra: str, body: str) -> str:
    """Views, further named queries, and the body."""
    return _V(names, "§ " + body).replace(" § ", f", {extra} ", 1)


CATALOG = {
    "split_property_counts": (
        lambda s, d: R.split_counts(B.occs(s, d), B.types(s, d)),
        _after("occs types", _KEYS, f"SELECT pid, {_NAME} AS name, CAST(sum(n) AS BIGINT) AS cnt FROM placed GROUP BY 1, 2"),
    ),
    "split_property_assign": (
        lambda s, d: R.split_by_type(B.occs(s, d), B.types(s, d)),
        _after("occs types", _KEYS, f"SELECT k.pid, k.h, k.t, p.name FROM keyed k JOIN (SELECT *, {_NAME} AS name FROM placed) p USING (pid, h_type, t_type)"),
    ),
    "split_major_as_original": (
        lambda s, d: R.split_counts(B.occs(s, d), B.types(s, d), major_keeps_name=True),
        _after("occs types", _KEYS, f"SELECT pid, {_MAJOR} AS name, CAST(sum(n) AS BIGINT) AS cnt FROM placed GROUP BY 1, 2"),
    ),
    "split_leaf_edges": (
        lambda s, d: _split_leaf_edges(s, d),
        _after(
            "occs types subprops", _KEYS,
            f"""SELECT s.parent, coalesce(p.name, s.child) AS child FROM subprops s LEFT JOIN (SELECT DISTINCT pid, {_NAME} AS name FROM placed
            WHERE pid NOT IN (SELECT parent FROM subprops)) p ON p.pid = s.child""",
        ),
    ),
    "occ_partition_stats": (lambda s, d: R.relation_counts(R.entity_pairs(B.triples(s, d))), _V("triples", "SELECT r, count(*) AS cnt FROM triples WHERE regexp_matches(h, '^Q[0-9]+$') AND regexp_matches(t, '^Q[0-9]+$') GROUP BY r")),
    "entity_degree": (lambda s, d: R.entity_degree(B.triples(s, d)), _V("triples", "SELECT entity, count(*) AS cnt FROM (SELECT h AS entity FROM triples UNION ALL SELECT t FROM triples) GROUP BY entity")),
    "filter_ontology": (lambda s, d: R.with_relations(B.triples(s, d), ["P279", "P31"]), _V("triples", "SELECT * FROM triples WHERE r IN ('P279', 'P31')")),
    "filter_triples": (
        lambda s, d: R.useful_triples(B.triples(s, d), _useful(s), _parts(s, d)),
        _after("triples", f"known AS ({PARTS})", f"""SELECT DISTINCT h, r, t FROM triples WHERE r IN ({', '.join(f"'{p}'" for p in USEFUL)}) AND h IN (SELECT entity FROM known) AND (r = 'P31' OR t IN (SELECT entity FROM known))"""),
    ),
    "useful_props": (
        lambda s, d: R.judged_relations(B.triples(s, d), s.createDataFrame([(p,) for p in ["P1", "P5", "P99", "P77"]], "pid string")),
        _after("triples", "f AS (SELECT r, min(h || chr(1) || t) AS first FROM triples GROUP BY r)", """SELECT pid, CASE WHEN first IS NULL THEN 'miss' WHEN regexp_matches(split_part(first, chr(1), 1), '^Q[0-9]+$') AND regexp_matches(split_part(first, chr(1), 2), '^Q[0-9]+$') THEN 'useful' ELSE 'useless' END AS verdict
        FROM (VALUES ('P1'), ('P5'), ('P99'), ('P77')) AS v(pid) LEFT JOIN f ON r = pid"""),
    ),
    "distinct_entities": (lambda s, d: R.distinct_entities(B.triples(s, d)), _V("triples", "SELECT DISTINCT entity FROM (SELECT h AS entity FROM triples UNION ALL SELECT t FROM triples) WHERE regexp_matches(entity, '^Q[0-9]+$')")),
    "popularity_contained": (
        lambda s, d: R.contained_share(R.distinct_entities(B.triples(s, d)), _parts(s, d)),
        _after("triples", f"known AS ({PARTS}), e AS (SELECT DISTINCT entity FROM (SELECT h AS entity FROM triples UNION ALL SELECT t FROM triples) WHERE regexp_matches(entity, '^Q[0-9]+$'))", "SELECT count(*) AS entities, count(CASE WHEN entity IN (SELECT entity FROM known) THEN 1 END) AS contained FROM e"),
    ),
    "populate_ancestors": (
        lambda s, d: R.with_ancestors(B.occs(s, d), _closed(s)).groupBy("pid").agg(F.count(F.lit(1)).alias("cnt"), F.min("h").alias("first_h")),
        _V("occs subprops closure", "SELECT pid, count(*) AS cnt, min(h) AS first_h FROM (SELECT pid, h, t FROM occs UNION SELECT anc, h, t FROM occs JOIN closure ON des = pid) GROUP BY pid"),
    ),
    "populate_bottom_up": (
        lambda s, d: H.populated(B.occs(s, d), B.subprops(s), ["P20"]).groupBy("pid").agg(F.count(F.lit(1)).alias("cnt")),
        _V("occs subprops", "SELECT pid, count(*) AS cnt FROM (SELECT pid, h, t FROM occs UNION SELECT a.anc, h, t FROM occs JOIN (WITH RECURSIVE c AS (SELECT parent AS anc, child AS des FROM subprops WHERE child <> 'P20' UNION ALL SELECT c.anc, s.child FROM c JOIN subprops s ON s.parent = c.des WHERE s.child <> 'P20') SELECT * FROM c) a ON a.des = pid) GROUP BY pid"),
    ),
    "occ_minus": (lambda s, d: R.minus(B.occs(s, d), "P10", ["P11", "P12"]), _V("occs", "SELECT h, t FROM occs WHERE pid = 'P10' EXCEPT SELECT h, t FROM occs WHERE pid IN ('P11', 'P12')")),
    "dedup_child_ancestor": (
        lambda s, d: R.without_descendants(B.occs(s, d), _closed(s)).groupBy("pid").agg(F.count(F.lit(1)).alias("cnt"), F.max("h").alias("last_h")),
        _V("occs subprops closure", """SELECT pid, count(*) AS cnt, max(h) AS last_h FROM (
          SELECT pid, h, t FROM occs WHERE pid NOT IN (SELECT anc FROM closure)
          UNION ALL SELECT * FROM (SELECT pid, h, t FROM occs WHERE pid IN (SELECT anc FROM closure) EXCEPT SELECT anc, h, t FROM occs JOIN closure ON des = pid)) GROUP BY pid"""),
    ),
    "occ_overlap_ratio": (
        lambda s, d: R.overlap_ratio(B.occs(s, d), _closed(s)).withColumn("ratio", F.round("ratio", 6)),
        _V("occs subprops closure", """SELECT anc, des, round(sum(CASE WHEN b.h IS NULL THEN 0 ELSE 1 END) / count(*), 6) AS ratio FROM (SELECT DISTINCT anc, des FROM closure) c
          JOIN (SELECT DISTINCT pid, h, t FROM occs) a ON a.pid = des LEFT JOIN (SELECT DISTINCT pid, h, t FROM occs) b ON b.pid = anc AND b.h = a.h AND b.t = a.t GROUP BY anc, des"""),
    ),
    "ancestor_overlap_mean": (
        lambda s, d: R.overlap_ratio(B.occs(s, d), _closed(s)).groupBy("anc").agg(F.round(F.avg("ratio"), 6).alias("mean")),
        _V("occs subprops closure", """SELECT anc, round(avg(ratio), 6) AS mean FROM (SELECT anc, des, sum(CASE WHEN b.h IS NULL THEN 0 ELSE 1 END) / count(*) AS ratio FROM (SELECT DISTINCT anc, des FROM closure) c
          JOIN (SELECT DISTINCT pid, h, t FROM occs) a ON a.pid = des LEFT JOIN (SELECT DISTINCT pid, h, t FROM occs) b ON b.pid = anc AND b.h = a.h AND b.t = a.t GROUP BY anc, des) GROUP BY anc"""),
    ),
    "first_n_per_prop": (lambda s, d: R.first_per_key(B.occs(s, d).distinct(), ["pid"], ["h", "t"], 20), _V("occs", "SELECT pid, h, t FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY h, t) AS n FROM (SELECT DISTINCT * FROM occs)) WHERE n <= 20")),
    "downsample_sqrt": (
        lambda s, d: R.downsample(B.occs(s, d)),
        _V("occs", "SELECT pid, h, t FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY h, t) AS k, count(*) OVER (PARTITION BY pid) AS n FROM occs) WHERE k <= floor(least(n, sqrt(n) * 10))"),
    ),
    "downsample_popularity_f1": (
        lambda s, d: R.downsample_by_popularity(B.occs(s, d), R.entity_degree(B.triples(s, d))),
        _after("occs triples", "pop AS (SELECT entity, count(*) AS cnt FROM (SELECT h AS entity FROM triples UNION ALL SELECT t FROM triples) GROUP BY entity), n AS (SELECT pid, count(*) AS n FROM occs GROUP BY pid)", """SELECT pid, h, t FROM (
          SELECT o.pid, o.h, o.t, row_number() OVER (PARTITION BY o.pid ORDER BY coalesce(1 / (1 / a.cnt + 1 / b.cnt), 0) DESC, o.h, o.t) AS k, floor(least(n, sqrt(least(n, 100000)) * 10)) AS bound
          FROM (SELECT DISTINCT * FROM occs) o JOIN n USING (pid) LEFT JOIN pop a ON a.entity = o.h LEFT JOIN pop b ON b.entity = o.t) WHERE k <= bound"""),
    ),
    "chunk_occs": (
        lambda s, d: R.chunked(B.occs(s, d), 50),
        _V("occs", "SELECT pid, (k - 1) // 50 AS chunk, count(*) AS n, min(h) AS first_h FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY h, t) AS k FROM (SELECT DISTINCT * FROM occs)) GROUP BY 1, 2"),
    ),
    "deepest_type": (lambda s, d: R.deepest_type(B.types(s, d)), _V("types", "SELECT entity, type FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY depth DESC, pos) AS n FROM types) WHERE n = 1")),
    "drop_consecutive_dups": (
        lambda s, d: R.drop_consecutive(B.table(s, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], "event_type"),
        "SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events) WHERE was IS NULL OR was <> event_type",
    ),
    "trailing_mean": (
        lambda s, d: R.trailing_mean(B.table(s, d, "events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"], "value").select("event_id", F.round("mean", 4).alias("mean")),
        "SELECT event_id, round(mean, 4) AS mean FROM (SELECT event_id, avg(value) OVER w AS mean, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) WHERE n > 10",
    ),
    "event_property_scalars": (
        lambda s, d: B.table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.date_format("ts", "d MMMM yyyy").alias("day")),
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, strftime(ts, '%-d %B %Y') AS day FROM events",
    ),
    "last_wins_map": (
        lambda s, d: R.last_wins(B.table(s, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey"), "o_custkey", "o_orderpriority", "o_orderkey"),
        "SELECT o_custkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1",
    ),
    "parallel_props": (
        lambda s, d: R.parallel_relations(B.triples(s, d).unionAll(B.triples(s, d).where("r in ('P2', 'P5')").select(F.col("t").alias("h"), F.concat("r", F.lit("_back")).alias("r"), F.col("h").alias("t")))),
        _after("triples", "own AS (SELECT DISTINCT h, r, t FROM (SELECT * FROM triples UNION ALL SELECT t, r || '_back', h FROM triples WHERE r IN ('P2', 'P5')) WHERE regexp_matches(h, '^Q[0-9]+$') AND regexp_matches(t, '^Q[0-9]+$'))", "SELECT a.r, b.r AS against, count(*) AS cnt FROM own a JOIN own b ON a.h = b.t AND a.t = b.h WHERE a.r <> b.r GROUP BY 1, 2 HAVING count(*) >= 3"),
    ),
    "cumulative_mass": (
        lambda s, d: R.cumulative_seeds(R.entity_degree(B.triples(s, d)), "entity", 0.5),
        _after("triples", "deg AS (SELECT entity, count(*) AS cnt FROM (SELECT h AS entity FROM triples UNION ALL SELECT t FROM triples) GROUP BY entity)", "SELECT entity, cnt, CAST(through AS BIGINT) AS through FROM (SELECT *, sum(cnt) OVER (ORDER BY cnt DESC, entity ROWS UNBOUNDED PRECEDING) AS through, sum(cnt) OVER () AS total FROM deg) WHERE through < 0.5 * total"),
    ),
    "hash_shuffle_sample": (lambda s, d: R.shuffled_sample(B.table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 7, 100), "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('7:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100"),
    "is_parent": (lambda s, d: B.tree(s, d).select("parent", "child").distinct(), _V("tree", "SELECT DISTINCT parent, child FROM tree")),
    "is_sibling": (lambda s, d: H.siblings(B.tree(s, d)), _V("tree", "SELECT DISTINCT x.child AS a, y.child AS b FROM tree x JOIN tree y USING (parent) WHERE x.child <> y.child")),
    "hierarchy_closure": (lambda s, d: _closed_tree(s, d).withColumn("depth", F.col("depth").cast("long")), _V("tree tree_closure", "SELECT anc, des, CAST(depth AS BIGINT) AS depth, count(*) AS paths FROM tree_closure GROUP BY 1, 2, 3")),
    "hierarchy_shape": (
        lambda s, d: H.shape(B.tree_nodes(s, d), _closed_tree(s, d)).select("pid", F.col("height").cast("long").alias("height"), F.col("descendants").cast("long").alias("descendants"), "leaf"),
        _V("tree tree_closure tree_nodes", "SELECT pid, CAST(coalesce(max(depth), 0) AS BIGINT) AS height, count(DISTINCT des) AS descendants, max(depth) IS NULL AS leaf FROM tree_nodes LEFT JOIN tree_closure ON anc = pid GROUP BY pid"),
    ),
    "isolated_props": (lambda s, d: H.roots(B.tree_nodes(s, d), B.tree(s, d)), _V("tree tree_nodes", "SELECT pid, pid NOT IN (SELECT parent FROM tree) AS isolated FROM tree_nodes WHERE pid NOT IN (SELECT child FROM tree)")),
    "deepest_parent_only": (
        lambda s, d: H.deepest_parent_only(B.tree(s, d), B.tree_nodes(s, d), _closed_tree(s, d)),
        _V("tree tree_closure tree_nodes", "SELECT parent, child FROM (SELECT s.parent, s.child, row_number() OVER (PARTITION BY s.child ORDER BY coalesce(depth, 0) DESC, s.parent) AS n FROM tree s LEFT JOIN (SELECT des, max(depth) AS depth FROM tree_closure GROUP BY des) ON des = s.parent) WHERE n = 1"),
    ),
    "subtree_prune": (
        lambda s, d: H.pruned(B.tree(s, d), _closed_tree(s, d), ["EUROPE", "small"]),
        _after("tree tree_closure", "gone AS (SELECT des AS pid FROM tree_closure WHERE anc IN ('EUROPE', 'small') UNION SELECT unnest(['EUROPE', 'small']))", "SELECT parent, child FROM tree WHERE child NOT IN (SELECT pid FROM gone) AND parent NOT IN (SELECT pid FROM gone)"),
    ),
    "subtree_lines": (lambda s, d: H.subtree_lines(B.tree(s, d), B.tree_nodes(s, d)), _V("tree tree_nodes", "SELECT pid, coalesce(string_agg(DISTINCT child, ',' ORDER BY child), '') AS children FROM tree_nodes LEFT JOIN tree ON parent = pid GROUP BY pid")),
    "populate_text_counts": (
        lambda s, d: H.populated_counts(B.occs(s, d).groupBy("pid", F.col("t").alias("key")).agg(F.count(F.lit(1)).alias("cnt")), _closed(s)),
        _V("occs subprops closure", "SELECT pid, key, CAST(sum(cnt) AS BIGINT) AS cnt FROM (SELECT pid, t AS key, count(*) AS cnt FROM occs GROUP BY 1, 2 UNION ALL SELECT anc, t, count(*) FROM occs JOIN closure ON des = pid GROUP BY 1, 2) GROUP BY 1, 2"),
    ),
    "disjoint_splits": (
        lambda s, d: S.disjoint(B.tree(s, d).select(F.col("child").alias("pid")), B.tree(s, d).select(F.col("parent").alias("pid")), B.tree_nodes(s, d)),
        _V("tree tree_nodes", "SELECT DISTINCT child AS pid, 'test' AS split FROM tree UNION ALL SELECT DISTINCT parent, 'dev' FROM tree WHERE parent NOT IN (SELECT child FROM tree) UNION ALL SELECT pid, 'train' FROM tree_nodes WHERE pid NOT IN (SELECT child FROM tree) AND pid NOT IN (SELECT parent FROM tree)"),
    ),
    "nway_samples": (
        lambda s, d: S.nway_samples(R.chunked(B.occs(s, d), 50), B.subprops(s)),
        _V("occs subprops", "SELECT s.parent AS label, c.pid, c.chunk, c.n FROM (SELECT pid, (k - 1) // 50 AS chunk, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY h, t) AS k FROM (SELECT DISTINCT * FROM occs)) GROUP BY 1, 2) c JOIN subprops s ON s.child = c.pid"),
    ),
    "pointwise_pairs": (
        lambda s, d: S.pointwise_pairs(B.tree(s, d).select(F.col("parent").alias("pid")).distinct(), B.tree_nodes(s, d), _closed_tree(s, d)).withColumn("label", F.col("label").cast("long")),
        _V("tree tree_closure tree_nodes", "SELECT p.parent, q.pid AS child, CAST(CASE WHEN EXISTS (SELECT 1 FROM tree_closure c WHERE c.anc = p.parent AND c.des = q.pid) THEN 1 ELSE 0 END AS BIGINT) AS label FROM (SELECT DISTINCT parent FROM tree) p JOIN tree_nodes q ON p.parent <> q.pid"),
    ),
    "pm2_split": (lambda s, d: S.proportional_split(B.table(s, d, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("member"), F.col("p_partkey").alias("order")), [("train", 0.6), ("dev", 0.2), ("test", 0.2)]),
        """WITH RECURSIVE m AS (SELECT p_brand AS grp, p_partkey AS member, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nth FROM part),
          deal AS (SELECT 1 AS i, 1 AS a, 0 AS b, 0 AS c, 'train' AS split UNION ALL
            SELECT i + 1, a + CASE WHEN s = 'train' THEN 1 ELSE 0 END, b + CASE WHEN s = 'dev' THEN 1 ELSE 0 END, c + CASE WHEN s = 'test' THEN 1 ELSE 0 END, s FROM (
              SELECT *, CASE WHEN 6 * i - 10 * a >= greatest(2 * i - 10 * b, 2 * i - 10 * c) THEN 'train' WHEN 2 * i - 10 * b >= 2 * i - 10 * c THEN 'dev' ELSE 'test' END AS s FROM deal WHERE i < (SELECT max(nth) FROM m)))
          SELECT m.grp, m.member, deal.split FROM m JOIN deal ON i = nth"""),
    "negatives_to_positives": (
        lambda s, d: S.positives_and_some_negatives(B.table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("label")), 1.5, "o_orderkey").groupBy("label").agg(F.count(F.lit(1)).alias("cnt"), F.sum("o_orderkey").alias("keys")).withColumn("label", F.col("label").cast("long")),
        """WITH o AS (SELECT o_orderkey, o_orderpriority = '1-URGENT' AS p FROM orders), z AS (SELECT floor(count(CASE WHEN p THEN 1 END) * 1.5) AS want FROM o),
          n AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY substr(md5('1:' || o_orderkey), 1, 12), o_orderkey) AS k FROM o)
          SELECT CAST(p AS BIGINT) AS label, count(*) AS cnt, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM n, z WHERE p OR k <= want GROUP BY 1"""),
}


def _split_leaf_edges(s, d):
    """The hierarchy with leaves replaced by what they are split into."""
    edges = B.subprops(s)
    leaves = edges.select(F.col("child").alias("pid")).distinct().join(edges.select(F.col("parent").alias("pid")), "pid", "left_anti")
    names = R.split_counts(B.occs(s, d).join(few(leaves), "pid", "left_semi"), B.types(s, d)).select("pid", "name")
    return edges.join(names, edges.child == names.pid, "left").select("parent", F.coalesce("name", "child").alias("child"))
