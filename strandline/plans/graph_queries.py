"""Queries on the entity graph, the ontology and the page graph, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import graph as G
from strandline.operators import relations as R
from strandline.operators import samples as S
from strandline.sources import bindings as B
from strandline.plans.relation_queries import _after

_V = B.with_views

#: A cycle below a layered type, a self loop, and two paths of different lengths to one node.
EXTRA_EDGES = [("Qx1", "Qx2"), ("Qx2", "Qx3"), ("Qx3", "Qx1"), ("Qx1", "Q7000000001"), ("Qy1", "Qy1"), ("Qx4", "Qx2"), ("Qx4", "Qx5"), ("Qx5", "Qx4"), ("Qx5", "Q7000000200"), ("Qz1", "Qz2"), ("Qz2", "Qz3"), ("Qz1", "Qz3")]
_EXTRA = ", ".join(f"('{a}', '{b}')" for a, b in EXTRA_EDGES)


def _ontology(s, d):
    """Edges (child, parent) of types, with a cycle."""
    own = B.triples(s, d).where("r in ('P31', 'P279')").select(F.col("h").alias("child"), F.col("t").alias("parent"))
    return own.unionAll(s.createDataFrame(EXTRA_EDGES, "child string, parent string")).distinct()


_ONTO = f"onto AS (SELECT h AS child, t AS parent FROM triples WHERE r IN ('P31', 'P279') UNION SELECT * FROM (VALUES {_EXTRA}) AS v(child, parent))"


# A node that reaches itself, or is below such a node, has no layer.
_LAYERED = _ONTO + """, beyond AS (SELECT parent AS node, child AS below FROM onto UNION SELECT b.node, o.child FROM beyond b JOIN onto o ON o.parent = b.below),
  cyclic AS (SELECT node FROM beyond WHERE node = below UNION SELECT below FROM beyond WHERE node IN (SELECT node FROM beyond WHERE node = below)), plain AS (SELECT * FROM onto WHERE child NOT IN (SELECT node FROM cyclic)),
  deep AS (SELECT node, CAST(0 AS BIGINT) AS layer FROM (SELECT parent AS node FROM onto UNION SELECT child FROM onto) WHERE node NOT IN (SELECT child FROM plain) AND node NOT IN (SELECT node FROM cyclic)
    UNION ALL SELECT p.child, d.layer + 1 FROM deep d JOIN plain p ON p.parent = d.node)"""


def _customers(s, d):
    return B.table(s, d, "customer").select(B.entity(3, "c_custkey").alias("entity"))


_CUSTOMERS = "seeds AS (SELECT 'Q' || CAST(3000000000 + c_custkey AS VARCHAR) AS entity FROM customer)"


def _occs_of_customers(s, d):
    return B.triples(s, d).select(F.col("r").alias("pid"), "h", "t")


_FEATURES = """own AS (SELECT DISTINCT r AS pid, h, t FROM triples),
  edges AS (SELECT pid, 'one' AS kind, h AS src, t AS dst FROM own
    UNION SELECT o.pid, 'head', x.h, x.t FROM own o JOIN triples x ON x.h = o.h WHERE x.r <> o.pid
    UNION SELECT o.pid, 'tail', x.h, x.t FROM own o JOIN triples x ON x.h = o.t WHERE x.r <> o.pid)"""

CATALOG = {
    "khop_walks": (
        lambda s, d: G.walks(_customers(s, d), B.triples(s, d), 2).select("root", F.array_join("relations", ",").alias("relations"), "id", F.col("depth").cast("long").alias("depth")),
        _after("triples", _CUSTOMERS + ", step AS (SELECT * FROM triples)", """SELECT entity AS root, '' AS relations, entity AS id, CAST(0 AS BIGINT) AS depth FROM seeds
          UNION ALL SELECT entity, r, t, 1 FROM seeds JOIN step ON h = entity
          UNION ALL SELECT entity, a.r || ',' || b.r, b.t, 2 FROM seeds JOIN step a ON a.h = entity JOIN step b ON b.h = a.t"""),
    ),
    "one_hop_subgraph": (
        lambda s, d: G.one_hop(G.walks(_customers(s, d), B.triples(s, d), 1)),
        _after("triples", _CUSTOMERS, "SELECT entity AS root, r, t FROM seeds JOIN triples ON h = entity"),
    ),
    "topo_depth": (
        lambda s, d: G.layers(_ontology(s, d).select(F.col("parent").alias("src"), F.col("child").alias("dst"))).withColumn("layer", F.col("layer").cast("long")),
        _after("triples", _LAYERED, "SELECT node, max(layer) AS layer FROM deep GROUP BY node"),
    ),
    "category_ancestors": (
        lambda s, d: G.ancestors_until_root(B.table(s, d, "part").select(B.entity(5, "p_partkey").alias("node")), _ontology(s, d), s.createDataFrame([("Q7000000200",)], "node string")),
        _after("triples", _ONTO + """, seeds AS (SELECT 'Q' || CAST(5000000000 + p_partkey AS VARCHAR) AS node FROM part),
          climb AS (SELECT node AS seed, node FROM seeds UNION SELECT c.seed, o.parent FROM climb c JOIN onto o ON o.child = c.node WHERE o.parent <> 'Q7000000200')""", "SELECT seed, node FROM climb"),
    ),
    "top_level_attach": (
        lambda s, d: G.nearest_top(_ontology(s, d).select(F.explode(F.array("child", "parent")).alias("node")), _ontology(s, d), s.createDataFrame([(f"Q{7000000100 + i}",) for i in range(5)], "node string")).withColumn("depth", F.col("depth").cast("long")),
        _after("triples", _ONTO + """, tops AS (SELECT DISTINCT parent AS node FROM onto WHERE parent BETWEEN 'Q7000000100' AND 'Q7000000104'),
          up AS (SELECT node, node AS top, CAST(0 AS BIGINT) AS depth FROM tops UNION SELECT o.child, u.top, u.depth + 1 FROM up u JOIN onto o ON o.parent = u.node WHERE u.depth < 8)""",
          """SELECT n.node, b.top, coalesce(b.depth, -1) AS depth FROM (SELECT child AS node FROM onto UNION SELECT parent FROM onto) n
          LEFT JOIN (SELECT node, top, depth FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY depth, top) AS k FROM up) WHERE k = 1) b ON b.node = n.node"""),
    ),
    "page_entity_closure": (
        lambda s, d: G.reachable(B.page_links(s, d).agg(F.min("entity").alias("entity")), B.page_links(s, d)).select("node"),
        _after("page_links", "hop AS (SELECT min(entity) AS node FROM page_links UNION SELECT b.entity FROM hop JOIN page_links a ON a.entity = hop.node JOIN page_links b ON b.page = a.page)", "SELECT DISTINCT node FROM hop"),
    ),
    "page_entity_counts": (
        lambda s, d: B.page_links(s, d).select(F.try_url_decode(F.regexp_replace("entity", "^/", "")).alias("entity"), "page").groupBy("entity").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("page").alias("pages")),
        _V("page_links", "SELECT url_decode(regexp_replace(entity, '^/', '')) AS entity, count(*) AS links, count(DISTINCT page) AS pages FROM page_links GROUP BY 1"),
    ),
    "gnn_edges": (lambda s, d: G.edge_features(_occs_of_customers(s, d), B.triples(s, d)), _after("triples", _FEATURES, "SELECT * FROM edges")),
    "bow_log_weights": (
        lambda s, d: S.log_weights(G.edge_features(_occs_of_customers(s, d), B.triples(s, d))).withColumn("weight", F.round("weight", 6)),
        _after("triples", _FEATURES, "SELECT pid, id, round(ln(1 + count(*)), 6) AS weight FROM (SELECT pid, src AS id FROM edges UNION ALL SELECT pid, dst FROM edges) GROUP BY 1, 2"),
    ),
    "id_frequency": (
        lambda s, d: G.id_frequency(B.triples(s, d).select(F.col("r").alias("pid"), F.col("h").alias("src"), F.col("t").alias("dst"))),
        _after("triples", "freq AS (SELECT id, count(DISTINCT r) AS samples FROM (SELECT r, h AS id FROM triples UNION ALL SELECT r, t FROM triples) GROUP BY id)", "SELECT id, samples, row_number() OVER (ORDER BY samples DESC, id) - 1 AS ind FROM freq"),
    ),
    "degree_index": (
        lambda s, d: G.numbered_by_count(R.entity_degree(B.triples(s, d)), "entity", "cnt"),
        _after("triples", "deg AS (SELECT entity, count(*) AS cnt FROM (SELECT h AS entity FROM triples UNION ALL SELECT t FROM triples) GROUP BY entity)", "SELECT entity, cnt, row_number() OVER (ORDER BY cnt DESC, entity) - 1 AS ind FROM deg"),
    ),
    "ontology_tops": (
        lambda s, d: G.top_nodes(B.triples(s, d).where("r = 'P279'").select(F.col("h").alias("child"), F.col("t").alias("parent")), 50, 2),
        # All three levels would be 56 nodes.
        _V("triples", "SELECT DISTINCT t AS node FROM triples WHERE r = 'P279'"),
    ),
    "ontology_instances": (
        lambda s, d: G.attached_instances(B.triples(s, d).where("r = 'P31'").select(F.col("h").alias("entity"), F.col("t").alias("node")), G.nearest_top(B.triples(s, d).where("r = 'P279'").select(F.col("h").alias("node")), B.triples(s, d).where("r = 'P279' and h <> 'Q7000000013'").select(F.col("h").alias("child"), F.col("t").alias("parent")), s.createDataFrame([(f"Q{7000000100 + i}",) for i in range(5)], "node string"))),
        "SELECT 'Q' || CAST(5000000000 + p_partkey AS VARCHAR) AS entity, CASE WHEN p_size = 13 THEN '-1' ELSE 'Q' || CAST(7000000100 + p_size % 5 AS VARCHAR) END AS top FROM part",
    ),
    "topo_depth_cyclic": (
        lambda s, d: G.layers_of_all(_ontology(s, d).select(F.col("parent").alias("src"), F.col("child").alias("dst"))).where("cyclic").select("node", F.col("layer").cast("long").alias("layer")),
        # Every way from a layered node down through others, no longer than there are nodes without a layer.
        _after("triples", _LAYERED + """, known AS (SELECT node, max(layer) AS layer FROM deep GROUP BY node), every AS (SELECT parent AS node FROM onto UNION SELECT child FROM onto),
          rest AS (SELECT node FROM every WHERE node NOT IN (SELECT node FROM known)),
          way AS (SELECT o.child AS node, k.layer, 1 AS steps FROM onto o JOIN known k ON k.node = o.parent WHERE o.child IN (SELECT node FROM rest)
            UNION SELECT o.child, w.layer, w.steps + 1 FROM way w JOIN onto o ON o.parent = w.node WHERE o.child IN (SELECT node FROM rest) AND w.steps <= (SELECT count(*) FROM rest)),
          near AS (SELECT node, layer + steps AS layer FROM way QUALIFY row_number() OVER (PARTITION BY node ORDER BY steps, layer DESC) = 1)""", "SELECT r.node, coalesce(n.layer, 0) AS layer FROM rest r LEFT JOIN near n USING (node)"),
    ),
    "gcn_propagate": (
        lambda s, d: G.propagated(
            R.entity_pairs(B.triples(s, d)).select(F.col("h").alias("src"), F.col("t").alias("dst")),
            R.distinct_entities(R.entity_pairs(B.triples(s, d))).select(F.col("entity").alias("node"), (F.substring("entity", 11, 1).cast("double") + 1).alias("x")),
        ).withColumn("x", F.round("x", 6)),
        _after("triples", """e AS (SELECT h AS src, t AS dst FROM triples WHERE regexp_matches(h, '^Q[0-9]+$') AND regexp_matches(t, '^Q[0-9]+$')), v AS (SELECT DISTINCT node, CAST(substr(node, 11, 1) AS DOUBLE) + 1 AS x FROM (SELECT src AS node FROM e UNION SELECT dst FROM e)),
          l AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e UNION SELECT node, node FROM v), g AS (SELECT dst, count(*) AS d FROM l GROUP BY dst)""",
          "SELECT l.dst AS node, round(sum(v.x / sqrt(a.d * b.d)), 6) AS x FROM l JOIN v ON v.node = l.src JOIN g a ON a.dst = l.src JOIN g b ON b.dst = l.dst GROUP BY l.dst"),
    ),
}
