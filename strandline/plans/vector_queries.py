"""Queries on vectors, rankings and metrics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import metrics as M
from strandline.operators import pair_scores as P
from strandline.operators import vectors as V
from strandline.plans.relation_queries import _after
from strandline.sources import bindings as B

_V = B.with_views
DIMS = 64

_LONG = """long AS (SELECT pid, id, CAST(unnest(range(64)) AS BIGINT) AS dim, CAST(unnest(vec) AS DOUBLE) AS x FROM vectors),
  mean AS (SELECT pid, dim, avg(x) AS x FROM long GROUP BY 1, 2),
  scores AS (SELECT a.pid AS p1, b.pid AS p2, sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))) AS cosine, -sqrt(sum((a.x - b.x) * (a.x - b.x))) AS distance, sum(a.x * b.x) AS dot
             FROM mean a JOIN mean b ON a.dim = b.dim AND a.pid <> b.pid GROUP BY 1, 2)"""
_MET = """met AS (SELECT a.pid AS p1, b.pid AS p2, a.id AS c, b.id AS p, pow(list_distance(CAST(a.vec AS DOUBLE[]), CAST(b.vec AS DOUBLE[])), 2) AS d2 FROM vectors a JOIN vectors b ON a.pid <> b.pid),
  lows AS (SELECT p1, p2, c, min(d2) AS low FROM met GROUP BY 1, 2, 3), low AS (SELECT * FROM met JOIN lows USING (p1, p2, c))"""


def _all(s, d, score, *more):
    rows = B.vectors(s, d)
    return score(rows, P.all_pairs(rows), *more)


def _scores(s, d):
    return V.mean_scores(B.vectors(s, d)).select("p1", "p2", ((F.col("cosine") + 1) / 2).alias("score"))


def _parents(s):
    """Relations whose numbers agree modulo 3 are parent and child."""
    return s.createDataFrame([(f"P{i}", f"P{j}") for i in range(10) for j in range(10) if i != j and i % 3 == j % 3], "p1 string, p2 string")


def _ancestors(s):
    return s.createDataFrame([(f"P{i}", f"P{j}") for i in range(10) for j in range(10) if i != j and i % 2 == j % 2], "p1 string, p2 string")


_TRUE = "truth AS (SELECT 'P' || CAST(i AS VARCHAR) AS p1, 'P' || CAST(j AS VARCHAR) AS p2, i % 3 = j % 3 AS parent, i % 2 = j % 2 AS above FROM range(10) a(i), range(10) b(j) WHERE i <> j)"
_SCORED = _LONG + ", " + _TRUE + ", scored AS (SELECT s.p1, s.p2, (cosine + 1) / 2 AS score, parent, above, row_number() OVER (PARTITION BY s.p1 ORDER BY cosine DESC, s.p2) AS rank FROM scores s JOIN truth t ON s.p1 = t.p1 AND s.p2 = t.p2)"


def _tagged(s, d):
    return M.tagged_ranks(_scores(s, d), _parents(s), _ancestors(s))


def _logits(s, d):
    """Each vector as a sample: its dot product with the other relations' means."""
    means = V.mean_vectors(B.vectors(s, d)).select(F.col("pid").alias("candidate"), F.col("vec").alias("m"))
    rows = B.vectors(s, d).select(F.col("id").alias("sample"), "pid", F.concat(F.lit("P"), ((F.col("pid").substr(2, 9).cast("int") + 3) % 10).cast("string")).alias("label"), "vec")
    # Means are one row a relation, gathered in one small row.
    every = means.agg(F.collect_list(F.struct("candidate", "m")).alias("every"))
    met = rows.crossJoin(F.broadcast(every)).select("sample", "pid", "label", "vec", F.explode("every").alias("e"))
    return met.select("sample", "pid", "label", "e.candidate", V.dot(F.col("vec"), F.col("e.m")).alias("logit"))


CATALOG = {
    "prop_mean_vector": (
        lambda s, d: V.mean_vectors(B.vectors(s, d)).select("pid", F.posexplode("vec").alias("dim", "x")).select("pid", F.col("dim").cast("long").alias("dim"), F.round("x", 5).alias("x")),
        _after("vectors", _LONG, "SELECT pid, dim, round(x, 5) AS x FROM mean"),
    ),
    "prop_gaussian": (
        lambda s, d: V.gaussians(B.vectors(s, d)).select("pid", F.col("dim").cast("long").alias("dim"), F.round("mean", 5).alias("mean"), F.round("variance", 5).alias("variance")),
        _after("vectors", _LONG, "SELECT pid, dim, round(avg(x), 5) AS mean, round(var_samp(x), 5) AS variance FROM long GROUP BY 1, 2"),
    ),
    "mean_vector_scores": (
        lambda s, d: V.mean_scores(B.vectors(s, d)).select("p1", "p2", *[F.round(c, 5).alias(c) for c in ("cosine", "distance", "dot")]),
        _after("vectors", _LONG, "SELECT p1, p2, round(cosine, 5) AS cosine, round(distance, 5) AS distance, round(dot, 5) AS dot FROM scores"),
    ),
    "pairwise_cosine": (
        lambda s, d: V.pairwise_cosine(B.vectors(s, d)).withColumn("score", F.round("score", 5)),
        _after("vectors", "unit AS (SELECT pid, CAST(unnest(range(64)) AS BIGINT) AS dim, CAST(unnest(vec) AS DOUBLE) / sqrt(list_inner_product(CAST(vec AS DOUBLE[]), CAST(vec AS DOUBLE[]))) AS x FROM vectors), mean AS (SELECT pid, dim, avg(x) AS x FROM unit GROUP BY 1, 2)", "SELECT a.pid AS p1, b.pid AS p2, round(sum(a.x * b.x), 5) AS score FROM mean a JOIN mean b ON a.dim = b.dim AND a.pid <> b.pid GROUP BY 1, 2"),
    ),
    "euclid_mean": (lambda s, d: _all(s, d, P.euclidean_mean).withColumn("score", F.round("score", 4)), _after("vectors", _MET, "SELECT p1, p2, round(-avg(sqrt(d2)), 4) AS score FROM met GROUP BY 1, 2")),
    "expeuc": (
        lambda s, d: _all(s, d, P.expected_exponential).withColumn("score", F.round("score", 4)),
        _after("vectors", _MET, "SELECT p1, p2, round(avg(s), 4) AS score FROM (SELECT p1, p2, c, ln(avg(exp(low - d2))) - min(low) AS s FROM low GROUP BY 1, 2, 3) GROUP BY 1, 2"),
    ),
    "mixgau": (
        lambda s, d: _all(s, d, P.gaussian_mixture, DIMS).withColumn("score", F.round("score", 2)),
        _after("vectors", _MET, "SELECT p1, p2, round(sum(s), 2) AS score FROM (SELECT p1, p2, c, ln(avg(exp((low - d2) / 2))) - min(low) / 2 - 32 * ln(2 * pi()) AS s FROM low GROUP BY 1, 2, 3) GROUP BY 1, 2"),
    ),
    "knn_props": (
        lambda s, d: V.nearest_relations(B.vectors(s, d), 3).select("p1", F.col("rank").cast("long").alias("rank"), "p2", F.round("cosine", 5).alias("cosine")),
        _after("vectors", _LONG, "SELECT p1, rank, p2, round(cosine, 5) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY p1 ORDER BY cosine DESC, p2) AS rank FROM scores) WHERE rank <= 3"),
    ),
    "hard_split_middle": (
        lambda s, d: V.middle_member(V.mean_vectors(B.vectors(s, d)), s.createDataFrame([(f"G{i % 3}", f"P{i}") for i in range(10)], "grp string, pid string")),
        _after("vectors", _LONG + """, grp AS (SELECT 'G' || CAST(i % 3 AS VARCHAR) AS grp, 'P' || CAST(i AS VARCHAR) AS pid FROM range(10) t(i)),
          central AS (SELECT a.grp, a.pid, avg(coalesce(cosine, 1)) AS c FROM grp a JOIN grp b USING (grp) LEFT JOIN scores ON p1 = a.pid AND p2 = b.pid GROUP BY 1, 2)""",
          "SELECT grp, pid FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY c, pid) AS k, count(*) OVER (PARTITION BY grp) AS n FROM central) WHERE k = n // 2 + 1"),
    ),
    "tagged_ranks": (
        lambda s, d: _tagged(s, d).select("p1", F.col("rank").cast("long").alias("rank"), "p2", "rel"),
        _after("vectors", _SCORED, "SELECT p1, rank, p2, CASE WHEN parent THEN 'parent' WHEN above THEN 'ancestor' ELSE '*' END AS rel FROM scored"),
    ),
    "rank_metrics": (
        lambda s, d: M.rank_metrics(_tagged(s, d)).select(*[F.round(c, 6).alias(c) for c in ("acc1", "acc3", "mrr")]),
        _after("vectors", _SCORED + ", f AS (SELECT p1, min(CASE WHEN parent THEN rank END) AS first FROM scored GROUP BY p1)", "SELECT round(avg(CASE WHEN first = 1 THEN 1.0 ELSE 0.0 END), 6) AS acc1, round(avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0.0 END), 6) AS acc3, round(avg(coalesce(1 / first, 0.0)), 6) AS mrr FROM f"),
    ),
    "confusion": (
        lambda s, d: M.confusion(_scores(s, d), _parents(s)).withColumn("accuracy", F.round("accuracy", 6)),
        _after("vectors", _SCORED, """SELECT count(CASE WHEN score >= 0.5 AND parent THEN 1 END) AS tp, count(CASE WHEN NOT score >= 0.5 AND NOT parent THEN 1 END) AS tn, count(CASE WHEN score >= 0.5 AND NOT parent THEN 1 END) AS fp,
          count(CASE WHEN NOT score >= 0.5 AND parent THEN 1 END) AS fn, round(avg(CASE WHEN (score >= 0.5) = parent THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM scored"""),
    ),
    "average_precision": (
        lambda s, d: M.average_precision(_scores(s, d), _parents(s)).withColumn("ap", F.round("ap", 6)),
        _after("vectors", _SCORED + ", r AS (SELECT *, sum(CASE WHEN parent THEN 1 ELSE 0 END) OVER (PARTITION BY p1 ORDER BY score DESC ROWS UNBOUNDED PRECEDING) / count(*) OVER (PARTITION BY p1 ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS prec FROM scored)", "SELECT p1, round(avg(prec), 6) AS ap FROM r WHERE parent GROUP BY p1"),
    ),
    "best_is_true": (
        lambda s, d: M.best_is_true(_scores(s, d), _parents(s)).withColumn("accuracy", F.round("accuracy", 6)),
        _after("vectors", _SCORED, "SELECT count(*) AS queries, round(avg(CASE WHEN parent THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM scored WHERE rank = 1"),
    ),
    "pointwise_flags": (
        lambda s, d: M.pointwise_flags(_scores(s, d), _parents(s), _ancestors(s)),
        _after("vectors", _SCORED, """SELECT p1, max(CASE WHEN rank = 1 AND parent THEN 1 ELSE 0 END) = 1 AS best,
          max(CASE WHEN parent AND score >= 0.5 THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN NOT parent AND NOT above AND score >= 0.5 THEN 1 ELSE 0 END) = 0 AS product,
          coalesce(max(CASE WHEN parent OR above THEN rank END), 0) < coalesce(min(CASE WHEN NOT parent AND NOT above THEN rank END), 1000000) AS in_order FROM scored GROUP BY p1"""),
    ),
    "nway_macro_micro": (
        lambda s, d: M.nway_accuracy(_logits(s, d)).select(F.round("macro", 6).alias("macro"), F.round("micro", 6).alias("micro")),
        _after("vectors", _LONG + """, logits AS (SELECT l.id, l.pid, m.pid AS candidate, sum(l.x * m.x) AS logit FROM long l JOIN mean m ON l.dim = m.dim WHERE l.pid <> m.pid GROUP BY 1, 2, 3),
          hit AS (SELECT id, pid, max(CASE WHEN rank <= 3 AND candidate = 'P' || CAST((CAST(substr(pid, 2) AS BIGINT) + 3) % 10 AS VARCHAR) THEN 1.0 ELSE 0.0 END) AS hit
            FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY logit DESC, candidate) AS rank FROM logits) GROUP BY 1, 2)""",
          "SELECT round((SELECT avg(h) FROM (SELECT avg(hit) AS h FROM hit GROUP BY pid)), 6) AS macro, round(avg(hit), 6) AS micro FROM hit"),
    ),
}
