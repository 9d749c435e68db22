"""Queries that make data sets of hierarchies, samples and sentences, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import corpus as C
from strandline.operators import datasets as S
from strandline.operators import hierarchy as H
from strandline.operators import relations as R
from strandline.operators import text as T
from strandline.operators import vectors as V
from strandline.operators.loops import checkpointed
from strandline.plans.relation_queries import _after
from strandline.plans.source_queries import _read
from strandline.plans.structure_queries import _IN_SAMPLE, _parts_of_labels, _siblings
from strandline.plans.structure_queries import _dealt as _dealt_samples
from strandline.plans.text_queries import _NAMES, _SNIPPETS, _gaps_and_lists
from strandline.plans.vector_queries import _SCORED, _tagged
from strandline.sources import bindings as B
from strandline.sources import readers
from strandline.sources import writers as W

_V = B.with_views
_SHARES = (0.6, 0.2, 0.2)


# --- splits -------------------------------------------------------------------------------------------------------


def _dealt(known: str = "true") -> str:
    return f"""own AS (SELECT DISTINCT parent, child, md5('1|' || parent || '|' || child) AS place, ('0x' || substr(md5('2|' || parent || '|' || child), 1, 8))::BIGINT / 4294967296.0 AS x FROM tree WHERE {known}),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY place, child) AS nth, count(*) OVER (PARTITION BY parent) AS n, CASE WHEN x < 0.6 THEN 'train' WHEN x < 0.8 THEN 'dev' ELSE 'test' END AS drawn FROM own),
  first AS (SELECT *, CASE WHEN nth <= floor(n * 0.6) THEN 'train' WHEN nth <= floor(n * 0.6) + floor(n * 0.2) THEN 'dev' WHEN nth <= floor(n * 0.6) + 2 * floor(n * 0.2) THEN 'test' ELSE drawn END AS first FROM numbered),
  whole AS (SELECT parent, count(DISTINCT first) = 3 AS whole FROM first GROUP BY parent),
  dealt AS (SELECT parent, child, CASE WHEN whole THEN first ELSE drawn END AS split FROM first JOIN whole USING (parent))"""


def _forest(s, d):
    """The hierarchy without its roots: a tree a region, kind and quality."""
    edges = B.tree(s, d)
    return edges.join(edges.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").select("parent", "child")


_FOREST = "forest AS (SELECT parent, child FROM tree WHERE parent IN (SELECT child FROM tree))"


def _label_splits(s, d):
    """Parts of labels, a tenth each as dev and test."""
    rows = _parts_of_labels(s, d, 12)
    number = F.substring_index("pid", "_", -1).cast("int") % 10
    splits = rows.select("pid").distinct().select("pid", F.when(number == 0, "dev").when(number == 1, "test").otherwise("train").alias("split"))
    return splits, _siblings(rows)


_LABEL_SPLITS = """splits AS (SELECT pid, CASE WHEN CAST(split_part(pid, '_', 2) AS INTEGER) % 10 = 0 THEN 'dev' WHEN CAST(split_part(pid, '_', 2) AS INTEGER) % 10 = 1 THEN 'test' ELSE 'train' END AS split
  FROM (SELECT DISTINCT pid || '_' || CAST(id % 12 AS VARCHAR) AS pid FROM vectors))"""


# --- samples ------------------------------------------------------------------------------------------------------


def _learns(s, d):
    """Terms around each sample, and the samples to fit on: those whose hash begins below c."""
    occs = _dealt_samples(s, d)
    counts = checkpointed(S.neighbour_terms(occs, B.triples(s, d)))
    train = F.substring(F.md5("doc"), 1, 1) < "c"
    return counts, counts.where(train), occs.select(F.col("sample").alias("doc")).distinct().where(train)


def _weighted(counts, fitted, documents):
    return S.weighted_by(counts.where(F.substring(F.md5("doc"), 1, 1) >= "c"), S.fitted_idf(fitted, documents))


_TERMS = f"""occ AS (SELECT r AS pid, h, t, row_number() OVER (PARTITION BY r ORDER BY h, t) - 1 AS n FROM (SELECT DISTINCT h, r, t FROM triples WHERE regexp_matches(h, '^Q[0-9]+$') AND regexp_matches(t, '^Q[0-9]+$'))),
  o AS (SELECT pid || ':' || CAST(n // {_IN_SAMPLE} AS VARCHAR) AS doc, pid, h, t FROM occ),
  around AS (SELECT h AS e, r, count(*) AS n FROM triples GROUP BY 1, 2),
  counts AS (SELECT doc, r AS term, sum(n) AS cnt FROM (SELECT doc, pid, h AS e FROM o UNION ALL SELECT doc, pid, t FROM o) JOIN around USING (e) WHERE split_part(r, '_', 1) <> split_part(pid, '_', 1) GROUP BY 1, 2),
  train AS (SELECT * FROM counts WHERE substr(md5(doc), 1, 1) < 'c'),
  idf AS (SELECT term, ln((1 + (SELECT count(DISTINCT doc) FROM o WHERE substr(md5(doc), 1, 1) < 'c')) / (1 + count(DISTINCT doc))) + 1 AS idf FROM train WHERE length(term) >= 2 GROUP BY term)"""


def _spoken(s, d):
    """A sentence a document: its whole token list, with the second word as head and one of the next twelve as tail."""
    docs = B.table(s, d, "documents").select(F.col("doc_id").alias("sid"), F.concat_ws("_", F.coalesce("lang", F.lit("none")), "source").alias("pid"))
    place = (2 + F.col("sid") % 12).cast("int")
    rows = docs.join(B.token_lists(s, d), "sid").where(F.size("toks") > place)
    return rows.select(F.substring_index("pid", "_", 1).alias("pid"), F.col("sid").alias("h"), F.col("sid").alias("t"), F.array(F.lit(1)).alias("h_span"), F.array(place).alias("t_span"), F.col("toks").alias("tokens"))


_SPOKEN = r"""lists AS (SELECT doc_id AS sid, regexp_extract_all(lower(text), '\p{L}+|[.!?]') AS toks, coalesce(lang, 'none') AS pid FROM documents),
  spoken AS (SELECT * FROM lists WHERE len(toks) > 2 + sid % 12),
  capped AS (SELECT * FROM spoken QUALIFY row_number() OVER (PARTITION BY pid ORDER BY sid) <= 300),
  contexts AS (SELECT pid, word, count(*) AS cnt FROM (SELECT pid, unnest(toks[3 : 2 + sid % 12]) AS word FROM capped WHERE sid % 12 BETWEEN 1 AND 8) GROUP BY 1, 2)"""


def _bagged(s, d):
    contexts = S.sentence_contexts(_spoken(s, d), 8, 300)
    words = contexts.groupBy("word").agg(F.sum("cnt").alias("n")).where("n >= 5").select("word", F.length("word").alias("ind"))
    samples = B.table(s, d, "documents").select(F.col("doc_id").alias("sample"), F.concat_ws("_", F.coalesce("lang", F.lit("none")), "source").alias("pid"))
    return S.known_bags(contexts, words, samples.groupBy("pid").agg(F.min("sample").alias("sample")))


def _pointwise(s, d):
    """Orders of a customer against those of the next one, with 1 for customers of one nation."""
    own = B.table(s, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").cast("string").alias("h"), F.col("o_orderstatus").alias("t")))).alias("occs"))
    a = own.select(F.col("o_custkey").alias("k"), F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("p1"), F.col("occs").alias("occs1"))
    b = own.select((F.col("o_custkey") - 1).alias("k"), F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("p2"), F.col("occs").alias("occs2"))
    return a.join(b, "k").withColumn("label", (F.col("k") % 3).cast("int"))


_OWN = "own AS (SELECT o_custkey AS k, 'P' || CAST(o_custkey AS VARCHAR) AS p, string_agg(CAST(o_orderkey AS VARCHAR) || ' ' || o_orderstatus, ' ' ORDER BY CAST(o_orderkey AS VARCHAR)) AS occs FROM orders GROUP BY 1)"


def _prompts(s, d):
    """A prompt a part: its name between slots in one of four orders, some with a capital."""
    k = F.col("p_partkey") % 4
    name = F.when(F.col("p_size") % 5 == 0, F.initcap("p_name")).otherwise(F.col("p_name"))
    said = F.when(k == 0, F.concat_ws(" ", F.lit("[X]"), name, F.lit("[Y] ."))).when(k == 1, F.concat_ws(" ", F.lit("the"), F.lit("[X]"), name, F.lit("[Y] ."))).when(k == 2, F.concat_ws(" ", F.lit("[Y]"), name, F.lit("[X] of"))).otherwise(name)
    return B.table(s, d, "part").select(said.alias("prompt")).groupBy("prompt").agg(F.count(F.lit(1)).alias("cnt"))


def _snippets(body):
    """The SQL of filtered snippets, as the snippet queries have it, under the name found."""
    stop = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
    low = f"""low AS (SELECT pid, lower(snippet) AS snippet, direction FROM snips),
      found AS (SELECT * FROM low WHERE NOT regexp_matches(snippet, '^[!-/:-@\\[-`{{-~]') AND len(string_split(snippet, ' ')) <= 5 AND len(list_filter(string_split(snippet, ' '), lambda x: x NOT IN ({stop}))) > 0)"""
    return _after(_NAMES, f"{_SNIPPETS}, {low}", body.replace("STOP", stop))


def _counted_by(s, d, half):
    """Words of one half of the documents by source."""
    docs = B.table(s, d, "documents").where(F.col("doc_id") % 2 == half)
    words = docs.select(F.coalesce("source", F.lit("none")).alias("pid"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return words.groupBy("pid", "word").agg(F.count(F.lit(1)).alias("cnt"))


def _source_pairs(s, d):
    """Pairs of sources in order; as few as there are sources."""
    one = B.table(s, d, "documents").select(F.coalesce("source", F.lit("none")).alias("a")).distinct()
    return one.join(one.select(F.col("a").alias("b")), F.col("a") < F.col("b"))


def _with_back(s, d):
    """Triples, and those of two relations turned round under another name."""
    own = B.triples(s, d)
    return own.unionAll(own.where("r in ('P2', 'P5')").select(F.col("t").alias("h"), F.concat("r", F.lit("_back")).alias("r"), F.col("h").alias("t")))


def _first_vectors(s, d):
    """Each label's own vector: that of its smallest id."""
    return B.vectors(s, d).groupBy(F.col("pid").alias("entity")).agg(F.min_by("vec", "id").alias("vec"))


CATALOG = {
    "split_within": (lambda s, d: S.split_within(B.tree(s, d), _SHARES), _after("tree", _dealt(), "SELECT * FROM dealt WHERE parent IN (SELECT parent FROM dealt GROUP BY parent HAVING count(DISTINCT split) = 3)")),
    "split_within_known": (
        lambda s, d: S.split_within(B.tree(s, d), _SHARES, known=B.tree_nodes(s, d).where("not pid like '%|%'"), empty_splits=True),
        _after("tree", _dealt("parent NOT LIKE '%|%' AND child NOT LIKE '%|%'"), "SELECT * FROM dealt"),
    ),
    "split_within_one_by_one": (
        lambda s, d: S.split_within(B.tree(s, d), _SHARES, one_by_one=True),
        _after("tree", """own AS (SELECT parent, child, row_number() OVER (PARTITION BY parent ORDER BY md5('1|' || parent || '|' || child), child) AS nth FROM (SELECT DISTINCT parent, child FROM tree)),
          deal AS (SELECT 1 AS i, 1 AS a, 0 AS b, 0 AS c, 'train' AS split UNION ALL
            SELECT i + 1, a + CASE WHEN s = 'train' THEN 1 ELSE 0 END, b + CASE WHEN s = 'dev' THEN 1 ELSE 0 END, c + CASE WHEN s = 'test' THEN 1 ELSE 0 END, s FROM (
              SELECT *, CASE WHEN 6 * i - 10 * a >= greatest(2 * i - 10 * b, 2 * i - 10 * c) THEN 'train' WHEN 2 * i - 10 * b >= 2 * i - 10 * c THEN 'dev' ELSE 'test' END AS s FROM deal WHERE i < (SELECT max(nth) FROM own))),
          dealt AS (SELECT parent, child, split FROM own JOIN deal ON i = nth)""", "SELECT * FROM dealt WHERE parent IN (SELECT parent FROM dealt GROUP BY parent HAVING count(DISTINCT split) = 3)"),
    ),
    "split_by_tree": (
        lambda s, d: S.split_by_tree(_forest(s, d), _SHARES),
        _after("tree", _FOREST + """, tops AS (SELECT root, row_number() OVER (ORDER BY md5('1|' || root), root) AS nth, count(*) OVER () AS n FROM (SELECT DISTINCT parent AS root FROM forest WHERE parent NOT IN (SELECT child FROM forest))),
          dealt AS (SELECT root, CASE WHEN nth <= floor(n * 0.6) THEN 2 WHEN nth <= floor(n * 0.6) + floor(n * 0.2) THEN 1 ELSE 0 END AS k FROM tops),
          below AS (SELECT root, root AS pid, k FROM dealt UNION SELECT b.root, f.child, b.k FROM below b JOIN forest f ON f.parent = b.pid)""", "SELECT pid, CASE min(k) WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END AS split FROM below GROUP BY pid"),
    ),
    "within_tree_splits": (
        lambda s, d: S.single_split(S.split_within(B.tree(s, d), _SHARES).select(F.col("child").alias("pid"), "split")),
        _after("tree", _dealt(), "SELECT child AS pid, CASE WHEN bool_or(split = 'test') THEN 'test' WHEN bool_or(split = 'dev') THEN 'dev' ELSE 'train' END AS split FROM dealt WHERE parent IN (SELECT parent FROM dealt GROUP BY parent HAVING count(DISTINCT split) = 3) GROUP BY child"),
    ),
    "sibling_pairs": (
        lambda s, d: S.sibling_pairs(*_label_splits(s, d), with_train=True).withColumn("label", F.col("label").cast("long")),
        _after("vectors", _LABEL_SPLITS, """SELECT a.split, a.pid AS p1, b.pid AS p2, CAST(CASE WHEN split_part(a.pid, '_', 1) = split_part(b.pid, '_', 1) THEN 1 ELSE 0 END AS BIGINT) AS label
          FROM splits a JOIN splits b ON (a.split = b.split AND a.pid < b.pid) OR (a.split <> 'train' AND b.split = 'train')"""),
    ),
    "entailed_pairs": (
        # Parents are labels of the pairs with every relation of a split; both are relations that stay.
        lambda s, d: S.in_both(H.closure(B.tree(s, d)).select(F.col("anc").alias("p1"), F.col("des").alias("p2")).distinct(), S.split_within(B.tree(s, d), _SHARES).select(F.col("child").alias("pid"))),
        _after("tree tree_closure", _dealt() + ", kept AS (SELECT DISTINCT child AS pid FROM dealt WHERE parent IN (SELECT parent FROM dealt GROUP BY parent HAVING count(DISTINCT split) = 3))", "SELECT DISTINCT anc AS p1, des AS p2 FROM tree_closure WHERE anc IN (SELECT pid FROM kept) AND des IN (SELECT pid FROM kept)"),
    ),
    "all_of_one_root": (
        lambda s, d: S.all_of_one_root(_parts_of_labels(s, d, 5).select(F.when(F.col("id") % 3 == 0, F.substring_index("pid", "_", 1)).otherwise(F.concat(F.lit("P"), (F.col("id") % 4).cast("string"))).alias("parent"), F.col("pid").alias("child"))),
        _V("vectors", "SELECT parent, bool_and(split_part(child, '_', 1) = parent) AS split FROM (SELECT CASE WHEN id % 3 = 0 THEN pid ELSE 'P' || CAST(id % 4 AS VARCHAR) END AS parent, pid || '_' || CAST(id % 5 AS VARCHAR) AS child FROM vectors) GROUP BY parent"),
    ),
    "tfidf_fitted": (
        lambda s, d: _weighted(*_learns(s, d)).withColumn("weight", F.round("weight", 6)),
        _after("triples", _TERMS, "SELECT doc, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc)), 6) AS weight FROM (SELECT doc, term, cnt * idf AS w FROM counts JOIN idf USING (term) WHERE substr(md5(doc), 1, 1) >= 'c')"),
    ),
    "neighbour_terms": (lambda s, d: S.neighbour_terms(_dealt_samples(s, d), B.triples(s, d)), _after("triples", _TERMS, "SELECT doc, term, CAST(cnt AS BIGINT) AS cnt FROM counts")),
    "sentence_contexts": (lambda s, d: S.sentence_contexts(_spoken(s, d), 8, 300), "WITH " + _SPOKEN + " SELECT * FROM contexts"),
    "known_bags": (
        lambda s, d: _bagged(s, d).select("sample", F.col("ind").cast("long").alias("ind"), "cnt"),
        "WITH " + _SPOKEN + """, vocab AS (SELECT word, length(word) AS ind FROM contexts GROUP BY word HAVING sum(cnt) >= 5),
          samples AS (SELECT coalesce(lang, 'none') || coalesce('_' || source, '') AS pid, min(doc_id) AS sample FROM documents GROUP BY 1)
          SELECT sample, CAST(ind AS BIGINT) AS ind, CAST(cnt AS BIGINT) AS cnt FROM samples s JOIN (SELECT pid, coalesce(ind, 0) AS ind, sum(cnt) AS cnt FROM contexts LEFT JOIN vocab USING (word) GROUP BY 1, 2) c ON c.pid = split_part(s.pid, '_', 1)""",
    ),
    "write_pointwise": (
        lambda s, d: _read(readers.read_pointwise, W.pointwise_lines(_pointwise(s, d))).select(F.col("label").cast("long").alias("label"), "p1", "p2", *[F.array_join(F.transform(c, lambda o: F.concat_ws(" ", o["h"], o["t"])), " ").alias(c) for c in ("occs1", "occs2")]),
        "WITH " + _OWN + " SELECT a.k % 3 AS label, a.p AS p1, b.p AS p2, a.occs AS occs1, b.occs AS occs2 FROM own a JOIN own b ON b.k = a.k + 1",
    ),
    "write_label_occs": (
        lambda s, d: W.label_occs_lines(B.table(s, d, "customer").select(F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("label"), F.col("c_custkey").alias("ind")), _pointwise(s, d).select(F.col("p1").alias("pid"), F.col("occs1").alias("occs"))),
        "WITH " + _OWN + r" SELECT CAST(c_custkey AS VARCHAR) || chr(9) || 'P' || CAST(c_custkey AS VARCHAR) || coalesce(' ' || occs, '') AS value FROM customer LEFT JOIN (SELECT a.k, a.occs FROM own a JOIN own b ON b.k = a.k + 1) ON k = c_custkey",
    ),
    "rank_table": (
        lambda s, d: W.rank_table(_tagged(s, d).withColumn("score", F.round("score", 4)), 3, s.createDataFrame([("P1", "first"), ("P2", "second")], "pid string, name string")).select(F.col("nth").cast("long").alias("nth"), "value"),
        _after("vectors", _SCORED + """, said AS (SELECT *, CASE p1 WHEN 'P1' THEN 'first' WHEN 'P2' THEN 'second' ELSE p1 END AS q, CASE p2 WHEN 'P1' THEN 'first' WHEN 'P2' THEN 'second' ELSE p2 END AS c, CASE WHEN parent THEN 'parent' WHEN above THEN 'ancestor' ELSE '*' END AS rel FROM scored WHERE rank <= 3)""",
          """SELECT CAST(0 AS BIGINT) AS nth, 'query,pos_0,pos_1,pos_2' AS value UNION ALL SELECT row_number() OVER (ORDER BY p1), '"' || q || '",' || string_agg('"' || c || '" ' || printf('%.2f', round(score, 4)) || ' ' || rel, ',' ORDER BY rank) FROM said GROUP BY p1, q"""),
    ),
    "only_by_path": (
        lambda s, d: C.only_by_path(_prompts(s, d), 2),
        """WITH p AS (SELECT p_partkey % 4 AS k, CASE WHEN p_size % 5 = 0 THEN upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) ELSE p_name END AS n, p_size % 5 = 0 AS capital FROM part)
          SELECT CASE k WHEN 1 THEN 'the [X] ' || n || ' [Y] .' WHEN 2 THEN '[Y] ' || n || ' [X] of' ELSE n END AS prompt, count(*) AS cnt FROM p WHERE k > 0 AND NOT capital GROUP BY 1 HAVING count(*) >= 2""",
    ),
    "tokens_of": (
        lambda s, d: C.tokens_of(B.tokens(s, d), B.table(s, d, "labels").select(F.col("doc_id").alias("sid"))).groupBy("sid").agg(F.count(F.lit(1)).alias("tokens"), F.max("tok").alias("last")),
        _V("tokens", "SELECT sid, count(*) AS tokens, max(tok) AS last FROM tokens WHERE sid IN (SELECT doc_id FROM labels) GROUP BY sid"),
    ),
    "ordered_by_number": (
        lambda s, d: C.by_number(B.table(s, d, "customer").select(F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("pid")), "pid").select("pid", F.monotonically_increasing_id().alias("m")).groupBy(F.length("pid").alias("digits")).agg(F.min_by("pid", "m").alias("first"), F.max_by("pid", "m").alias("last")).withColumn("digits", F.col("digits").cast("long")),
        "SELECT length('P' || CAST(c_custkey AS VARCHAR)) AS digits, 'P' || CAST(min(c_custkey) AS VARCHAR) AS first, 'P' || CAST(max(c_custkey) AS VARCHAR) AS last FROM customer GROUP BY 1",
    ),
    "mention_numbers": (
        lambda s, d: T.numbered_mentions(B.mentions(s, d)).select("sid", F.col("start").cast("long").alias("start"), "wdid", F.col("idx").cast("long").alias("idx")),
        _V("tokens lexicon mentions", "SELECT sid, start, wdid, row_number() OVER (PARTITION BY sid ORDER BY start, end_, wdid) AS idx FROM mentions"),
    ),
    "snippet_bags": (
        lambda s, d: T.snippet_bags(T.filtered_snippets(T.snippets(*_gaps_and_lists(s, d)))),
        _snippets("SELECT pid, lower(word) AS word, CAST(sum(cnt) AS BIGINT) AS cnt FROM (SELECT pid, word, count(*) AS cnt FROM (SELECT pid, unnest(string_split(snippet, ' ')) AS word FROM (SELECT DISTINCT pid, snippet, direction FROM found)) GROUP BY 1, 2) WHERE regexp_matches(lower(word), '^[a-z0-9]+$') AND lower(word) NOT IN (STOP) GROUP BY 1, 2"),
    ),
    "words_that_differ": (
        lambda s, d: T.words_that_differ(_counted_by(s, d, 0), _counted_by(s, d, 1), _source_pairs(s, d), 10),
        r"""WITH c AS (SELECT coalesce(source, 'none') AS pid, doc_id % 2 AS half, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents), s AS (SELECT DISTINCT pid FROM c),
          g AS (SELECT a.pid AS a, b.pid AS b, half, word, sum(CASE WHEN c.pid = a.pid THEN 1 ELSE -1 END) AS gap FROM s a JOIN s b ON a.pid < b.pid JOIN c ON c.pid IN (a.pid, b.pid) GROUP BY 1, 2, 3, 4),
          k AS (SELECT *, row_number() OVER (PARTITION BY a, b, half ORDER BY abs(gap) DESC, word) AS nth FROM g)
          SELECT x.a, x.b, x.word, CAST(x.gap AS BIGINT) AS train_gap, CAST(y.gap AS BIGINT) AS test_gap FROM k x JOIN k y USING (a, b, word) WHERE x.half = 0 AND y.half = 1 AND x.nth <= 10 AND y.nth <= 10""",
    ),
    "parallel_by_sample": (
        lambda s, d: R.parallel_by_sample(_dealt_samples(s, d), _with_back(s, d)),
        _after("triples", _TERMS + ", back AS (SELECT DISTINCT t AS h, h AS t, r || '_back' AS r FROM triples WHERE r IN ('P2', 'P5'))", "SELECT o.doc AS sample, x.r, count(*) AS cnt FROM o JOIN (SELECT h, t, r FROM back UNION SELECT h, t, r FROM triples) x ON x.h = o.t AND x.t = o.h WHERE x.r <> o.pid GROUP BY 1, 2 HAVING count(*) >= 3"),
    ),
    "hierarchy_statistics": (
        lambda s, d: H.statistics(B.tree(s, d)),
        _V("tree", "SELECT count(*) AS parents, CAST(sum(n) AS BIGINT) AS children, CAST(sum(n * (n - 1)) AS BIGINT) AS sibling_pairs FROM (SELECT parent, count(DISTINCT child) AS n FROM tree GROUP BY parent)"),
    ),
    "own_vector_scores": (
        lambda s, d: V.mean_scores(V.own_vectors(B.vectors(s, d).select("pid"), _first_vectors(s, d))).select("p1", "p2", F.round("cosine", 6).alias("cosine")),
        _V("vectors", "SELECT a.pid AS p1, b.pid AS p2, round(list_cosine_similarity(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])), 6) AS cosine FROM (SELECT pid, arg_min(vec, id) AS v FROM vectors GROUP BY pid) a JOIN (SELECT pid, arg_min(vec, id) AS v FROM vectors GROUP BY pid) b ON a.pid <> b.pid"),
    ),
    "nearest_named": (
        lambda s, d: V.nearest_relations(_parts_of_labels(s, d, 4).where("not pid like '%_3'"), 3).select("p1", F.col("rank").cast("long").alias("rank"), "p2"),
        _after("vectors", """rel AS (SELECT pid || '_' || CAST(id % 4 AS VARCHAR) AS pid, vec FROM vectors WHERE id % 4 <> 3), long AS (SELECT pid, unnest(range(len(vec))) AS dim, CAST(unnest(vec) AS DOUBLE) AS x FROM rel),
          means AS (SELECT pid, list(x ORDER BY dim) AS v FROM (SELECT pid, dim, avg(x) AS x FROM long GROUP BY 1, 2) GROUP BY pid)""", """SELECT p1, rank, p2 FROM (SELECT a.pid AS p1, b.pid AS p2, row_number() OVER (PARTITION BY a.pid ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.pid) AS rank FROM means a JOIN means b ON a.pid <> b.pid) WHERE rank <= 3"""),
    ),
}
