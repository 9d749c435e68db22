"""Queries that complete hierarchies, match dictionaries, divide relations and encode samples, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import dictionary as D
from strandline.operators import encoders as N
from strandline.operators import greedy as G
from strandline.operators import hierarchy as H
from strandline.operators import relations as R
from strandline.operators import text as T
from strandline.operators import vectors as V
from strandline.operators.loops import checkpointed
from strandline.plans.relation_queries import _after
from strandline.sources import bindings as B

_V = B.with_views
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)

# --- hierarchies --------------------------------------------------------------------------------------------------

#: Levels of the hierarchy of goods; the SQL has one step each.
_LEVELS = range(1, 4)
_HEIGHT = "height AS (SELECT anc AS pid, max(depth) AS height FROM tree_closure GROUP BY anc)"


def _drawn(seed: str, pid: str, below: str) -> str:
    return f"substr(md5('{seed}|' || {pid} || '|' || s.h || '|' || s.t), 1, 8) < '{below}'"


def _bottom_up(own: str) -> str:
    steps = [_HEIGHT, "s0 AS (SELECT pid, h, t FROM tree_occs WHERE pid NOT IN (SELECT pid FROM height))"]
    for i in _LEVELS:
        at = f"tree e JOIN height x ON x.pid = e.parent AND x.height = {i}"
        steps += [
            f"t{i} AS (SELECT DISTINCT e.parent AS pid, s.h, s.t FROM {at} JOIN s{i - 1} s ON s.pid = e.child WHERE {_drawn('third', 'e.parent', '55555555')})",
            f"s{i} AS ((SELECT * FROM s{i - 1} EXCEPT SELECT e.child, t.h, t.t FROM {at} JOIN t{i} t ON t.pid = e.parent) UNION SELECT * FROM t{i} {own.format(i)})",
        ]
    return ", ".join(steps)


def _top_down() -> str:
    steps = [
        "held AS (SELECT pid, h, t FROM tree_occs UNION SELECT anc, h, t FROM tree_occs JOIN tree_closure ON des = pid)",
        "deep AS (SELECT des AS pid, max(depth) AS depth FROM tree_closure GROUP BY des)",
        "above AS (SELECT parent, child FROM tree WHERE parent IN (SELECT pid FROM held))",
        "needed AS (SELECT child AS pid, count(*) AS needed FROM above GROUP BY child)",
        "here0 AS (SELECT * FROM held WHERE pid NOT IN (SELECT pid FROM deep))",
    ]
    for i in (0, *_LEVELS):
        if i:
            steps.append(
                f"""here{i} AS (SELECT h.pid, h.h, h.t FROM held h JOIN deep USING (pid) LEFT JOIN needed n USING (pid)
                LEFT JOIN (SELECT a.child AS pid, p.h, p.t, count(*) AS n FROM above a JOIN passed{i - 1} p ON p.pid = a.parent GROUP BY 1, 2, 3) w ON w.pid = h.pid AND w.h = h.h AND w.t = h.t
                WHERE depth = {i} AND (n.needed IS NULL OR w.n = n.needed))"""
            )
        before = f"SELECT * FROM kept{i - 1} UNION ALL" if i else ""
        steps.append(f"marked{i} AS (SELECT s.*, s.pid NOT IN (SELECT parent FROM tree) OR {_drawn('half', 's.pid', '80000000')} AS keeps FROM here{i} s)")
        steps.append(f"kept{i} AS ({before} SELECT pid, h, t FROM marked{i} WHERE keeps)")
        steps.append(f"passed{i} AS ({before.replace('kept', 'passed')} SELECT pid, h, t FROM marked{i} WHERE NOT keeps)")
    return ", ".join(steps)


# --- dictionaries -------------------------------------------------------------------------------------------------

_WORD = r"[^\x20\x09-\x0D]+"


def _lists(s, d):
    """Words of every whole document."""
    return B.table(s, d, "documents").select(F.col("doc_id").alias("sid"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_WORD), F.lit(0)).alias("toks"))


_LISTS = f"lists AS (SELECT doc_id AS sid, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS toks FROM documents)"


def _names(s, d):
    """A benchmark item's names: its first one to eight words, and one word alone, which several items share."""
    w = F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))
    item = B.table(s, d, "benchmark").select(F.concat(F.lit("B"), F.col("item_id").cast("string")).alias("id"), F.col("item_id").alias("i"), w.alias("w"))
    long = item.select("id", F.array_join(F.slice("w", F.lit(1), (1 + F.col("i") % 8).cast("int")), " ").alias("name"))
    return long.unionAll(item.select("id", F.get("w", (2 + F.col("i") % 5).cast("int"))))


_NAMES = f"""items AS (SELECT 'B' || CAST(item_id AS VARCHAR) AS id, item_id AS i, regexp_extract_all(text, '{_WORD}') AS w FROM benchmark),
  names AS (SELECT id, array_to_string(w[1 : 1 + i % 8], ' ') AS name FROM items UNION ALL SELECT id, w[3 + i % 5] FROM items),
  surfaces AS (SELECT lower(name) AS surface, list_sort(list(DISTINCT id))[1:3] AS ids FROM names WHERE name <> '' AND lower(name) NOT IN ({_STOP}) GROUP BY 1)"""
_PLACES = f"""{_LISTS}, {_NAMES}, grams AS (SELECT sid, n, unnest(range(1, len(toks) - n + 2)) - 1 AS start, unnest(list_transform(range(1, len(toks) - n + 2), lambda i: lower(array_to_string(toks[i : i + n - 1], ' ')))) AS surface
    FROM lists, range(1, 9) AS l(n) WHERE len(toks) >= n),
  places AS (SELECT sid, start, start + n AS stop, surface, array_to_string(ids, ',') AS ids FROM grams JOIN surfaces USING (surface))"""


def _surfaces(s, d):
    return D.inverted_names(_names(s, d), most_ids=3)


def _places(s, d):
    return D.dictionary_places(_lists(s, d), _surfaces(s, d))


def _shown(places):
    return places.select("sid", "start", F.col("end").alias("stop"), "surface", F.array_join("ids", ",").alias("ids"))


def _sentences(lists):
    """Sentences end with words that end in a mark."""
    tokens = lists.select("sid", F.posexplode("toks").alias("pos", "tok")).select("sid", F.col("pos").cast("long").alias("pos"), F.when(F.col("tok").rlike("[.!?]$"), ".").otherwise("x").alias("tok"))
    return T.sentences(tokens)


def _unfolded(s, d):
    """Each document's topic is the item whose long name comes first; neighbours are items with near numbers, or the same rest by five. With places by surface, and all ids of each."""
    borne = checkpointed(D.surfaces_of(_names(s, d).where(F.size(F.split("name", " ")) >= 2)))
    # However many ids share a surface, its places go with the smallest alone, which is the topic if any of them is.
    surfaces = borne.groupBy("surface").agg(F.first("n").alias("n"), F.first("first").alias("first"), F.array(F.min("id")).alias("ids"))
    # Texts are matched once, for the topics and for what they unfold to.
    places = checkpointed(D.dictionary_places(_lists(s, d), surfaces).select("sid", "surface", F.get("ids", F.lit(0)).alias("id"), "start", "end"))
    topics = places.groupBy("sid").agg(F.min(F.struct("start", "id")).alias("x")).select("sid", "x.id")
    item = B.table(s, d, "benchmark").select("item_id")
    step = F.explode(F.array(F.col("item_id") + 1, F.col("item_id") - 1, F.col("item_id") + 5, F.col("item_id") - 5))
    links = item.select("item_id", step.alias("j")).join(item.select(F.col("item_id").alias("j")), "j")
    name = lambda c: F.concat(F.lit("B"), F.col(c).cast("string"))
    return topics, links.select(name("item_id").alias("id"), name("j").alias("other")), places.select("sid", "surface", "start", "end"), borne.select("id", "surface")


def _topics(s, d):
    """The same with places of every id: (sid, id, start, end)."""
    topics, links, places, borne = _unfolded(s, d)
    return topics, links, places.join(borne, "surface").select("sid", "id", "start", "end")


# --- relations by their vectors -----------------------------------------------------------------------------------


def _parts_of_labels(s, d, parts):
    """Vectors under their label, divided by number: (id, pid, vec)."""
    return B.vectors(s, d).withColumn("pid", F.concat_ws("_", "pid", (F.col("id") % parts).cast("string")))


def _siblings(rows):
    """Relations with the same label, both ways."""
    one = rows.select("pid").distinct().withColumn("label", F.substring_index("pid", "_", 1))
    return one.select("label", F.col("pid").alias("a")).join(one.select("label", F.col("pid").alias("b")), "label").where("a <> b").select("a", "b")


def _cosines(s, d):
    rows = _parts_of_labels(s, d, 30)
    return checkpointed(V.mean_scores(rows).select("p1", "p2", F.col("cosine").alias("score"))), _siblings(rows)


def _means(source: str) -> str:
    return f"""long AS (SELECT pid, unnest(range(len(vec))) AS dim, CAST(unnest(vec) AS DOUBLE) AS x FROM {source}),
  means AS (SELECT pid, list(x ORDER BY dim) AS v FROM (SELECT pid, dim, avg(x) AS x FROM long GROUP BY 1, 2) GROUP BY pid)"""


_SCORES = f"""rel AS (SELECT pid || '_' || CAST(id % 30 AS VARCHAR) AS pid, vec FROM vectors), {_means('rel')},
  scores AS (SELECT a.pid AS p1, b.pid AS p2, list_cosine_similarity(a.v, b.v) AS score FROM means a JOIN means b ON a.pid <> b.pid),
  ranked AS (SELECT *, split_part(p1, '_', 1) = split_part(p2, '_', 1) AS sibling, row_number() OVER (PARTITION BY p1 ORDER BY score DESC, p2) AS nth FROM scores)"""
_SPLIT = """trained AS (SELECT DISTINCT p2 AS pid FROM ranked WHERE sibling AND p1 IN (SELECT pid FROM test) AND p2 NOT IN (SELECT pid FROM test)),
  split AS (SELECT pid, 'test' AS split FROM test UNION ALL SELECT pid, 'train' FROM trained)"""


def _hierarchy_of_labels(rows):
    """A root over labels over their parts, and a second root over the even labels; with the groups of a label and its parts."""
    pids = rows.select("pid").distinct()
    label = F.substring_index("pid", "_", 1)
    below = pids.select(label.alias("parent"), F.col("pid").alias("child"))
    tops = pids.select(label.alias("child")).distinct()
    edges = below.unionAll(tops.select(F.lit("ALL"), "child")).unionAll(tops.where("cast(substring(child, 2) as int) % 2 = 0").select(F.lit("EVEN"), "child"))
    return edges, pids.select(label.alias("grp"), "pid").unionAll(tops.select(F.col("child"), F.col("child")))


_METHODS = ("min", "middle", "top_2", "random")


def _hard_split(s, d):
    rows = _parts_of_labels(s, d, 7)
    edges, groups = _hierarchy_of_labels(rows)
    means = checkpointed(V.mean_vectors(rows.unionByName(B.vectors(s, d))))
    out = None
    for method in _METHODS:
        hard = V.central_member(means, groups, method).select(F.col("grp").alias("a"), F.col("pid").alias("b"))
        one = V.swapped(edges, hard).select(F.lit(method).alias("method"), "parent", "child")
        out = one if out is None else out.unionAll(one)
    return out


_HARD = f"""rel AS (SELECT pid || '_' || CAST(id % 7 AS VARCHAR) AS pid, vec FROM vectors UNION ALL SELECT pid, vec FROM vectors), {_means('rel')},
  grp AS (SELECT split_part(pid, '_', 1) AS grp, pid, v FROM means),
  central AS (SELECT a.grp, a.pid, avg(list_cosine_similarity(a.v, b.v)) AS central FROM grp a JOIN grp b USING (grp) GROUP BY 1, 2),
  placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY central, pid) AS nth, count(*) OVER (PARTITION BY grp) AS n, row_number() OVER (PARTITION BY grp ORDER BY md5('1|' || grp || '|' || pid), pid) AS drawn FROM central),
  hard AS (SELECT 'min' AS method, grp, pid FROM placed WHERE nth = 1 UNION ALL SELECT 'middle', grp, pid FROM placed WHERE nth = n // 2 + 1
    UNION ALL SELECT 'top_2', grp, pid FROM placed WHERE nth = least(3, n) UNION ALL SELECT 'random', grp, pid FROM placed WHERE drawn = 1),
  new AS (SELECT method, grp AS was, pid AS now FROM hard WHERE grp <> pid UNION ALL SELECT method, pid, grp FROM hard WHERE grp <> pid),
  edges AS (SELECT grp AS parent, pid AS child FROM grp WHERE grp <> pid UNION ALL SELECT DISTINCT 'ALL', grp FROM grp UNION ALL SELECT DISTINCT 'EVEN', grp FROM grp WHERE CAST(substr(grp, 2) AS INTEGER) % 2 = 0)"""


def _joined_vectors(s, d):
    """Occurrences as the vectors of an entity and of the next one, end to end."""
    own = B.vectors(s, d)
    return own.join(own.select((F.col("id") - 1).alias("id"), F.col("vec").alias("tail")), "id").select("pid", F.concat("vec", "tail").alias("vec"))


# --- samples as graphs --------------------------------------------------------------------------------------------

_IN_SAMPLE, _IN_BATCH = 10, 4


def _dealt(s, d):
    """Occurrences of every relation in samples of ten, four samples a batch: (sample, batch, number, pid, pos, h, t)."""
    pairs = R.entity_pairs(B.triples(s, d)).select(F.col("r").alias("pid"), "h", "t")
    n = F.col("nth") - 1
    number = F.floor(n / _IN_SAMPLE)
    # Counts with repeats are no fewer.
    numbered = R.numbered(pairs, B.triples(s, d).groupBy(F.col("r").alias("pid")).agg(F.count(F.lit(1)).alias("n")), ["h", "t"], "nth", distinct=True)
    return numbered.select(F.concat_ws(":", "pid", number.cast("string")).alias("sample"), F.concat_ws("/", "pid", F.floor(number / _IN_BATCH).cast("string")).alias("batch"), number.alias("number"), "pid", (n % _IN_SAMPLE).alias("pos"), "h", "t")


def _samples(s, d):
    """Occurrences by sample, and the samples by batch."""
    occs = checkpointed(_dealt(s, d))
    return occs.select("sample", "pid", "pos", "h", "t"), occs.select("sample", "pid", "number", "batch").distinct()


def _packed(kind):
    def query(s, d):
        return N.packed_samples(_dealt(s, d), B.triples(s, d), kind).withColumn("src", F.col("src").cast("long")).withColumn("dst", F.col("dst").cast("long"))

    return query


_OWN_EDGES = {
    "one": [("'one'", "h", "pid"), ("'one'", "pid", "t")],
    "only_property": [],
    "bow": [("'head'", "h", "pid"), ("'tail'", "t", "pid")],
    "property": [("'<AGG>'", "h", "'<AGG>'"), ("'<AGG>'", "t", "'<AGG>'"), ("pid", "h", "t")],
}
_SIDE_EDGES = {
    "one": ([("'one'", "e", "r"), ("'one'", "r", "o")], "true"),
    "only_property": ([("side", "r", "pid")], "r <> pid"),
    "bow": ([("side || '_other'", "r", "pid"), ("side || '_other'", "o", "pid")], "r <> pid"),
    "property": ([("r", "e", "o")], "true"),
}


def _graph_sql(kind: str) -> str:
    parts = [f"SELECT sample, pid, [pos, 0, 0, {i}] AS place, {k} AS kind, {a} AS src, {b} AS dst FROM o" for i, (k, a, b) in enumerate(_OWN_EDGES[kind])]
    edges, gives = _SIDE_EDGES[kind]
    parts += [f"SELECT sample, pid, [pos, n, nth, {i}] AS place, {k} AS kind, {a} AS src, {b} AS dst FROM met WHERE {gives}" for i, (k, a, b) in enumerate(edges)]
    first = "'<AGG>'" if kind == "property" else "pid"
    return f"""occ AS (SELECT r AS pid, h, t, row_number() OVER (PARTITION BY r ORDER BY h, t) - 1 AS n FROM (SELECT DISTINCT h, r, t FROM triples WHERE regexp_matches(h, '^Q[0-9]+$') AND regexp_matches(t, '^Q[0-9]+$'))),
      o AS (SELECT pid || ':' || CAST(n // {_IN_SAMPLE} AS VARCHAR) AS sample, pid, n % {_IN_SAMPLE} AS pos, h, t, n // {_IN_SAMPLE} AS number FROM occ),
      around AS (SELECT h AS e, r, t AS o, row_number() OVER (PARTITION BY h ORDER BY r, t) AS nth FROM (SELECT DISTINCT h, r, t FROM triples)),
      met AS (SELECT x.sample, x.pid, x.pos, x.n, x.side, a.* FROM (SELECT *, 1 AS n, 'head' AS side, h AS x FROM o UNION ALL SELECT *, 2, 'tail', t FROM o) x JOIN around a ON a.e = x.x),
      edges AS ({' UNION ALL '.join(parts)}),
      seen AS (SELECT sample, src AS id, list_append(place, 0) AS seen_at FROM edges UNION ALL SELECT sample, dst, list_append(place, 1) FROM edges UNION ALL SELECT DISTINCT sample, {first}, [-1, -1, -1, -1, 0] FROM o),
      nodes AS (SELECT sample, id, row_number() OVER (PARTITION BY sample ORDER BY min(seen_at), id) - 1 AS ind FROM seen GROUP BY sample, id),
      samples AS (SELECT DISTINCT sample, pid || '/' || CAST(number // {_IN_BATCH} AS VARCHAR) AS batch, number FROM o),
      offsets AS (SELECT sample, batch, size, CAST(coalesce(sum(size) OVER (PARTITION BY batch ORDER BY number, sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
        FROM samples JOIN (SELECT sample, count(*) AS size FROM nodes GROUP BY sample) USING (sample))"""


_PACKED = """SELECT f.batch, e.kind, a.ind + f."offset" AS src, b.ind + f."offset" AS dst FROM (SELECT DISTINCT sample, kind, src, dst FROM edges) e
  JOIN nodes a ON a.sample = e.sample AND a.id = e.src JOIN nodes b ON b.sample = e.sample AND b.id = e.dst JOIN offsets f ON f.sample = e.sample"""


def _train_tokens(s, d, train):
    learns = F.substring(F.md5(F.col("sid").cast("string")), 1, 1) < "c"
    return B.tokens(s, d).where(learns if train else ~learns)


_TOKENS_OF = """train AS (SELECT * FROM tokens WHERE substr(md5(CAST(sid AS VARCHAR)), 1, 1) < 'c'), dev AS (SELECT * FROM tokens WHERE NOT substr(md5(CAST(sid AS VARCHAR)), 1, 1) < 'c'),
  vocab AS (SELECT '<PAD>' AS tok, 0 AS ind UNION ALL SELECT '<UNK>', 1 UNION ALL SELECT tok, row_number() OVER (ORDER BY min((sid, pos))) + 1 FROM train GROUP BY tok)"""


CATALOG = {
    "complete_bottom_up": (lambda s, d: H.completed_bottom_up(B.tree_occs(s, d), B.tree(s, d)), _after("tree tree_closure tree_occs", _bottom_up(""), f"SELECT * FROM s{max(_LEVELS)}")),
    "complete_bottom_up_with_own": (
        lambda s, d: H.completed_bottom_up(B.tree_occs(s, d), B.tree(s, d), with_own=True),
        _after("tree tree_closure tree_occs", _bottom_up("UNION SELECT o.pid, h, t FROM tree_occs o JOIN height x ON x.pid = o.pid AND x.height = {0}"), f"SELECT * FROM s{max(_LEVELS)}"),
    ),
    "complete_top_down": (lambda s, d: H.completed_top_down(B.tree_occs(s, d), B.tree(s, d)), _after("tree tree_closure tree_occs", _top_down(), f"SELECT * FROM kept{max(_LEVELS)}")),
    "dictionary_places": (lambda s, d: _shown(_places(s, d)), "WITH " + _PLACES + " SELECT * FROM places"),
    "dictionary_longest": (
        lambda s, d: _shown(D.longest_leftmost(_places(s, d))),
        "WITH RECURSIVE " + _PLACES + """, best AS (SELECT * FROM places QUALIFY row_number() OVER (PARTITION BY sid, start ORDER BY stop DESC) = 1),
          nxt AS (SELECT sid, own AS start, following FROM (SELECT sid, own, min(start) OVER (PARTITION BY sid ORDER BY pos RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS following
            FROM (SELECT sid, start AS pos, start, NULL AS own FROM best UNION ALL SELECT sid, stop, NULL, start FROM best)) WHERE own IS NOT NULL),
          walk AS (SELECT sid, min(start) AS start FROM best GROUP BY sid UNION ALL SELECT n.sid, n.following FROM walk w JOIN nxt n ON n.sid = w.sid AND n.start = w.start WHERE n.following IS NOT NULL)
          SELECT b.* FROM best b JOIN walk w ON w.sid = b.sid AND w.start = b.start""",
    ),
    "dictionary_not_found": (lambda s, d: D.not_found(_surfaces(s, d), _places(s, d)).select("surface", F.array_join("ids", ",").alias("ids")), "WITH " + _PLACES + " SELECT surface, array_to_string(ids, ',') AS ids FROM surfaces WHERE surface NOT IN (SELECT surface FROM places)"),
    "dictionary_cased": (
        lambda s, d: D.dictionary_places(_lists(s, d), D.inverted_names(_names(s, d), lower=False), lower=False).groupBy("surface").agg(F.count(F.lit(1)).alias("cnt"), F.countDistinct("sid").alias("docs")),
        "WITH " + _PLACES.replace("lower(array_to_string(toks[i : i + n - 1], ' '))", "array_to_string(toks[i : i + n - 1], ' ')").replace("SELECT lower(name) AS surface", "SELECT name AS surface")
        + " SELECT surface, count(*) AS cnt, count(DISTINCT sid) AS docs FROM places GROUP BY surface",
    ),
    "dictionary_coverage": (
        lambda s, d: D.covered_share(_lists(s, d), D.longest_leftmost(_places(s, d))),
        "WITH RECURSIVE " + _PLACES + f""", best AS (SELECT * FROM places QUALIFY row_number() OVER (PARTITION BY sid, start ORDER BY stop DESC) = 1),
          nxt AS (SELECT sid, own AS start, following FROM (SELECT sid, own, min(start) OVER (PARTITION BY sid ORDER BY pos RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS following
            FROM (SELECT sid, start AS pos, start, NULL AS own FROM best UNION ALL SELECT sid, stop, NULL, start FROM best)) WHERE own IS NOT NULL),
          walk AS (SELECT sid, min(start) AS start FROM best GROUP BY sid UNION ALL SELECT n.sid, n.following FROM walk w JOIN nxt n ON n.sid = w.sid AND n.start = w.start WHERE n.following IS NOT NULL),
          inside AS (SELECT b.sid, unnest(range(b.start, b.stop)) AS pos FROM best b JOIN walk w ON w.sid = b.sid AND w.start = b.start),
          tok AS (SELECT sid, unnest(range(len(toks))) AS pos, lower(unnest(toks)) AS tok FROM lists),
          met AS (SELECT t.sid, count(*) AS tokens, count(i.pos) AS covered FROM tok t LEFT JOIN inside i ON i.sid = t.sid AND i.pos = t.pos WHERE tok NOT IN ({_STOP}) GROUP BY t.sid)
          SELECT l.sid, coalesce(tokens, 0) AS tokens, coalesce(covered, 0) AS covered FROM lists l LEFT JOIN met m ON m.sid = l.sid""",
    ),
    "name_sentences": (
        lambda s, d: D.first_sentences(_places(s, d), _sentences(_lists(s, d)), 20),
        "WITH " + _PLACES + """, tok AS (SELECT sid, unnest(range(len(toks))) AS pos, unnest(toks) AS tok FROM lists),
          numbered AS (SELECT sid, pos, coalesce(sum(CASE WHEN regexp_matches(tok, '[.!?]$') THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent FROM tok),
          met AS (SELECT DISTINCT unnest(string_split(p.ids, ',')) AS id, p.sid, CAST(n.sent AS BIGINT) AS sent FROM places p JOIN numbered n ON n.sid = p.sid AND n.pos = p.start)
          SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY id ORDER BY sid, sent) <= 20""",
    ),
    "easy_siblings": (
        lambda s, d: G.with_dev_half(G.easy_siblings(*_cosines(s, d))),
        # The pass itself, pair by pair, with what is in test and train so far.
        _after("vectors", _SCORES + """, easy AS (SELECT p1, p2, row_number() OVER (ORDER BY score DESC, p1) AS k FROM ranked WHERE nth = 1 AND sibling),
          pass AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS test, CAST([] AS VARCHAR[]) AS train UNION ALL
            SELECT e.k, CASE WHEN list_contains(p.train, p1) OR list_contains(p.test, p2) THEN p.test ELSE list_append(p.test, p1) END,
              CASE WHEN list_contains(p.train, p1) OR list_contains(p.test, p2) THEN p.train ELSE list_append(p.train, p2) END FROM pass p JOIN easy e ON e.k = p.k + 1),
          test AS (SELECT unnest(test) AS pid FROM pass WHERE k = (SELECT max(k) FROM pass)), """ + _SPLIT, """SELECT pid, CASE WHEN split = 'test' AND row_number() OVER (PARTITION BY split ORDER BY md5('1:' || pid), pid) <= count(*) OVER (PARTITION BY split) // 2 THEN 'dev' ELSE split END AS split FROM split"""),
    ),
    "hard_siblings": (
        lambda s, d: G.hard_siblings(*_cosines(s, d), nearest=3),
        _after("vectors", _SCORES + ", test AS (SELECT p1 AS pid FROM ranked GROUP BY p1 HAVING bool_or(sibling) AND NOT bool_or(sibling AND nth <= 3)), " + _SPLIT, "SELECT * FROM split"),
    ),
    "hard_split": (_hard_split, _after("vectors", _HARD, """SELECT m.method, coalesce(a.now, parent) AS parent, coalesce(b.now, child) AS child FROM edges CROSS JOIN (SELECT DISTINCT method FROM hard) m
      LEFT JOIN new a ON a.method = m.method AND a.was = parent LEFT JOIN new b ON b.method = m.method AND b.was = child""")),
    "covariances": (
        lambda s, d: V.covariances(_joined_vectors(s, d)).select("pid", "n", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("mean_i", 6).alias("mean_i"), F.round("covariance", 6).alias("covariance")),
        _after("vectors", """joined AS (SELECT a.pid, list_concat(a.vec, b.vec) AS vec FROM vectors a JOIN vectors b ON b.id = a.id + 1), numbered AS (SELECT row_number() OVER () AS k, * FROM joined),
          long AS (SELECT k, pid, unnest(range(len(vec))) AS i, CAST(unnest(vec) AS DOUBLE) AS x FROM numbered)""",
          "SELECT a.pid, count(*) AS n, a.i, b.i AS j, round(avg(a.x), 6) AS mean_i, round(covar_samp(a.x, b.x), 6) AS covariance FROM long a JOIN long b ON a.k = b.k GROUP BY a.pid, a.i, b.i"),
    ),
    "graph_one": (_packed("one"), _after("triples", _graph_sql("one"), _PACKED)),
    "graph_only_property": (_packed("only_property"), _after("triples", _graph_sql("only_property"), _PACKED)),
    "graph_bow": (_packed("bow"), _after("triples", _graph_sql("bow"), _PACKED)),
    "graph_property": (_packed("property"), _after("triples", _graph_sql("property"), _PACKED)),
    "graph_offsets": (
        lambda s, d: N.sample_offsets(_dealt(s, d), B.triples(s, d), "bow").select("sample", "batch", F.col("size").cast("long").alias("size"), F.col("offset").cast("long").alias("before")),
        _after("triples", _graph_sql("bow"), 'SELECT sample, batch, size, "offset" AS before FROM offsets'),
    ),
    "vocabulary": (lambda s, d: N.vocabulary(_train_tokens(s, d, True)), _after("tokens", _TOKENS_OF, "SELECT tok, CAST(ind AS BIGINT) AS ind FROM vocab")),
    "encoded_dev": (
        lambda s, d: N.encoded_tokens(_train_tokens(s, d, False), checkpointed(N.vocabulary(_train_tokens(s, d, True)))).groupBy("sid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ind"))), lambda x: x["ind"].cast("string")), " ").alias("ids")),
        _after("tokens", _TOKENS_OF, "SELECT sid, string_agg(CAST(coalesce(v.ind, 1) AS VARCHAR), ' ' ORDER BY pos) AS ids FROM dev LEFT JOIN vocab v USING (tok) GROUP BY sid"),
    ),
    "bags_dev": (
        lambda s, d: N.encoded_tokens(_train_tokens(s, d, False), checkpointed(N.vocabulary(_train_tokens(s, d, True))), unknown=None).groupBy("sid", "ind").agg(F.count(F.lit(1)).alias("cnt")),
        _after("tokens", _TOKENS_OF, "SELECT sid, CAST(ind AS BIGINT) AS ind, count(*) AS cnt FROM dev JOIN vocab USING (tok) GROUP BY 1, 2"),
    ),
    # A loop with a state an article: no SQL, held against a plain loop in the tests.
    "topic_graphs": (lambda s, d: D.topic_graphs(*_unfolded(s, d)), None),
}
