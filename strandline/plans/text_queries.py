"""Queries on annotated text, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import text as T
from strandline.operators.graph import numbered_by_count
from strandline.plans.relation_queries import _after
from strandline.sources import bindings as B

_V = B.with_views
_NAMES = "tokens lexicon mentions pair_relations"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _gaps(s, d):
    return _gaps_and_lists(s, d)[0]


def _gaps_and_lists(s, d):
    said = B.Annotated(s, d)
    return T.forward_pairs(said.mentions, said.relations), said.lists


def _in_sentences(s, d):
    said = B.Annotated(s, d)
    return said.mentions, said.tokens, said.relations


def _matched(s, d):
    """Words of the lexicon and two phrases in all tokens."""
    said = B.Annotated(s, d)
    phrases = s.createDataFrame([("of the", "X1"), ("in the", "X2")], "surface string, wdid string")
    return said.tokens, said.lexicon.select(F.col("word").alias("surface"), "wdid").unionAll(phrases)


_GAPS = """m AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY start, end_, wdid) AS idx FROM mentions),
  near AS (SELECT a.sid, a.wdid AS a, b.wdid AS b, least(a.end_, b.end_) AS start, greatest(a.start, b.start) AS end_ FROM m a JOIN m b ON a.sid = b.sid AND b.idx BETWEEN a.idx + 1 AND a.idx + 5),
  rel AS (SELECT h, t, max(pid) AS pid FROM pair_relations GROUP BY h, t),
  gaps AS (SELECT DISTINCT sid, pid, start, end_, direction FROM (
    SELECT sid, a AS h, b AS t, start, end_, 1 AS direction FROM near UNION ALL SELECT sid, b, a, start, end_, -1 FROM near) g JOIN rel USING (h, t) WHERE end_ > start AND end_ - start <= 10)"""
_SNIPPETS = _GAPS + """, said AS (SELECT g.sid, g.pid, g.start, g.end_, g.direction, string_agg(k.tok, ' ' ORDER BY k.pos) AS snippet FROM gaps g JOIN tokens k ON k.sid = g.sid AND k.pos >= g.start AND k.pos < g.end_ GROUP BY 1, 2, 3, 4, 5),
  snips AS (SELECT pid, snippet, direction, count(*) AS cnt FROM said GROUP BY 1, 2, 3)"""
_WORDS = _GAPS + ", words AS (SELECT g.pid, k.tok AS word, count(*) AS cnt FROM gaps g JOIN tokens k ON k.sid = g.sid AND k.pos >= g.start AND k.pos < g.end_ GROUP BY 1, 2)"
_BAG = _WORDS + f", bag AS (SELECT pid, word, cnt FROM words WHERE regexp_matches(word, '^[A-Za-z0-9]+$') AND word NOT IN ({_STOP}))"


_SENTS = """sents AS (SELECT sid, sent, min(pos) AS start, max(pos) + 1 AS end_ FROM (SELECT *, coalesce(sum(CASE WHEN tok IN ('.', '!', '?') THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent FROM tokens) GROUP BY 1, 2)"""


def _categories(s, d):
    """Parts by brand and by type."""
    part = B.table(s, d, "part")
    return part.select(F.col("p_brand").alias("cat"), F.col("p_partkey").alias("entity")).unionAll(part.select("p_type", "p_partkey"))


def _paths(s, d):
    """Paths of three entries made of line items."""
    item = B.table(s, d, "lineitem")
    return item.select(F.col("l_returnflag").alias("pid"), F.array("l_linestatus", F.concat(F.lit("W"), F.col("l_linenumber").cast("string")), F.lit("dep")).alias("path"))


def _bag(s, d):
    return T.filtered_words(T.context_words(*_gaps_and_lists(s, d)))


CATALOG = {
    "sentence_bounds": (
        lambda s, d: T.sentences(B.tokens(s, d)).withColumns({c: F.col(c).cast("long") for c in ("start", "end", "sent")}),
        _V("tokens", """SELECT sid, CAST(sent AS BIGINT) AS sent, min(pos) AS start, max(pos) + 1 AS "end" FROM (SELECT *, coalesce(sum(CASE WHEN tok IN ('.', '!', '?') THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent FROM tokens) GROUP BY 1, 2"""),
    ),
    "mention_popularity": (lambda s, d: T.document_mentions(B.mentions(s, d)), _V("tokens lexicon mentions", "SELECT wdid, count(DISTINCT sid) AS docs, count(*) AS cnt, min(sid) AS first_sid FROM mentions GROUP BY wdid")),
    "mention_pairs_forward": (lambda s, d: _gaps(s, d).withColumns({c: F.col(c).cast("long") for c in ("start", "end", "direction")}), _after(_NAMES, _GAPS, 'SELECT sid, pid, start, end_ AS "end", CAST(direction AS BIGINT) AS direction FROM gaps')),
    "gap_snippets": (lambda s, d: T.snippets(*_gaps_and_lists(s, d)).withColumn("direction", F.col("direction").cast("long")), _after(_NAMES, _SNIPPETS, "SELECT pid, snippet, CAST(direction AS BIGINT) AS direction, cnt FROM snips")),
    "snippet_filter": (
        lambda s, d: T.filtered_snippets(T.snippets(*_gaps_and_lists(s, d))).withColumn("direction", F.col("direction").cast("long")),
        _after(_NAMES, _SNIPPETS, f"""SELECT pid, lower(snippet) AS snippet, CAST(direction AS BIGINT) AS direction, CAST(sum(cnt) AS BIGINT) AS cnt FROM snips
          WHERE NOT regexp_matches(lower(snippet), '{T.PUNCTUATION}') AND len(string_split(snippet, ' ')) <= 5 AND len(list_filter(string_split(lower(snippet), ' '), lambda x: x NOT IN ({_STOP}))) > 0 GROUP BY 1, 2, 3"""),
    ),
    "pid_context_counts": (lambda s, d: T.context_words(*_gaps_and_lists(s, d), 2), _after(_NAMES, _WORDS, "SELECT * FROM words WHERE cnt >= 2")),
    "bow_filter": (lambda s, d: _bag(s, d), _after(_NAMES, _BAG, "SELECT * FROM bag")),
    "tfidf": (
        lambda s, d: T.tfidf(_bag(s, d)).withColumn("weight", F.round("weight", 6)),
        _after(_NAMES, _BAG + ", raw AS (SELECT b.pid, b.word, cnt * (ln((1 + (SELECT count(DISTINCT pid) FROM bag)) / (1 + df)) + 1) AS w FROM bag b JOIN (SELECT word, count(DISTINCT pid) AS df FROM bag GROUP BY word) USING (word))", "SELECT pid, word, round(w / sqrt(sum(w * w) OVER (PARTITION BY pid)), 6) AS weight FROM raw"),
    ),
    "pattern_topk": (
        lambda s, d: T.top_per_relation(T.filtered_snippets(T.snippets(*_gaps_and_lists(s, d))).groupBy("pid", "snippet").agg(F.sum("cnt").alias("cnt")), "snippet", 5).withColumn("rank", F.col("rank").cast("long")),
        _after(_NAMES, _SNIPPETS, f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY cnt DESC, snippet) AS rank FROM (SELECT pid, lower(snippet) AS snippet, CAST(sum(cnt) AS BIGINT) AS cnt FROM snips
          WHERE NOT regexp_matches(lower(snippet), '{T.PUNCTUATION}') AND len(string_split(snippet, ' ')) <= 5 AND len(list_filter(string_split(lower(snippet), ' '), lambda x: x NOT IN ({_STOP}))) > 0 GROUP BY 1, 2)) WHERE rank <= 5"""),
    ),
    "diff_features": (
        lambda s, d: T.distinguishing_words(_bag(s, d), "P1", "P2"),
        _after(_NAMES, _BAG, """SELECT coalesce(a.word, b.word) AS word, coalesce(a.cnt, 0) AS cnt_a, coalesce(b.cnt, 0) AS cnt_b, abs(coalesce(a.cnt, 0) - coalesce(b.cnt, 0)) AS gap
          FROM (SELECT * FROM bag WHERE pid = 'P1') a FULL JOIN (SELECT * FROM bag WHERE pid = 'P2') b ON a.word = b.word ORDER BY gap DESC, word LIMIT 10"""),
    ),
    "coocc_band": (
        lambda s, d: T.cooccurrence(B.mentions(s, d), 20),
        _V("tokens lexicon mentions", "SELECT x.wdid AS a, y.wdid AS b, count(DISTINCT x.sid) AS docs, count(*) AS cnt FROM mentions x JOIN mentions y ON x.sid = y.sid AND x.wdid < y.wdid AND abs(x.start - y.start) <= 20 GROUP BY 1, 2"),
    ),
    "pmi_props": (
        lambda s, d: T.pmi(T.cooccurrence(B.mentions(s, d), 20).select("a", "b", "cnt")).withColumn("pmi", F.round("pmi", 6)),
        _after("tokens lexicon mentions", """c AS (SELECT x.wdid AS a, y.wdid AS b, count(*) AS cnt FROM mentions x JOIN mentions y ON x.sid = y.sid AND x.wdid < y.wdid AND abs(x.start - y.start) <= 20 GROUP BY 1, 2),
          both_ AS (SELECT a, cnt FROM c UNION ALL SELECT b, cnt FROM c), own AS (SELECT a, sum(cnt) AS own FROM both_ GROUP BY a)""", "SELECT c.a, c.b, c.cnt, round(ln(c.cnt * (SELECT sum(cnt) FROM both_) / (x.own * y.own)), 6) AS pmi FROM c JOIN own x ON x.a = c.a JOIN own y ON y.a = c.b"),
    ),
    "surface_match": (
        lambda s, d: T.surface_matches(*_matched(s, d)).groupBy("wdid").agg(F.count(F.lit(1)).alias("cnt"), F.min("sid").alias("first_sid")),
        _after("tokens lexicon", "two AS (SELECT sid, tok || ' ' || lead(tok) OVER (PARTITION BY sid ORDER BY pos) AS g FROM tokens)", """SELECT wdid, count(*) AS cnt, min(sid) AS first_sid FROM (
          SELECT wdid, sid FROM tokens JOIN lexicon ON tok = word UNION ALL SELECT CASE g WHEN 'of the' THEN 'X1' ELSE 'X2' END, sid FROM two WHERE g IN ('of the', 'in the')) GROUP BY 1"""),
    ),
    "vocab_ids": (
        lambda s, d: numbered_by_count(B.tokens(s, d).groupBy("tok").agg(F.count(F.lit(1)).alias("cnt")), "tok", "cnt"),
        _V("tokens", "SELECT tok, cnt, row_number() OVER (ORDER BY cnt DESC, tok) - 1 AS ind FROM (SELECT tok, count(*) AS cnt FROM tokens GROUP BY tok)"),
    ),
    "mention_pairs_sentence": (
        lambda s, d: T.sentence_pairs(*_in_sentences(s, d)).withColumns({c: F.col(c).cast("long") for c in ("start", "end")}),
        _after(_NAMES, _SENTS + """, m AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY start, end_, wdid) AS idx FROM mentions), rel AS (SELECT h, t, max(pid) AS pid FROM pair_relations GROUP BY h, t),
          held AS (SELECT c.sid, p.wdid AS a, c.wdid AS b, p.end_ AS f, c.start AS g FROM m c JOIN m p ON p.sid = c.sid AND p.idx BETWEEN c.idx - 5 AND c.idx - 1 AND p.end_ <= c.start AND c.start - p.end_ <= 30
            JOIN sents s ON s.sid = c.sid AND p.start >= s.start AND c.end_ <= s.end_ AND s.end_ - s.start < 100)""",
          """SELECT sid, coalesce(x.pid, y.pid) AS pid, CASE WHEN x.pid IS NULL THEN b ELSE a END AS h, CASE WHEN x.pid IS NULL THEN a ELSE b END AS t, f AS start, g AS "end"
          FROM held LEFT JOIN rel x ON x.h = a AND x.t = b LEFT JOIN rel y ON y.h = b AND y.t = a WHERE x.pid IS NOT NULL OR y.pid IS NOT NULL"""),
    ),
    "entity_sentence_index": (
        lambda s, d: T.entity_sentences(*_in_sentences(s, d)[:2], 5).withColumn("sent", F.col("sent").cast("long")),
        _after("tokens lexicon mentions", _SENTS, """SELECT wdid, sid, CAST(sent AS BIGINT) AS sent, mentions FROM (SELECT *, row_number() OVER (PARTITION BY wdid ORDER BY sid, sent) AS k FROM (
          SELECT wdid, m.sid, sent, count(*) AS mentions FROM mentions m JOIN sents s ON s.sid = m.sid AND m.start >= s.start AND m.start < s.end_ GROUP BY 1, 2, 3)) WHERE k <= 5"""),
    ),
    "pmi_categories": (
        lambda s, d: T.set_pmi(_categories(s, d)).withColumn("pmi", F.round("pmi", 6)),
        """WITH c AS (SELECT p_brand AS cat, p_partkey AS e FROM part UNION SELECT p_type, p_partkey FROM part), z AS (SELECT cat, count(*) AS n FROM c GROUP BY cat)
          SELECT x.cat AS a, y.cat AS b, round(ln(CASE WHEN both_ IS NULL THEN 0.00001 ELSE both_ * (SELECT count(DISTINCT e) FROM c) / (x.n * y.n) END), 6) AS pmi FROM z x JOIN z y ON x.cat < y.cat LEFT JOIN (SELECT l.cat AS a, r.cat AS b, count(*) AS both_ FROM c l JOIN c r ON l.e = r.e AND l.cat < r.cat GROUP BY 1, 2) ON a = x.cat AND b = y.cat""",
    ),
    "dep_bow": (
        lambda s, d: T.path_bags(_paths(s, d), 10),
        """WITH p AS (SELECT l_returnflag AS pid, lower(l_linestatus) AS a, lower('W' || CAST(l_linenumber AS VARCHAR)) AS b, 'dep' AS c FROM lineitem), f AS (SELECT pid, a, b, c FROM p GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10)
          SELECT pid, kind, key, count(*) AS cnt FROM (SELECT pid, 'label' AS kind, a AS key FROM f UNION ALL SELECT pid, 'word', b FROM f UNION ALL SELECT pid, 'label', c FROM f) GROUP BY 1, 2, 3""",
    ),
}
