"""Operators on annotated text: sentences, mention pairs, snippets, bags of words and their weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.loops import checkpointed, few

SENTENCE_ENDS = [".", "!", "?"]
#: A text that begins with ASCII punctuation.
PUNCTUATION = r"^[!-/:-@\[-`{-~]"
#: Words that filters drop. Fixed values.
STOP_WORDS = "a an and are as at be by for from has he in is it its of on or that the this to was were will with you".split()


def _marks(tokens: DataFrame) -> DataFrame:
    """Places (sid, _at) of end marks, before a document's first token, and of its last one, which may be an end mark and stand here twice."""
    ends = tokens.where(F.col("tok").isin(SENTENCE_ENDS)).select("sid", F.col("pos").alias("_at"))
    whole = tokens.groupBy("sid").agg(F.min("pos").alias("_first"), F.max("pos").alias("_last"))
    return ends.unionByName(whole.select("sid", F.explode(F.array(F.col("_first") - 1, F.col("_last"))).alias("_at")))


def sentences(tokens: DataFrame) -> DataFrame:
    """Sentences (sid, sent, start, end) of tokens (sid, pos, tok), which follow each other in place; an end mark belongs to its sentence. Only marks are dealt and sorted."""
    in_order = Window.partitionBy("sid").orderBy("_at")
    marks = _marks(tokens).withColumn("_before", F.lag("_at").over(in_order)).where("_before < _at")
    return marks.select("sid", (F.row_number().over(in_order) - 1).cast("long").alias("sent"), (F.col("_before") + 1).alias("start"), (F.col("_at") + 1).alias("end"))


def with_sentence(mentions: DataFrame, tokens: DataFrame) -> DataFrame:
    """Mentions with the sentence that they begin in: sent, s_start, s_end. A document's tokens follow each other in place.

    Mentions meet end marks and a document's first and last place only; no other token is dealt or sorted.
    """
    marks = _marks(tokens).withColumn("_mark", F.lit(1))
    met = mentions.withColumn("_at", F.col("start")).withColumn("_mark", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    in_order = Window.partitionBy("sid").orderBy("_at", "_mark").rowsBetween(Window.unboundedPreceding, -1)
    # A mark at a document's last place stands there twice; the second one ends nothing.
    met = met.withColumn("_before", F.max(F.when(F.col("_mark") == 1, F.col("_at"))).over(in_order)).where("_before is not null and _before < _at")
    numbered = met.withColumn("sent", F.coalesce(F.sum("_mark").over(in_order), F.lit(0)))
    placed = numbered.withColumn("s_start", F.col("_before") + 1).withColumn("s_end", F.max(F.when(F.col("_mark") == 1, F.col("_at") + 1)).over(Window.partitionBy("sid", "sent")))
    return placed.where("_mark = 0 and s_end is not null").select(*mentions.columns, "sent", "s_start", "s_end")


def numbered_mentions(mentions: DataFrame) -> DataFrame:
    """Mentions with their index in the document, by start, end and id."""
    return mentions.withColumn("idx", F.row_number().over(Window.partitionBy("sid").orderBy("start", "end", "wdid")))


def forward_pairs(mentions: DataFrame, relations: DataFrame, distance: int = 10, reach: int = 5) -> DataFrame:
    """Gaps between each mention and the next `reach`: (sid, pid, start, end, direction).

    The gap is at most `distance` tokens and not empty. Both directions of the pair are looked up in (h, t, pid); 1 is text order.
    The next mentions come from windows, so a document's mentions never meet each other in a join.
    """
    w = Window.partitionBy("sid").orderBy("start", "end", "wdid")
    ahead = [F.struct(F.lead("start", k).over(w).alias("start"), F.lead("end", k).over(w).alias("end"), F.lead("wdid", k).over(w).alias("wdid")) for k in range(1, reach + 1)]
    pairs = mentions.withColumn("next", F.array(*ahead)).withColumn("next", F.explode("next")).where("next.wdid is not null")
    pairs = pairs.select("sid", F.col("wdid").alias("a"), F.col("next.wdid").alias("b"), F.least("end", "next.end").alias("from"), F.greatest("start", "next.start").alias("to"))
    pairs = pairs.where((F.col("to") > F.col("from")) & (F.col("to") - F.col("from") <= distance))
    both = pairs.select("sid", F.col("from").alias("start"), F.col("to").alias("end"), F.explode(F.array(F.struct(F.col("a").alias("h"), F.col("b").alias("t"), F.lit(1).alias("direction")), F.struct(F.col("b").alias("h"), F.col("a").alias("t"), F.lit(-1).alias("direction")))).alias("p"))
    one = relations.groupBy("h", "t").agg(F.max("pid").alias("pid"))
    return both.select("sid", "start", "end", "p.*").join(one, ["h", "t"]).select("sid", "pid", "start", "end", "direction").distinct()


def gap_tokens(gaps: DataFrame, lists: DataFrame) -> DataFrame:
    """The tokens in each gap: (pid, direction, toks), from token lists (sid, toks).

    A document's gaps meet its list in one row and are cut out of it, so nothing is paired with tokens outside a gap.
    """
    held = gaps.groupBy("sid").agg(F.collect_list(F.struct("pid", "start", "end", "direction")).alias("gaps"))
    cut = F.transform("gaps", lambda g: F.struct(g["pid"].alias("pid"), g["direction"].alias("direction"), F.slice("toks", g["start"] + 1, g["end"] - g["start"]).alias("toks")))
    return lists.join(held, "sid").select(F.explode(cut).alias("g")).select("g.*")


def snippets(gaps: DataFrame, lists: DataFrame) -> DataFrame:
    """Counts (pid, snippet, direction, cnt) of the tokens in the gaps, in order."""
    said = F.array_join("toks", " ")
    return gap_tokens(gaps, lists).groupBy("pid", said.alias("snippet"), "direction").agg(F.count(F.lit(1)).alias("cnt"))


def filtered_snippets(counts: DataFrame, longest: int = 5, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """Snippets that don't begin with ASCII punctuation, have a word besides stop words, and at most `longest` tokens; lower-case ones add up."""
    low = counts.withColumn("snippet", F.lower("snippet"))
    toks = F.split("snippet", " ")
    fine = ~F.col("snippet").rlike(PUNCTUATION) & F.exists(toks, lambda x: ~x.isin(stop_words)) & (F.size(toks) <= longest)
    return low.where(fine).groupBy("pid", "snippet", "direction").agg(F.sum("cnt").alias("cnt"))


def filtered_words(counts: DataFrame, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """Lower-case words of letters and digits without stop words; counts (pid, word, cnt) that meet add up."""
    low = counts.withColumn("word", F.lower("word"))
    return low.where(F.col("word").rlike("^[A-Za-z0-9]+$") & ~F.col("word").isin(stop_words)).groupBy("pid", "word").agg(F.sum("cnt").alias("cnt"))


def context_words(gaps: DataFrame, lists: DataFrame, least: int = 1) -> DataFrame:
    """Counts (pid, word, cnt) of the tokens in the gaps."""
    return gap_tokens(gaps, lists).select("pid", F.explode("toks").alias("word")).groupBy("pid", "word").agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") >= least)


def document_mentions(mentions: DataFrame) -> DataFrame:
    """Documents, mentions and first document of each entity."""
    return mentions.groupBy("wdid").agg(F.countDistinct("sid").alias("docs"), F.count(F.lit(1)).alias("cnt"), F.min("sid").alias("first_sid"))


def cooccurrence(mentions: DataFrame, distance: int) -> DataFrame:
    """Pairs of different entities whose midpoints lie within `distance` tokens: (a, b, docs, cnt).

    Mentions are dealt into bands of `distance` tokens and meet those of their own and the next band only.
    """
    mid = mentions.select("sid", "wdid", ((F.col("start") + F.col("end")) / 2).alias("mid")).withColumn("band", F.floor(F.col("mid") / distance))
    a = mid.select("sid", F.col("wdid").alias("a"), F.col("mid").alias("at_a"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    b = mid.select("sid", F.col("wdid").alias("b"), F.col("mid").alias("at_b"), "band")
    near = a.join(b, ["sid", "band"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("at_a") - F.col("at_b")) <= distance))
    return near.groupBy("a", "b").agg(F.countDistinct("sid").alias("docs"), F.count(F.lit(1)).alias("cnt"))


def surface_matches(tokens: DataFrame, surfaces: DataFrame, longest: int = 2) -> DataFrame:
    """Places where consecutive tokens are a surface form: (sid, start, end, wdid)."""
    w = Window.partitionBy("sid").orderBy("pos")
    grams = [F.struct(F.lit(k + 1).alias("n"), F.concat_ws(" ", "tok", *[F.lead("tok", j).over(w) for j in range(1, k + 1)]).alias("surface"), F.lead("tok", k).over(w).isNotNull().alias("whole")) for k in range(longest)]
    said = tokens.withColumn("g", F.array(*grams)).withColumn("g", F.explode("g")).where("g.whole").select("sid", F.col("pos").alias("start"), (F.col("pos") + F.col("g.n")).alias("end"), "g.surface")
    return said.join(surfaces, "surface").select("sid", "start", "end", "wdid")


def tfidf(counts: DataFrame, doc: str = "pid", term: str = "word") -> DataFrame:
    """tf * (ln((1 + n) / (1 + df)) + 1), of unit length a document."""
    n = counts.select(doc).distinct().agg(F.count(F.lit(1)).alias("n"))
    df = counts.groupBy(term).agg(F.countDistinct(doc).alias("df"))
    raw = counts.join(df, term).crossJoin(F.broadcast(n)).withColumn("w", F.col("cnt") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    return raw.withColumn("weight", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))).select(doc, term, "weight")


def pmi(pairs: DataFrame, least: int = 1) -> DataFrame:
    """Pointwise mutual information ln(c n / (c_a c_b)) of the pairs (a, b, cnt), both orders counted."""
    both = pairs.select("a", "b", "cnt").unionAll(pairs.select(F.col("b"), F.col("a"), F.col("cnt")))
    single = both.groupBy("a").agg(F.sum("cnt").alias("own"))
    total = both.agg(F.sum("cnt").alias("n"))
    met = pairs.where(F.col("cnt") >= least).join(single.select("a", F.col("own").alias("own_a")), "a").join(single.select(F.col("a").alias("b"), F.col("own").alias("own_b")), "b")
    return met.crossJoin(F.broadcast(total)).select("a", "b", "cnt", F.log(F.col("cnt") * F.col("n") / (F.col("own_a") * F.col("own_b"))).alias("pmi"))


def top_per_relation(counts: DataFrame, key: str, n: int) -> DataFrame:
    """The n keys of the highest count of each relation, then by key: with their rank."""
    rank = F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("cnt"), key))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def distinguishing_words(counts: DataFrame, a: str, b: str, n: int = 10) -> DataFrame:
    """Words whose counts differ most between two relations."""
    own = lambda pid, name: counts.where(F.col("pid") == pid).select("word", F.col("cnt").alias(name))
    met = own(a, "cnt_a").join(own(b, "cnt_b"), "word", "full").fillna(0)
    return met.withColumn("gap", F.abs(F.col("cnt_a") - F.col("cnt_b"))).orderBy(F.desc("gap"), "word").limit(n)


def sentence_pairs(mentions: DataFrame, tokens: DataFrame, relations: DataFrame, distance: int = 30, reach: int = 5, longest: int = 100) -> DataFrame:
    """Pairs of a mention with one of the `reach` before it in the same sentence: (sid, pid, h, t, start, end).

    Mentions don't overlap, lie at most `distance` tokens apart, and the sentence has under `longest` tokens. The pair in text order
    is looked up first, then the other way round; start and end are the gap.
    """
    w = Window.partitionBy("sid").orderBy("start", "end", "wdid")
    before = [F.struct(F.lag("start", k).over(w).alias("start"), F.lag("end", k).over(w).alias("end"), F.lag("wdid", k).over(w).alias("wdid")) for k in range(1, reach + 1)]
    pairs = with_sentence(mentions, tokens).withColumn("prev", F.array(*before)).withColumn("prev", F.explode("prev")).where("prev.wdid is not null and prev.end <= start")
    pairs = pairs.where(F.col("start") - F.col("prev.end") <= distance)
    inside = (F.col("prev.start") >= F.col("s_start")) & (F.col("end") <= F.col("s_end")) & (F.col("prev.start") < F.col("s_end")) & (F.col("s_end") - F.col("s_start") < longest)
    held = pairs.where(inside).select("sid", F.col("prev.wdid").alias("a"), F.col("wdid").alias("b"), F.col("prev.end").alias("from"), F.col("start").alias("to"))
    one = relations.groupBy("h", "t").agg(F.max("pid").alias("pid"))
    there = held.join(one.select(F.col("h").alias("a"), F.col("t").alias("b"), F.col("pid").alias("ahead")), ["a", "b"], "left")
    both = there.join(one.select(F.col("h").alias("b"), F.col("t").alias("a"), F.col("pid").alias("back")), ["a", "b"], "left").where("ahead is not null or back is not null")
    forward = F.col("ahead").isNotNull()
    return both.select("sid", F.coalesce("ahead", "back").alias("pid"), F.when(forward, F.col("a")).otherwise(F.col("b")).alias("h"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("t"), F.col("from").alias("start"), F.col("to").alias("end"))


def entity_sentences(mentions: DataFrame, tokens: DataFrame, most: int) -> DataFrame:
    """The first `most` sentences of each entity, by document and number: (wdid, sid, sent, mentions)."""
    held = with_sentence(mentions, tokens).groupBy("wdid", "sid", "sent").agg(F.count(F.lit(1)).alias("mentions"))
    nth = F.row_number().over(Window.partitionBy("wdid").orderBy("sid", "sent"))
    return held.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")


def path_bags(paths: DataFrame, least: int = 10) -> DataFrame:
    """Words and labels of dependency paths (pid, path array): (pid, kind, key, cnt), one for each distinct frequent path.

    Paths alternate labels (even places) and words (odd ones), and need `least` occurrences and more than one entry.
    """
    low = paths.withColumn("path", F.transform("path", lambda x: F.lower(x))).where(F.size("path") > 1)
    common = low.groupBy("pid", "path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    one = common.select("pid", F.posexplode("path").alias("pos", "key"))
    kind = F.when(F.col("pos") % 2 == 1, "word").otherwise("label")
    return one.withColumn("kind", kind).groupBy("pid", "kind", "key").agg(F.count(F.lit(1)).alias("cnt"))


def set_pmi(members: DataFrame) -> DataFrame:
    """ln(n |a and b| / (|a| |b|)) of all pairs of the sets in (cat, entity); ln(1e-5) for pairs that never meet. Sets number in the hundreds."""
    own = members.select("cat", "entity").distinct()
    sizes = own.groupBy("cat").agg(F.count(F.lit(1)).alias("size"))
    total = own.select("entity").distinct().agg(F.count(F.lit(1)).alias("n"))
    a = own.select(F.col("cat").alias("a"), "entity")
    met = a.join(own.select(F.col("cat").alias("b"), "entity"), "entity").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    every = sizes.agg(F.collect_list(F.struct(F.col("cat").alias("b"), F.col("size").alias("size_b"))).alias("every"))
    pairs = sizes.select(F.col("cat").alias("a"), F.col("size").alias("size_a")).crossJoin(F.broadcast(every)).select("a", "size_a", F.inline("every")).where("a < b")
    met = pairs.join(met, ["a", "b"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    return met.crossJoin(F.broadcast(total)).select("a", "b", F.log(F.when(F.col("both") == 0, F.lit(1e-5)).otherwise(F.col("both") * F.col("n") / (F.col("size_a") * F.col("size_b")))).alias("pmi"))


def snippet_bags(counts: DataFrame, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """Words of snippets (pid, snippet, direction): (pid, word, cnt). Each distinct snippet of a direction counts once for each of its words' places; then directions add up."""
    one = counts.select("pid", "snippet", "direction").distinct().select("pid", F.explode(F.split("snippet", " ")).alias("word"))
    return filtered_words(one.groupBy("pid", "word").agg(F.count(F.lit(1)).alias("cnt")), stop_words)


def words_that_differ(train: DataFrame, test: DataFrame, pairs: DataFrame, n: int = 10) -> DataFrame:
    """For pairs of relations (a, b) the words whose counts differ most, among the first n both in train and in test: (a, b, word, train_gap, test_gap).

    Counts are (pid, word, cnt). Equal gaps go by the word. Gaps are those of a less those of b.

    A gap is no larger than the larger count. The n most frequent words of every relation give each pair n gaps that its first n can't fall below, and
    words that stay below in both relations aren't paired. Where a pair has fewer such words, all of its words are.
    """
    sides = few(pairs.select("a", "b").distinct().select("a", "b", F.inline(F.array(F.struct(F.col("a").alias("pid"), F.lit(1).alias("sign")), F.struct(F.col("b").alias("pid"), F.lit(-1).alias("sign"))))))

    def gaps_of(rows: DataFrame, sides: DataFrame) -> DataFrame:
        """Gaps of all pairs from words (word, most, pid, cnt): (a, b, word, gap); a pair's words need a count of `least` in some relation."""
        met = rows.join(sides, "pid").where("most >= least")
        gaps = met.groupBy("a", "b", "word").agg(F.sum(F.col("cnt") * F.col("sign")).alias("gap"))
        nth = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc(F.abs("gap")), "word"))
        return gaps.withColumn("_nth", nth).where(F.col("_nth") <= n)

    def first(counts: DataFrame, name: str) -> DataFrame:
        # The counts of a word, one a relation, meet in one row.
        own = counts.groupBy("pid", "word").agg(F.sum("cnt").alias("cnt"))
        words = checkpointed(own.groupBy("word").agg(F.max("cnt").alias("most"), F.collect_list(F.struct("pid", "cnt")).alias("own")))
        rows = words.select("word", "most", F.inline("own"))
        nth = F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("cnt"), "word"))
        often = rows.withColumn("_nth", nth).where(F.col("_nth") <= n).select("word").distinct()
        known = words.join(few(often), "word", "left_semi").select("word", "most", F.inline("own"))
        least = gaps_of(known, sides.withColumn("least", F.lit(0))).where(F.col("_nth") == n).select("a", "b", F.abs("gap").alias("least"))
        bound = few(sides.join(least, ["a", "b"], "left").fillna(0, ["least"]))
        lowest = bound.agg(F.min("least")).first()[0] or 0
        return gaps_of(words.where(F.col("most") >= lowest).select("word", "most", F.inline("own")), bound).where(F.col("_nth") <= n).select("a", "b", "word", F.col("gap").alias(name))

    return first(train, "train_gap").join(first(test, "test_gap"), ["a", "b", "word"])
