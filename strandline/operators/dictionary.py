"""Dictionary matching: surface forms of any length in token lists, longest and leftmost or all of them, and what of a text a topic's neighbours cover."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.loops import checkpointed
from strandline.operators.text import STOP_WORDS

#: First words and surfaces up to this many are broadcast (some hundred bytes each); beyond it Spark joins by shuffle.
BROADCAST_ROWS = 200_000
#: Tokens of a stretch of a list.
STRETCH = 32


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def _bounded(df: DataFrame) -> DataFrame:
    """The checkpointed frame, marked for broadcast if its counted rows allow it."""
    held = checkpointed(df)
    return F.broadcast(held) if held.count() <= BROADCAST_ROWS else held


def surfaces_of(names: DataFrame, lower: bool = True, stop_words: list[str] = STOP_WORDS, most_words: int | None = None) -> DataFrame:
    """Who bears which surface: (id, surface, n words, first word), each once, from (id, name).

    Blanks around and between words don't count, nor case if `lower`. Names that are one stop word are left out, as are
    empty ones and those of more than `most_words` words.
    """
    said = names.where("id is not null and name is not null").select("id", _words(F.lower("name") if lower else F.col("name")).alias("w"))
    fine = (F.size("w") > 0) & ~((F.size("w") == 1) & F.lower(F.get("w", F.lit(0))).isin(stop_words))
    if most_words is not None:
        fine &= F.size("w") <= most_words
    return said.where(fine).select("id", F.array_join("w", " ").alias("surface"), F.size("w").alias("n"), F.get("w", F.lit(0)).alias("first")).distinct()


def inverted_names(names: DataFrame, lower: bool = True, stop_words: list[str] = STOP_WORDS, most_ids: int = 100, most_words: int | None = None) -> DataFrame:
    """Surfaces and the ids that bear them: (surface, n words, first word, ids), from (id, name) as `surfaces_of` has them. Of a name's ids the `most_ids` smallest stay."""
    one = surfaces_of(names, lower, stop_words, most_words)
    nth = F.row_number().over(Window.partitionBy("surface").orderBy("id"))
    few = one.withColumn("nth", nth).where(F.col("nth") <= most_ids)
    return few.groupBy("surface").agg(F.first("n").alias("n"), F.first("first").alias("first"), F.array_sort(F.collect_list("id")).alias("ids"))


def dictionary_places(lists: DataFrame, surfaces: DataFrame, lower: bool = True) -> DataFrame:
    """All places (sid, start, end, surface, ids) where a surface's words stand, in token lists (sid, toks).

    Lists are cut into stretches, each with the words behind it that a surface may reach. A token goes on only if some surface begins with it, once for
    each length of those surfaces; the words from there are met with the surfaces by a 64-bit hash, and by themselves.
    """
    surfaces = checkpointed(surfaces)
    longest = surfaces.agg(F.max("n")).first()[0] or 1
    starts = _bounded(surfaces.select("first", "n").distinct())
    keyed = _bounded(surfaces.select("surface", "ids", F.xxhash64("surface").alias("key")))
    low = F.lower if lower else (lambda c: c)
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size("toks") - 1, F.lit(0)), F.lit(STRETCH)), lambda i: F.struct(i.cast("long").alias("at"), F.slice("toks", i + 1, STRETCH + longest - 1).alias("ahead")))
    # Filters on lists or surfaces, written or inferred from what may be null, would find them a second time.
    parts = lists.select("sid", F.inline(cut))
    tokens = parts.select("sid", "at", "ahead", F.posexplode(F.slice("ahead", 1, STRETCH)).alias("i", "tok"))
    # Functions on arrays run in compiled code here, where the words ahead are cut out only for tokens that go on; a lambda would end that.
    tokens = tokens.select("sid", (F.col("at") + F.col("i")).alias("start"), low(F.col("tok")).alias("first"), F.slice("ahead", F.col("i") + 1, longest).alias("w"))
    said = tokens.join(starts, "first").where(F.col("n") <= F.size("w"))
    said = said.select("sid", "start", (F.col("start") + F.col("n")).alias("end"), F.coalesce(low(F.array_join(F.slice("w", F.lit(1), F.col("n")), " ")), F.lit("")).alias("surface"))
    return said.withColumn("key", F.xxhash64("surface")).join(keyed, ["key", "surface"]).select("sid", "start", "end", "surface", "ids")


def longest_leftmost(places: DataFrame) -> DataFrame:
    """Of places that overlap, those that a reader takes who goes from left to right and takes the longest at each word.

    Only places that overlap through others are decided together: where a place begins at or after all earlier ones' ends, the reader begins anew.
    """
    by_start = Window.partitionBy("sid", "start").orderBy(F.desc("end"))
    longest = places.withColumn("_nth", F.row_number().over(by_start)).where("_nth = 1").drop("_nth")
    before = F.max("end").over(Window.partitionBy("sid").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    parted = longest.withColumn("_new", F.when(F.col("start") < before, 0).otherwise(1))
    parted = parted.withColumn("_part", F.sum("_new").over(Window.partitionBy("sid").orderBy("start")))
    held = parted.groupBy("sid", "_part").agg(F.array_sort(F.collect_list(F.struct("start", "end", "surface", "ids"))).alias("all"))
    start = F.struct(F.lit(-1).cast("long").alias("at"), F.filter("all", lambda x: F.lit(False)).alias("kept"))
    take = lambda s, x: F.when(x["start"] >= s["at"], F.struct(x["end"].alias("at"), F.concat(s["kept"], F.array(x)).alias("kept"))).otherwise(s)
    return held.select("sid", F.inline(F.aggregate("all", start, take)["kept"]))


def not_found(surfaces: DataFrame, places: DataFrame) -> DataFrame:
    """Surfaces that stand nowhere: (surface, ids)."""
    return surfaces.select("surface", "ids").join(places.select("surface").distinct(), "surface", "left_anti")


def first_sentences(places: DataFrame, sentences: DataFrame, most: int = 10_000) -> DataFrame:
    """For each id the first sentences that name it, `most` at the most: (id, sid, sent), from places and sentences (sid, sent, start, end).

    A place lies in the sentence that its first word is in. Both meet at bands of 64 words, so a document's sentences don't all meet its places.
    """
    band = 64
    spread = sentences.withColumn("band", F.explode(F.sequence(F.floor(F.col("start") / band), F.floor((F.col("end") - 1) / band))))
    spread = spread.select("sid", "band", "sent", F.col("start").alias("from"), F.col("end").alias("to"))
    met = places.withColumn("band", F.floor(F.col("start") / band)).join(spread, ["sid", "band"]).where("start >= from and start < to")
    one = met.select(F.explode("ids").alias("id"), "sid", "sent").distinct()
    nth = F.row_number().over(Window.partitionBy("id").orderBy("sid", "sent"))
    return one.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")


def covered_share(lists: DataFrame, places: DataFrame, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """Tokens of each text, and those within a place; stop words count in neither: (sid, tokens, covered).

    The mean of covered / tokens is the macro coverage, the quotient of sums the micro one.
    """
    tokens = lists.select("sid", F.posexplode("toks").alias("pos", "tok")).where(~F.lower("tok").isin(stop_words))
    inner = places.select("sid", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos")).distinct().withColumn("inside", F.lit(1))
    met = tokens.withColumn("pos", F.col("pos").cast("long")).join(inner, ["sid", "pos"], "left")
    counts = met.groupBy("sid").agg(F.count(F.lit(1)).alias("tokens"), F.count("inside").alias("covered"))
    return lists.select("sid").join(counts, "sid", "left").fillna(0, ["tokens", "covered"])


def topic_graphs(topics: DataFrame, links: DataFrame, places: DataFrame, borne: DataFrame | None = None) -> DataFrame:
    """What each article's topic unfolds to: (sid, id, round, start, end), round 0 for the topic itself, without a place.

    `topics` has (sid, id), `links` (id, other) the neighbours whose surfaces an expanded entity brings in, `places` (sid, id, start, end); with `borne` (id, surface),
    places are (sid, surface, start, end), so one that many ids share stands once. The topic is expanded first; its neighbours are looked for in the whole article. Then, again and again, the found entity whose place comes first
    and that wasn't expanded yet is expanded, and its neighbours are looked for behind that place; an entity found anew has its later
    place from then on. An article ends when every entity found in it is expanded.

    All articles go one entity further each round, so the rounds are as many as the most that one article unfolds. Each round joins the articles'
    present entities with links and places. What an article has found, and which of it is expanded, stays in one table as long as the article goes on; what a
    round expands is written once.
    """
    if borne is None:
        places = places.withColumnRenamed("id", "surface")
    places = checkpointed(places.select("sid", "surface", "start", "end").distinct())
    links = links.select("id", "other").where("id <> other").distinct()
    links = checkpointed(links.withColumn("surface", F.col("other")) if borne is None else links.join(borne.select(F.col("id").alias("other"), "surface").distinct(), "other"))
    nowhere = F.struct(F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
    now = checkpointed(topics.select("sid", "id").groupBy("sid").agg(F.min("id").alias("id")).withColumn("place", nowhere))
    held = now.withColumn("expanded", F.lit(False))
    rounds = []
    while now.limit(1).count():
        rounds.append(now.select("sid", "id", F.lit(len(rounds)).alias("round"), "place.start", "place.end"))
        wanted = now.join(links, "id").select("sid", F.col("other").alias("id"), "surface", F.coalesce("place.end", F.lit(0)).alias("behind"))
        found = wanted.join(places, ["sid", "surface"]).where("start >= behind").groupBy("sid", "id").agg(F.min(F.struct("start", "end")).alias("new"))
        # An article without a present entity has ended, so only those that go on are held.
        left = held.join(now.select("sid", F.col("id").alias("here")), "sid").select("sid", "id", "place", (F.col("expanded") | F.col("id").eqNullSafe(F.col("here"))).alias("expanded"))
        place = F.when(F.col("expanded"), F.col("place")).otherwise(F.coalesce("new", "place"))
        held = checkpointed(left.join(found, ["sid", "id"], "full").select("sid", "id", place.alias("place"), F.coalesce("expanded", F.lit(False)).alias("expanded")))
        now = checkpointed(held.where("not expanded").groupBy("sid").agg(F.min(F.struct("place", "id")).alias("x")).select("sid", "x.id", "x.place"))
    rounds = rounds or [now.select("sid", "id", F.lit(0).alias("round"), "place.start", "place.end")]
    return reduce(DataFrame.unionByName, rounds)
