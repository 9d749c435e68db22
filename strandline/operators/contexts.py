"""Contexts of entity pairs: middle tokens, dependency paths, prompts, and feature lines."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType


def middle_contexts(mentions: DataFrame, relations: DataFrame, lists: DataFrame, distance: int = 20) -> DataFrame:
    """Tokens between the closest spans of each related pair in a document, in either order: (sid, pid, h, t, start, end, toks).

    Spans that overlap or touch have no middle; a gap has at most `distance` tokens, and of equal gaps the first counts. Mentions meet in
    bands of `distance` tokens, so a document's mentions are never all paired.
    """
    width = 2 * distance
    at = mentions.select("sid", "wdid", "start", "end", F.floor(F.col("start") / width).alias("band"))
    a = at.select("sid", F.col("wdid").alias("a"), F.col("start").alias("a_start"), F.col("end").alias("a_end"), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    b = at.select("sid", F.col("wdid").alias("b"), F.col("start").alias("b_start"), "band")
    gap = F.col("b_start") - F.col("a_end")
    near = a.join(b, ["sid", "band"]).where((gap > 0) & (gap <= distance)).select("sid", "a", "b", F.col("a_end").alias("start"), F.col("b_start").alias("end"))
    both = near.select("sid", "start", "end", F.explode(F.array(F.struct(F.col("a").alias("h"), F.col("b").alias("t")), F.struct(F.col("b").alias("h"), F.col("a").alias("t")))).alias("p"))
    one = relations.groupBy("h", "t").agg(F.max("pid").alias("pid"))
    held = both.select("sid", "start", "end", "p.*").join(one, ["h", "t"])
    best = held.groupBy("sid", "pid", "h", "t").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("gap"), "start", "end")).alias("best"))
    in_document = best.groupBy("sid").agg(F.collect_list(F.struct("pid", "h", "t", "best.start", "best.end")).alias("all"))
    cut = F.transform("all", lambda g: F.struct(g["pid"].alias("pid"), g["h"].alias("h"), g["t"].alias("t"), g["start"].alias("start"), g["end"].alias("end"), F.slice("toks", g["start"] + 1, g["end"] - g["start"]).alias("toks")))
    return lists.join(in_document, "sid").select("sid", F.explode(cut).alias("g")).select("sid", "g.*")


def _path_search() -> Callable:
    """A function from sentences, each with its pairs, edges and words, to found paths. All of it is defined in here, so executors need no package of ours."""

    def shortest_path(steps: dict, words: dict, starts: list, ends: set, place: dict) -> list | None:
        """The first in order of the shortest paths between two token sets, or None. `steps` has (next, label) of each token; `place` orders labels and words."""
        before: dict = {node: None for node in starts if node is not None}
        if ends.intersection(before):
            return []
        rank, many = dict.fromkeys(before, 0), len(place)
        while rank:
            # Paths of one length are in the order of the paths that they go on from, then by label and word.
            reached: dict = {}
            for node, r in rank.items():
                for there, label in steps.get(node, ()):
                    if there not in before and there in words:
                        at = r * many + place[label]
                        if there not in reached or at < reached[there][0]:
                            reached[there] = (at, node, label)
            last = min(ends.intersection(reached), key=lambda node: reached[node][0], default=None)
            if last is not None:
                _, node, label = reached[last]
                path = [label]
                while before[node]:
                    path += [words[node], before[node][1]]
                    node = before[node][0]
                return path[::-1]
            orders = {node: at * many + place[words[node]] for node, (at, _, _) in reached.items()}
            nth = {order: i for i, order in enumerate(sorted(set(orders.values())))}
            rank = {node: nth[order] for node, order in orders.items()}
            before.update({node: (back, label) for node, (_, back, label) in reached.items()})
        return None

    def paths_of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        at = {c: column(c).offsets.to_pylist() for c in ("pairs", "edges", "words")}
        field = lambda name, i: column(name).values.field(i)
        pair, starts, ends = (field("pairs", i).to_pylist() for i in range(3))
        child, head, dep = (field("edges", i).to_pylist() for i in range(3))
        pos, word = (field("words", i).to_pylist() for i in range(2))
        down = {x: None if x is None else f"dep_{x}" for x in set(dep)}
        place = {x: i for i, x in enumerate(sorted({*down, *down.values(), *word}, key=lambda x: (x is not None, x or "")))}
        rows, of, paths = [], [], []
        for i in range(batch.num_rows):
            words: dict = {}
            for j in range(at["words"][i], at["words"][i + 1]):
                if pos[j] not in words or place[word[j]] < place[words[pos[j]]]:
                    words[pos[j]] = word[j]
            steps = defaultdict(list)
            for j in range(at["edges"][i], at["edges"][i + 1]):
                steps[child[j]].append((head[j], dep[j]))
                steps[head[j]].append((child[j], down[dep[j]]))
            best: dict = {}
            for j in range(at["pairs"][i], at["pairs"][i + 1]):
                path = shortest_path(steps, words, starts[j] or [], set(ends[j] or ()) - {None}, place)
                if path is not None:
                    order = (len(path), [place[x] for x in path])
                    if pair[j] not in best or order < best[pair[j]][0]:
                        best[pair[j]] = (order, j, path)
            for _, j, path in best.values():
                rows.append(i)
                of.append(j)
                paths.append(path)
        taken = [column("sid").take(pa.array(rows, pa.int64())), field("pairs", 0).take(pa.array(of, pa.int64())), pa.array(paths, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(taken, ["sid", "pair", "path"])

    return lambda batches: map(paths_of_batch, batches)


def dependency_paths(edges: DataFrame, words: DataFrame, pairs: DataFrame) -> DataFrame:
    """Shortest path between two token sets of a sentence: (sid, pair, path), labels and words in turn, the start word left out.

    Edges are (sid, child, head, dep), words (sid, pos, word), pairs (sid, pair, starts, ends) with arrays of positions. Edges are walked
    both ways; against the arrow a label gets `dep_`. Of equally short paths the first in order stays. A sentence with pairs meets its edges and
    words once, in one row, and is searched level by level, a token once; nothing of the search is shuffled or written.
    """
    wanted = pairs.groupBy("sid").agg(F.collect_list(F.struct("pair", "starts", "ends")).alias("pairs"))
    held = edges.groupBy("sid").agg(F.collect_list(F.struct("child", "head", "dep")).alias("edges"))
    said = words.groupBy("sid").agg(F.collect_list(F.struct("pos", "word")).alias("words"))
    whole = wanted.join(held, "sid", "left").join(said, "sid", "left")
    kind = StructType([StructField("sid", pairs.schema["sid"].dataType), StructField("pair", pairs.schema["pair"].dataType), StructField("path", ArrayType(StringType()))])
    return whole.mapInArrow(_path_search(), kind)


def mined_prompts(sentences: DataFrame, longest: int = 20, most: int = 100) -> DataFrame:
    """The most frequent prompts of each relation: (pid, prompt, cnt, rank), from (pid, tokens, hs, he, ts, te, path).

    The words of the path are found in the sentence, each at the place nearest to the head (the first on ties). A prompt runs from the first
    to the last of them and of both entities; entity tokens are [X] and [Y], once for a run, and ` .` ends it. Prompts of `longest` tokens or more
    are dropped. Relations split by type count for their base relation.
    """
    places = F.sequence(F.lit(0), F.size("tokens") - 1)
    near = lambda w: F.array_min(F.transform(F.filter(places, lambda i: F.get("tokens", i) == w), lambda i: F.struct(F.abs(i - F.col("hs")).alias("d"), i.alias("i"))))["i"]
    found = F.filter(F.transform("path", near), lambda i: i.isNotNull())
    from_, to = F.least(F.col("hs"), F.col("ts"), F.array_min("found")), F.greatest(F.col("he") - 1, F.col("te") - 1, F.array_max("found"))
    slot = lambda i: F.when((i >= F.col("hs")) & (i < F.col("he")), "[X]").when((i >= F.col("ts")) & (i < F.col("te")), "[Y]").otherwise(F.get("tokens", i))
    # Equal sentences are one row with their count; so a prompt is made once for all of them, and by as many tasks as there are.
    names = ["pid", "tokens", "hs", "he", "ts", "te", "path"]
    once_each = sentences.where(F.size("tokens") > 0).groupBy(*names).agg(F.count(F.lit(1)).alias("times"))
    said = once_each.withColumn("found", found).withColumns({"from": from_, "to": to})
    said = said.withColumn("all", F.transform(F.sequence("from", "to"), slot))
    once = F.filter(F.transform("all", lambda x, i: F.when(x.isin("[X]", "[Y]") & (i > 0) & (F.get("all", i - 1) == x), F.lit(None)).otherwise(x)), lambda x: x.isNotNull())
    # The length goes with the count, or Spark would test it before the grouping, on every sentence.
    said = said.withColumn("all", once).where(F.when(F.col("times") > 0, F.size("all")) < longest)
    counts = said.groupBy(F.substring_index("pid", "_", 1).alias("pid"), F.concat(F.array_join("all", " "), F.lit(" .")).alias("prompt")).agg(F.sum("times").alias("cnt"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("cnt"), "prompt"))).where(F.col("rank") <= most)


def feature_lines(samples: DataFrame, contexts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Each sample's (sample, key) context words with their numbers, by descending count, as a line `id count TAB id count`: (sample, line).

    Words outside the vocabulary (word, ind) are left out; a sample without any has an empty line.
    """
    met = samples.join(contexts, "key").join(vocabulary.select("word", "ind"), "word")
    lines = met.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("by"), "ind", "cnt"))).alias("all"))
    said = F.array_join(F.transform("all", lambda x: F.concat_ws(" ", x["ind"].cast("string"), x["cnt"].cast("string"))), "\t")
    return samples.select("sample").distinct().join(lines.select("sample", said.alias("line")), "sample", "left").select("sample", F.coalesce("line", F.lit("")).alias("line"))


def date_forms(rows: DataFrame, column: str) -> DataFrame:
    """Two surface forms of each valid date: `3 May 1950` and `May 3, 1950`: (all columns, form)."""
    at = F.expr(f"try_to_timestamp({column})")
    return rows.withColumn("form", F.explode(F.array(F.date_format(at, "d MMMM yyyy"), F.date_format(at, "MMMM d, yyyy")))).where("form is not null")
