"""Literal fixtures for contexts, samples, evaluation, loops and readers."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandline.operators import contexts as X
from strandline.operators import corpus as C
from strandline.operators import evaluation as E
from strandline.operators import graph as G
from strandline.operators import hierarchy as H
from strandline.operators import pair_scores as P
from strandline.operators import relations as R_
from strandline.operators import samples as S
from strandline.operators import text as T
from strandline.sources import readers as R
from strandline.sources import writers as W


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_dependency_paths_walk_both_ways(spark):
    # 0 <- 1 -> 2 and 2 -> 3; a second way from 0 to 3 is longer.
    edges = spark.createDataFrame([(1, 0, 1, "nsubj"), (1, 2, 1, "obj"), (1, 3, 2, "amod"), (1, 4, 0, "x"), (1, 5, 4, "x"), (1, 6, 5, "x"), (1, 3, 6, "x")], "sid long, child int, head int, dep string")
    words = spark.createDataFrame([(1, i, f"w{i}") for i in range(7)], "sid long, pos int, word string")
    pairs = spark.createDataFrame([(1, 1, [0], [3]), (1, 2, [0, 3], [2]), (1, 3, [1], [1])], "sid long, pair int, starts array<int>, ends array<int>")
    got = {r.pair: r.path for r in X.dependency_paths(edges, words, pairs).collect()}
    assert got == {1: ["nsubj", "w1", "dep_obj", "w2", "dep_amod"], 2: ["amod"], 3: []}
    assert X.dependency_paths(edges, words, pairs.limit(0)).count() == 0


def test_dependency_paths_search_a_sentence_in_one_row(spark):
    # Two ways of one length: the first label in order counts, then the word; a null label comes first; a token without a word is no step; repeats of a pair go together.
    edges = spark.createDataFrame([(1, 0, 1, "b"), (1, 0, 2, "b"), (1, 0, 3, "c"), (1, 1, 4, "z"), (1, 2, 4, "a"), (1, 3, 4, "a"), (1, 0, 9, "a"), (1, 9, 4, "a"), (2, 0, 1, "x"), (2, 0, 1, None)], "sid long, child int, head int, dep string")
    words = spark.createDataFrame([(1, 0, "o"), (1, 1, "p"), (1, 2, "q"), (1, 3, "p"), (1, 4, "e"), (2, 0, "o"), (2, 1, "e")], "sid long, pos int, word string")
    pairs = spark.createDataFrame([(1, 7, [0], [4]), (1, 8, [0], [4]), (1, 8, [3], [4]), (1, 9, [0], [9]), (2, 7, [0, None], [1]), (3, 7, [5], [5]), (3, 8, [5], [6])], "sid long, pair int, starts array<int>, ends array<int>")
    shared = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    before = len(list(shared.iterdir()))
    assert {(r.sid, r.pair): r.path for r in X.dependency_paths(edges, words, pairs).collect()} == {(1, 7): ["b", "p", "z"], (1, 8): ["a"], (2, 7): [None], (3, 7): []}
    # No round is written.
    assert len(list(shared.iterdir())) == before


def test_prompts_span_path_words_and_both_entities(spark):
    tokens = "the old king of France was Louis of course".split()
    df = spark.createDataFrame([("P1_a", tokens, 4, 5, 6, 7, ["of", "was"]), ("P1", tokens, 4, 5, 6, 7, ["of"]), ("P2", ["a"] * 30, 0, 1, 29, 30, ["a"])], "pid string, tokens array<string>, hs int, he int, ts int, te int, path array<string>")
    assert rows(X.mined_prompts(df), "pid", "prompt", "cnt") == [("P1", "of [X] was [Y] .", 2)]
    prompts = spark.createDataFrame([("[X] of [Y]",), ("[X] born in [Y] city",), ("of [X] was [Y] .",), ("[X] King x",)], "prompt string")
    assert rows(C.plain_prompts(prompts, T.STOP_WORDS + ["was"]), "prompt") == [("[X] born in [Y] city",)]


def test_equal_sentences_make_one_prompt_with_their_count(spark):
    df = spark.createDataFrame([("P1", ["a", "x", "b"], 0, 1, 2, 3, ["x"])] * 5 + [("P1_s", ["a", "x", "b"], 0, 1, 2, 3, ["x"])] * 2, "pid string, tokens array<string>, hs int, he int, ts int, te int, path array<string>")
    got = X.mined_prompts(df)
    assert rows(got, "pid", "prompt", "cnt", "rank") == [("P1", "[X] x [Y] .", 7, 1)]
    # Prompts are made above the grouping of sentences.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "count(1) AS times" in plan and "transform" not in plan.split("count(1) AS times")[1]


def test_middles_are_of_the_closest_spans(spark):
    mentions = spark.createDataFrame([(1, 0, 1, "A"), (1, 9, 10, "B"), (1, 12, 13, "A"), (1, 13, 14, "B"), (2, 0, 2, "B"), (2, 1, 2, "A"), (2, 5, 6, "A")], "sid long, start int, end int, wdid string")
    lists = spark.createDataFrame([(s, [f"t{i}" for i in range(20)]) for s in (1, 2)], "sid long, toks array<string>")
    relations = spark.createDataFrame([("A", "B", "P1")], "h string, t string, pid string")
    got = rows(X.middle_contexts(mentions, relations, lists, 10), "sid", "pid", "start", "end", F.array_join("toks", " "))
    assert got == [(1, "P1", 10, 12, "t10 t11"), (2, "P1", 2, 5, "t2 t3 t4")]


def test_endpoint_precision_counts_ties_together(spark):
    scores = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.9), ("b", "c", 0.5), ("d", "a", 0.1)], "p1 string, p2 string, score double")
    truth = spark.createDataFrame([("a", "b"), ("d", "a")], "p1 string, p2 string")
    got = {r.pid: (r.auc, r.ap) for r in E.endpoint_precision(scores, truth).collect()}
    # a: 0.9 (one of two true), 0.1 (true): precision 1/2 at recall 1/2, 2/3 at recall 1.
    assert got["a"] == pytest.approx((0.5 * (1 + 0.5) / 2 + 0.5 * (0.5 + 2 / 3) / 2, 0.5 * 0.5 + 0.5 * 2 / 3))
    assert set(got) == {"a", "b", "d"} and got["b"] == pytest.approx((1, 1))


def test_block_scores_equal_all_pairs(spark):
    import math
    import random

    r = random.Random(1)
    data = {f"P{i}": [[r.gauss(i / 3, 1) for _ in range(3)] for _ in range(5 + i)] for i in range(3)}
    df = spark.createDataFrame([(p, i + 100 * int(p[1]), v) for p, vs in data.items() for i, v in enumerate(vs)], "pid string, id long, vec array<double>")
    pairs = P.all_pairs(df)
    d2 = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    mean = lambda x: sum(x) / len(x)
    want = {
        "euc": lambda c, p: -mean([math.sqrt(d2(x, y)) for x in c for y in p]),
        "expeuc": lambda c, p: mean([math.log(mean([math.exp(-d2(x, y)) for y in p])) for x in c]),
        "mixgau": lambda c, p: sum(math.log(mean([math.exp(-d2(x, y) / 2) / (2 * math.pi) ** 1.5 for y in p])) for x in c),
    }
    density = lambda x, p: mean([math.exp(-d2(x, y) / 0.5) / (2 * math.pi * 0.25) ** 1.5 for y in p])
    want["kde"] = lambda c, p: -sum(density(x, c) * (math.log(density(x, c)) - math.log(density(x, p))) for x in c)
    more = {"mixgau": {"dims": 3}, "kde": {"dims": 3, "sigma": 0.5}}
    for name, score in want.items():
        got = {(x.p1, x.p2): x.score for x in P.METHODS[name](df, pairs, **more.get(name, {})).collect()}
        assert got == pytest.approx({(a, b): score(data[a], data[b]) for a in data for b in data if a != b}), name
    assert P.drawn(df, 4, 3).groupBy("pid").count().where("count <> 4").count() == 0


def test_pairs_are_drawn_or_all(spark):
    chunks = spark.createDataFrame([("a", i) for i in range(3)] + [("b", i) for i in range(4)] + [("c", 0)], "pid string, chunk int")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "zz")], "p1 string, p2 string")
    got = rows(C.sample_pairs(chunks, pairs, 5), "p1", "p2", "c1", "c2")
    assert len([x for x in got if x[1] == "b"]) == 5 and [x for x in got if x[1] == "c"] == [("a", "c", i, 0) for i in range(3)]
    assert got == rows(C.sample_pairs(chunks.repartition(3), pairs, 5), "p1", "p2", "c1", "c2")


def test_splits_by_their_shares(spark):
    first, ever = S.dealing_pattern([0.25, 0.5, 0.25])
    assert [first.count(j) for j in range(3)] == [1, 2, 1] and first[0] == 1 and ever[0] == 0
    df = spark.createDataFrame([("g", i, i) for i in range(103)], "grp string, member int, order int")
    got = {r.split: r["count"] for r in S.proportional_split(df, [("a", 0.1), ("b", 0.9)]).groupBy("split").count().collect()}
    assert got["a"] in (10, 11) and got["a"] + got["b"] == 103
    with pytest.raises(ValueError):
        S.dealing_pattern([0.3, 0.3])


def test_negatives_are_exact(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"))
    got = {r.label: r["count"] for r in S.positives_and_some_negatives(df, 2.5, "id").groupBy("label").count().collect()}
    assert got == {1: 100, 0: 250}
    assert S.positives_and_some_negatives(df, 99, "id").count() == 1000 and S.positives_and_some_negatives(df.limit(0), 1, "id").count() == 0


def test_cycles_raise_or_end(spark):
    loop = spark.createDataFrame([("a", "b", 0), ("b", "c", 0), ("c", "a", 0)], "parent string, child string, pos int")
    with pytest.raises(ValueError, match="cycle"):
        H.closure(loop)
    with pytest.raises(Exception, match="cycle"):
        W.tree_lines(loop, spark.createDataFrame([("a",)], "pid string"))
    assert G.ancestors_until_root(spark.createDataFrame([("a",)], "node string"), loop, spark.createDataFrame([("zz",)], "node string")).count() == 3
    chain = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}", 0) for i in range(70)], "parent string, child string, pos int")
    assert G.ancestors_until_root(spark.createDataFrame([("n070",)], "node string"), chain, spark.createDataFrame([("zz",)], "node string")).count() == 71
    edges = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "a"), ("x", "x")], "src string, dst string")
    assert rows(G.layers_of_all(edges), "node", "layer", "cyclic") == [("a", 1, True), ("b", 2, True), ("r", 0, False), ("x", 0, True)]


def test_lines_must_pair(spark):
    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "line int, x string"), spark.createDataFrame([(1, "c"), (3, "d")], "line int, y string")
    assert rows(C.zipped(left.where("line = 1"), right.where("line = 1")), "line", "x", "y") == [(1, "a", "c")]
    with pytest.raises(Exception, match="lacks line"):
        C.zipped(left, right).collect()
    with pytest.raises(Exception, match="no entity"):
        C.known_or_pad(spark.createDataFrame([("X1",)], "h string"), "h", spark.createDataFrame([("Q1",)], "id string")).collect()


def test_runs_of_labels_collapse_over_files(spark, tmp_path):
    labels = [1, 1, 2, 2, 2, 1, 3, 3, 1]
    for i in range(3):
        (tmp_path / f"f{i}.txt").write_text("".join(f"{v}\tP{j} Q1 Q2\n" for j, v in list(enumerate(labels))[3 * i : 3 * i + 3]))
    got = R.read_nway(spark, str(tmp_path), one_per_label=True).orderBy("pos").collect()
    kept = [(r.label, r.pid) for r in got]
    assert len(kept) >= 5 and all(a[0] != b[0] for a, b in zip(kept, kept[1:]))


def test_see_also_within_a_split(spark):
    lines = spark.createDataFrame([("P1_x", "P2"), ("P2", "P9_y"), ("P3", "P3_z")], "pid string, other string")
    edges = spark.createDataFrame([("T", "P1"), ("T", "P4"), ("T", "P5")], "parent string, child string")
    splits = spark.createDataFrame([("P1", "train"), ("P4", "train"), ("P5", "test")], "pid string, split string")
    assert rows(R.read_see_also(lines, edges, splits), "pid", "other") == [("P1", "P2"), ("P2", "P9")]
    assert rows(R.read_see_also(lines, edges, splits, "train"), "pid", "other") == [("P1", "P4"), ("P2", "P9"), ("P4", "P1")]


def test_sampled_files_keep_their_names(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"f{i}.txt").write_text(f"line {i}\n")
    got = R.sampled_files(spark, str(tmp_path), 2, 5).collect()
    assert len(got) == 2 and all(r.file.endswith(f"f{r.value[-1]}.txt") for r in got)


def test_large_relations_are_numbered_in_ranges(spark):
    occs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "P2").otherwise("P1").alias("pid"), F.concat(F.lit("Q"), ((F.col("id") * 7919) % 700).cast("string")).alias("h"), (F.col("id") % 11).cast("string").alias("t"))
    popularity = R_.entity_degree(occs.select("h", F.lit("r").alias("r"), "t"))
    for run in (lambda n: R_.downsample(occs, n), lambda n: R_.downsample_by_popularity(occs, popularity, large=n), lambda n: R_.chunked(occs, 7, n)):
        whole, cut = (sorted(map(tuple, run(n).collect())) for n in (10**9, 1500))
        assert whole == cut and len(whole) > 100
