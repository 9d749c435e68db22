"""Operators on small literal tables with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from strandline.operators import graph as G
from strandline.operators import hierarchy as H
from strandline.operators import metrics as M
from strandline.operators import relations as R
from strandline.operators import samples as S
from strandline.operators import text as T
from strandline.operators import vectors as V


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


EDGES = [("A", "B", 0), ("A", "C", 1), ("B", "D", 0), ("C", "D", 0), ("D", "E", 0)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "parent string, child string, pos int")


def test_closure_counts_paths(edges):
    got = {(r.anc, r.des, r.depth): r.paths for r in H.closure(edges).collect()}
    assert got[("A", "D", 2)] == 2 and got[("A", "E", 3)] == 2 and got[("D", "E", 1)] == 1 and len(got) == 9


def test_counts_follow_every_path(spark, edges):
    counts = spark.createDataFrame([("D", "w", 3), ("A", "w", 1)], "pid string, key string, cnt long")
    got = {r.pid: r.cnt for r in H.populated_counts(counts, H.closure(edges)).collect()}
    assert got == {"A": 7, "B": 3, "C": 3, "D": 3}


def test_prune_takes_everything_below(edges):
    assert rows(H.pruned(edges, H.closure(edges), ["D"])) == [("A", "B"), ("A", "C")]


def test_leaves_keep_duplicates_and_parents_lose_shared_pairs(spark, edges):
    occs = spark.createDataFrame([("D", "x", "y"), ("E", "x", "y"), ("E", "x", "y"), ("D", "u", "v"), ("D", "u", "v")], "pid string, h string, t string")
    assert rows(R.without_descendants(occs, H.closure(edges))) == [("D", "u", "v"), ("E", "x", "y"), ("E", "x", "y")]


def test_smallest_key_is_never_split(spark):
    occs = spark.createDataFrame([("p", f"a{i}", "t") for i in range(5)] + [("p", "b", "t")], "pid string, h string, t string")
    types = spark.createDataFrame([(f"a{i}", "A", 1, 0) for i in range(5)] + [("b", "B", 1, 0)], "entity string, type string, depth int, pos int")
    got = {(r.h_type, r.name) for r in R.split_names(R.type_keys(occs, types)).collect()}
    assert got == {("A", "p_A_Q"), ("B", "p")}


def test_runs_collapse_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 0), (4, 0), (5, 1)], "pos int, label int").withColumn("k", F.lit(1))
    assert [r.pos for r in R.drop_consecutive(df, ["k"], ["pos"], "label").orderBy("pos").collect()] == [1, 3, 5]


def test_walks_repeat_nodes(spark):
    t = spark.createDataFrame([("a", "r", "b"), ("b", "r", "a")], "h string, r string, t string")
    seeds = spark.createDataFrame([("a",)], "entity string")
    assert rows(G.walks(seeds, t, 3), "id", "depth") == [("a", 0), ("a", 2), ("b", 1), ("b", 3)]


def test_layers_are_longest_paths_and_leave_cycles_out(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("y", "z")], "src string, dst string")
    assert rows(G.layers(e)) == [("a", 0), ("b", 1), ("c", 2)]


def test_nearest_top_is_shortest(spark):
    up = spark.createDataFrame([("c", "b"), ("b", "a"), ("c", "z"), ("o", "p")], "child string, parent string")
    tops = spark.createDataFrame([("a",), ("z",)], "node string")
    nodes = spark.createDataFrame([("c",), ("o",)], "node string")
    assert sorted(map(tuple, G.nearest_top(nodes, up, tops).collect())) == [("c", "z", 1), ("o", None, -1)]


def test_sentences_keep_their_end_mark(spark):
    t = spark.createDataFrame([(1, i, w) for i, w in enumerate("a b . c ! d".split())], "sid long, pos int, tok string")
    assert rows(T.sentences(t), "start", "end") == [(0, 3), (3, 5), (5, 6)]


def test_mentions_find_their_sentence_among_end_marks(spark):
    """Texts that end with and without a mark, marks in a row, mentions at marks, before the first and behind the last token; of tokens, end marks alone are dealt."""
    texts = {1: "a b . c ! d", 2: ". . a", 3: "a b .", 4: "a", 5: "x " * 5000 + "."}
    t = spark.createDataFrame([(s, i, w) for s, x in texts.items() for i, w in enumerate(x.split())], "sid long, pos int, tok string")
    places = [(s, i, i + 2, w) for s, x in texts.items() for i in range(-1, len(x.split()) + 1) if i < 9 for w in ("W1", "W2")]
    want = []
    for s, i, j, w in places:
        toks = texts.get(s, "").split()
        if 0 <= i < len(toks):
            ends = [k for k, x in enumerate(toks) if x in ".!?"]
            behind = [k for k in ends if k < i]
            want.append((s, i, j, w, len(behind), max(behind, default=-1) + 1, min([k for k in ends if k >= i], default=len(toks) - 1) + 1))
    got = T.with_sentence(spark.createDataFrame([*places, (9, 0, 1, "W1")], "sid long, start int, end int, wdid string"), t)
    assert rows(got, "sid", "start", "end", "wdid", "sent", "s_start", "s_end") == sorted(want)
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList())
    before = {stages().apply(i).stageId() for i in range(stages().size())}
    got.count()
    new = [x for x in map(stages().apply, range(stages().size())) if x.stageId() not in before]
    assert new and sum(x.shuffleWriteRecords() for x in new) < 1000


def test_forward_pairs_reach_five_and_respect_the_gap(spark):
    m = spark.createDataFrame([(1, 3 * i, 3 * i + 1, f"e{i}") for i in range(8)], "sid long, start int, end int, wdid string")
    rel = spark.createDataFrame([(f"e{i}", f"e{j}", "p") for i in range(8) for j in range(8) if i < j], "h string, t string, pid string")
    got = T.forward_pairs(m, rel, distance=8)
    assert {(r.start, r.end) for r in got.collect()} == {(3 * i + 1, 3 * j) for i in range(8) for j in range(i + 1, 8) if 3 * j - 3 * i - 1 <= 8}


def test_snippets_drop_marks_stop_words_and_length(spark):
    c = spark.createDataFrame([("p", "Born In", 1, 2), ("p", "born in", 1, 3), ("p", ", x", 1, 1), ("p", "of the", 1, 1), ("p", "a b c d e f", 1, 1)], "pid string, snippet string, direction int, cnt long")
    assert rows(T.filtered_snippets(c)) == [("p", "born in", 1, 5)]


def test_pairwise_cosine_equals_the_mean_of_all_pairs(spark):
    data = [(0, "a", [1.0, 0.0]), (1, "a", [1.0, 1.0]), (2, "b", [0.0, 2.0]), (3, "b", [3.0, 4.0])]
    cos = lambda x, y: sum(p * q for p, q in zip(x, y)) / math.hypot(*x) / math.hypot(*y)
    want = sum(cos(x[2], y[2]) for x in data[:2] for y in data[2:]) / 4
    got = V.pairwise_cosine(spark.createDataFrame(data, "id int, pid string, vec array<double>")).where("p1 = 'a'").first().score
    assert got == pytest.approx(want)


def test_average_precision_counts_ties_together(spark):
    s = spark.createDataFrame([("q", "a", 0.9), ("q", "b", 0.5), ("q", "c", 0.5), ("q", "d", 0.1)], "p1 string, p2 string, score double")
    truth = spark.createDataFrame([("q", "a"), ("q", "c")], "p1 string, p2 string")
    assert M.average_precision(s, truth).first().ap == pytest.approx((1 + 2 / 3) / 2)


def test_quota_comes_before_the_overlap_check(spark):
    df = spark.createDataFrame([(1, "a", "b", [1], [1]), (2, "a", "b", [1], [2]), (3, "a", "b", [1], [3])], "pos int, p1 string, p2 string, occs1 array<int>, occs2 array<int>")
    assert [r.pos for r in S.first_pairs_without_overlap(df, 2).collect()] == [2]


def test_proportional_split_follows_the_shares(spark):
    df = spark.createDataFrame([("g", i, i) for i in range(10)], "grp string, member int, order int")
    got = S.proportional_split(df, [("train", 0.6), ("dev", 0.2), ("test", 0.2)]).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 6, "dev": 2, "test": 2}


def test_padding_cuts_and_fills(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],)], "a array<int>")
    assert [r[0] for r in df.select(S.padded("a", 2)).collect()] == [[1, 2], [0, 0]]


def test_joins_on_a_relation_do_not_deal_by_relation(spark):
    """Few relations have all rows: a join on them takes the small side to the rows, at any size of the large side."""
    from strandline.operators import corpus as C
    from strandline.operators import hierarchy as H
    from strandline.operators import relations as R

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        occs = spark.createDataFrame([("a", "h", "t"), ("b", "h", "t"), ("b", "h", "u")], "pid string, h string, t string")
        edges = spark.createDataFrame([("a", "b")], "parent string, child string")
        types = spark.createDataFrame([("h", "x", 0, 0)], "entity string, type string, depth int, pos int")
        closed, keys = H.closure(edges), spark.createDataFrame([("a",), ("h",), ("t",)], "key string")
        graphs = spark.createDataFrame([("h", "h"), ("t", "t")], "root string, id string")
        found = [R.with_ancestors(occs, closed), R.without_descendants(occs, closed), H.populated(occs, edges), R.split_by_type(occs, types), C.with_subgraph_and_vector(occs, graphs, keys, 5)]
        for df in found:
            assert "BroadcastHashJoin [pid" in df._jdf.queryExecution().sparkPlan().toString()
            assert df.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
