"""Data sets against plain versions and literal fixtures, and what holds for every query."""

import hashlib
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandline.operators import corpus as C
from strandline.operators import datasets as S
from strandline.operators import graph as G
from strandline.operators import hierarchy as H
from strandline.operators import relations as R_
from strandline.operators import text as T
from strandline.operators import vectors as V
from strandline.plans import catalog
from strandline.sources import writers as W
from tests.compare import oracle_rows

SMALL = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def digest(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def split_by_hand(edges, shares, seed=1, empty=False):
    own, out = defaultdict(set), []
    for p, c in edges:
        own[p].add(c)
    for p, children in own.items():
        order = sorted(children, key=lambda c: (digest(seed, p, c), c))
        drawn = lambda c: S.SPLITS[0 if (x := int(digest(seed + 1, p, c)[:8], 16) / 2**32) < shares[0] else 1 if x < shares[0] + shares[1] else 2]  # noqa: B023, E731
        n, dealt = [math.floor(len(order) * s) for s in shares], {}
        for i, c in enumerate(order):
            dealt[c] = "train" if i < n[0] else "dev" if i < n[0] + n[1] else "test" if i < sum(n) else drawn(c)
        if len(set(dealt.values())) < 3:
            dealt = {c: drawn(c) for c in order}
        if empty or len(set(dealt.values())) == 3:
            out += [(p, c, s) for c, s in dealt.items()]
    return sorted(out)


EDGES = [("a", f"c{i}") for i in range(17)] + [("b", f"c{i}") for i in range(3, 8)] + [("d", "e"), ("d", "f"), ("d", "e"), ("c1", "g")]


@pytest.mark.parametrize("empty", [False, True])
def test_tiers_are_split_by_rounded_shares(spark, empty):
    edges = spark.createDataFrame(EDGES, "parent string, child string")
    assert rows(S.split_within(edges, (0.6, 0.2, 0.2), empty_splits=empty), "parent", "child", "split") == split_by_hand(EDGES, (0.6, 0.2, 0.2), empty=empty)
    known = spark.createDataFrame([("a",), ("c1",), ("c2",), ("g",)], "pid string")
    got = rows(S.split_within(edges, (0.6, 0.2, 0.2), known, empty_splits=True), "parent", "child")
    assert got == [("a", "c1"), ("a", "c2"), ("c1", "g")]
    one = S.split_within(edges, (0.6, 0.2, 0.2), one_by_one=True)
    counts = {(r["parent"], r["split"]): r["count"] for r in one.groupBy("parent", "split").count().collect()}
    # The next child goes to the split that lags most: of 17 each has its share to within one.
    assert all(abs(counts["a", s] - 17 * x) <= 1 for s, x in zip(S.SPLITS, (0.6, 0.2, 0.2))) and ("d", "train") not in counts


def test_whole_trees_are_split(spark):
    edges = [(f"r{i}", f"r{i}x") for i in range(10)] + [("r3x", "deep"), ("r4", "deep")]
    order = sorted((f"r{i}" for i in range(10)), key=lambda r: (digest(1, r), r))
    of = {r: "train" if i < 6 else "dev" if i < 8 else "test" for i, r in enumerate(order)}
    got = {r.pid: r.split for r in S.split_by_tree(spark.createDataFrame(edges, "parent string, child string"), (0.6, 0.2, 0.2)).collect()}
    assert all(got[f"r{i}"] == got[f"r{i}x"] == of[f"r{i}"] for i in range(10))
    assert got["deep"] == min((of["r3"], of["r4"]), key=("test", "dev", "train").index) and len(got) == 21


def test_pairs_of_a_split_and_against_train(spark):
    splits = spark.createDataFrame([("a", "train"), ("b", "train"), ("c", "dev"), ("d", "dev")], "pid string, split string")
    siblings = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("a", "c")], "a string, b string")
    assert rows(S.sibling_pairs(splits, siblings), "split", "p1", "p2", "label") == [("dev", "c", "d", 0), ("train", "a", "b", 1)]
    assert rows(S.sibling_pairs(splits, siblings, with_train=True), "p1", "p2", "label") == [("a", "b", 1), ("c", "a", 1), ("c", "b", 0), ("c", "d", 0), ("d", "a", 0), ("d", "b", 0)]
    ids = spark.createDataFrame([("a",), ("b",)], "pid string")
    assert rows(S.in_both(siblings.toDF("p1", "p2"), ids), "p1", "p2") == [("a", "b"), ("b", "a")]


def test_weights_are_fitted_on_one_split(spark):
    train = [("d1", "P1", 2), ("d1", "P2", 1), ("d2", "P1", 1), ("d2", "9", 5)]
    counts = spark.createDataFrame(train, "doc string, term string, cnt long")
    documents = spark.createDataFrame([("d1",), ("d2",), ("d3",)], "doc string")
    idf = S.fitted_idf(counts, documents)
    want = {"P1": math.log(4 / 3) + 1, "P2": math.log(4 / 2) + 1}  # a term of one character is none
    assert {r.term: r.idf for r in idf.collect()} == pytest.approx(want)
    dev = spark.createDataFrame([("x", "P1", 3), ("x", "P2", 1), ("x", "P7", 9), ("y", "P7", 1)], "doc string, term string, cnt long")
    a, b = 3 * want["P1"], want["P2"]
    assert {r.term: r.weight for r in S.weighted_by(dev, idf).collect()} == pytest.approx({"P1": a / math.hypot(a, b), "P2": b / math.hypot(a, b)})


def test_terms_around_samples_leave_out_their_own_root(spark):
    occs = spark.createDataFrame([("s", "P1_a", "h", "t"), ("s", "P1_a", "h", "u")], "sample string, pid string, h string, t string")
    triples = spark.createDataFrame([("h", "P1", "x"), ("h", "P2", "x"), ("h", "P2", "y"), ("t", "P3_b", "x"), ("t", "P1_c", "x")], "h string, r string, t string")
    assert rows(S.neighbour_terms(occs, triples), "doc", "term", "cnt") == [("s", "P2", 4), ("s", "P3_b", 1)]


def test_contexts_lie_between_single_spans(spark):
    tokens = "w0 w1 w2 w3 w4 w5 w6 w7".split()
    data = [("P1", "a", "b", [0], [3], tokens), ("P1", "a", "c", [5, 6], [1, 2], tokens), ("P1", "a", "d", [0], [1], tokens), ("P1", "a", "e", [0], [7], tokens), ("P2", "a", "b", [2], [2], tokens)]
    sentences = spark.createDataFrame(data, "pid string, h string, t string, h_span array<int>, t_span array<int>, tokens array<string>")
    assert rows(S.sentence_contexts(sentences, 3), "pid", "word", "cnt") == [("P1", "w1", 1), ("P1", "w2", 1), ("P1", "w3", 1), ("P1", "w4", 1)]
    assert rows(S.sentence_contexts(sentences, 3, most=1), "word") == [("w1",), ("w2",)]
    vocabulary = spark.createDataFrame([("w1", 7), ("w3", 9)], "word string, ind int")
    samples = spark.createDataFrame([("s1", "P1_x"), ("s2", "P9")], "sample string, pid string")
    assert rows(S.known_bags(S.sentence_contexts(sentences, 3), vocabulary, samples), "sample", "ind", "cnt") == [("s1", 0, 2), ("s1", 7, 1), ("s1", 9, 1)]


def test_roots_of_split_relations(spark):
    edges = spark.createDataFrame([("P1", "P1_a"), ("P1", "P1_b"), ("P2", "P2_a"), ("P2", "P1_a")], "parent string, child string")
    assert rows(S.all_of_one_root(edges), "parent", "split") == [("P1", True), ("P2", False)]


def test_rank_tables_and_sample_lines(spark):
    ranked = spark.createDataFrame([("b", 1, "x", 0.5, "parent"), ("b", 2, "y", 0.126, "*"), ("a", 1, "y", 1.0, "*"), ("b", 3, "z", 0.1, "*")], "p1 string, rank int, p2 string, score double, rel string")
    assert [r.value for r in W.rank_table(ranked, 2).orderBy("nth").collect()] == ["query,pos_0,pos_1", '"a","y" 1.00 *', '"b","x" 0.50 parent,"y" 0.13 *']
    names = spark.createDataFrame([("a", "Alpha"), ("y", "Ypsilon")], "pid string, name string")
    assert [r.value for r in W.rank_table(ranked, 1, names).orderBy("nth").collect()] == ["query,pos_0", '"Alpha","Ypsilon" 1.00 *', '"b","x" 0.50 parent']
    assert W.rank_table(ranked.limit(0), 2).count() == 0
    pairs = spark.createDataFrame([(1, "p", [("h", "t"), ("i", "u")], "q", [])], "label int, p1 string, occs1 array<struct<h:string,t:string>>, p2 string, occs2 array<struct<h:string,t:string>>")
    assert rows(W.pointwise_lines(pairs), "value") == [("1\tp h t i u\tq",)]
    labels = spark.createDataFrame([("p", 0), ("none", 1)], "label string, ind int")
    assert rows(W.label_occs_lines(labels, pairs.select(F.col("p1").alias("pid"), F.col("occs1").alias("occs"))), "value") == [("0\tp h t i u",), ("1\tnone",)]


def test_prompts_that_only_a_path_gives(spark):
    prompts = spark.createDataFrame([("[X] of [Y] .", 99), ("the [X] of [Y] .", 10), ("[Y] is [X] here", 12), ("the [X] Of [Y]", 50), ("in [X] by [Y]", 9)], "prompt string, cnt int")
    assert rows(C.only_by_path(prompts), "prompt") == [("[Y] is [X] here",), ("the [X] of [Y] .",)]
    tokens = spark.createDataFrame([(1, "a"), (2, "b"), (1, "c")], "sid int, tok string")
    assert rows(C.tokens_of(tokens, spark.createDataFrame([(1,), (1,)], "sid int")), "tok") == [("a",), ("c",)]


def test_every_query_has_rows():
    assert [n for n, sql in catalog.oracle_sql().items() if not oracle_rows(sql, SMALL)[1]] == []


def test_every_query_reads_the_tables(spark, tmp_path):
    """On a folder without tables each raises, so none runs on made-up rows."""
    ran = []
    for name, query in catalog.queries().items():
        try:
            query(spark, str(tmp_path / "none")).count()
            ran.append(name)
        except Exception as e:  # noqa: BLE001
            assert "PATH_NOT_FOUND" in str(e), (name, e)
    assert ran == []


def test_bags_of_snippets_count_each_snippet_once(spark):
    counts = spark.createDataFrame([("P1", "born in old town", 1, 9), ("P1", "born in old town", -1, 3), ("P1", "old old", 1, 1), ("P2", "the", 1, 1)], "pid string, snippet string, direction int, cnt long")
    assert rows(T.snippet_bags(counts), "pid", "word", "cnt") == [("P1", "born", 2), ("P1", "old", 4), ("P1", "town", 2)]


def test_words_that_differ_in_both_splits(spark):
    train = spark.createDataFrame([("a", "x", 9), ("b", "x", 1), ("a", "y", 2), ("b", "z", 5)], "pid string, word string, cnt long")
    test = spark.createDataFrame([("a", "x", 3), ("b", "z", 1), ("a", "w", 2)], "pid string, word string, cnt long")
    pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    assert rows(T.words_that_differ(train, test, pairs, 2), "word", "train_gap", "test_gap") == [("x", 8, 3)]
    assert rows(T.words_that_differ(train, test, pairs, 3), "word", "train_gap", "test_gap") == [("x", 8, 3), ("z", -5, -1)]


def written_records(spark):
    """Records written to shuffles so far."""
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_words_that_differ_pairs_few_words(spark):
    """Twelve relations with rare words of their own, ties among the first, and one that has few words; a count comes in two rows."""
    r = random.Random(3)
    pids = [f"p{i:02d}" for i in range(12)]
    halves = []
    for _ in range(2):
        rare = [(p, f"{p}-{r.randrange(10**6)}", 1) for p in pids[1:] for _ in range(1500)]
        often = [(p, f"w{i:02d}", r.choice([20, 30, 40])) for p in pids[1:] for i in range(40)]
        halves.append(sorted({(p, w): (p, w, n) for p, w, n in rare + often + [("p00", "w01", 3), ("p00", "own", 2)]}.values()))
    pairs = [(a, b) for a in pids for b in pids if a < b]

    def first(rows_, a, b):
        gaps = defaultdict(int)
        for p, w, n in rows_:
            gaps[w] += n * ((p == a) - (p == b)) if p in (a, b) else 0
        said = {w for p, w, _ in rows_ if p in (a, b)}
        return {w: gaps[w] for w in sorted(said, key=lambda w: (-abs(gaps[w]), w))[:10]}

    want = []
    for a, b in pairs:
        x, y = first(halves[0], a, b), first(halves[1], a, b)
        want += [(a, b, w, x[w], y[w]) for w in x if w in y]
    given = [spark.createDataFrame([z for p, w, n in h for z in ([(p, w, n - 1), (p, w, 1)] if n > 1 else [(p, w, n)])], "pid string, word string, cnt long") for h in halves]
    before = written_records(spark)
    assert rows(T.words_that_differ(*given, spark.createDataFrame(pairs + pairs[:1], "a string, b string")), "a", "b", "word", "train_gap", "test_gap") == sorted(want)
    # Each word of a relation in each of its pairs would be 360,000.
    assert written_records(spark) - before < 120_000


def test_relations_back_over_a_samples_occurrences(spark):
    occs = spark.createDataFrame([("s", "P1", "a", "b"), ("s", "P1", "c", "d"), ("t", "P1", "a", "b")], "sample string, pid string, h string, t string")
    triples = spark.createDataFrame([("b", "P2", "a"), ("d", "P2", "c"), ("b", "P1", "a"), ("a", "P3", "b")], "h string, r string, t string")
    assert rows(R_.parallel_by_sample(occs, triples, 2), "sample", "r", "cnt") == [("s", "P2", 2)]


def test_unread_surroundings_raise(spark):
    occs = spark.createDataFrame([("P1", "a", "b")], "pid string, h string, t string")
    triples = spark.createDataFrame([("a", "P2", "c")], "h string, r string, t string")
    roots = spark.createDataFrame([("a",)], "entity string")
    with pytest.raises(ValueError, match="no surroundings were read for b"):
        G.edge_features(occs, triples, roots)
    assert G.edge_features(occs, triples, roots.unionAll(spark.createDataFrame([("b",)], "entity string"))).count() == 2


def test_hierarchy_statistics_and_own_vectors(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("b", "e"), ("a", "b")], "parent string, child string")
    assert tuple(H.statistics(edges).first()) == (2, 4, 6) and tuple(H.statistics(edges.limit(0)).first()) == (0, 0, 0)
    entities = spark.createDataFrame([("a", [1.0]), ("x", [2.0])], "entity string, vec array<double>")
    assert rows(V.own_vectors(edges.select(F.col("parent").alias("pid")), entities), "pid", "vec") == [("a", [1.0])]


def test_rank_table_rounds_the_exact_value(spark):
    """0.495 is a little less in binary and 0.505 a little more; 0.125 and 0.375 are exact and go to the even side."""
    scores = [0.495, 0.505, 0.125, 0.375, 0.515, 0.29, 1.0, 0.0, -0.495, 0.285, 2.675]
    ranked = spark.createDataFrame([("q", i + 1, "c", x, "*") for i, x in enumerate(scores)], "p1 string, rank int, p2 string, score double, rel string")
    line = W.rank_table(ranked, 20).where("nth = 1").first().value
    assert [x.split(" ")[1] for x in line.split(",")[1:]] == [f"{x:.2f}" for x in scores]


def _shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning")


def test_edges_around_occurrences_come_once_without_a_last_shuffle(spark):
    triples = spark.createDataFrame([("a", "P1", "b"), ("a", "P1", "b"), ("a", "P2", "b"), ("a", "P2", "c"), ("b", "P1", "d"), ("b", "P3", "a")], "h string, r string, t string")
    occs = spark.createDataFrame([("P1", "a", "b"), ("P1", "a", "b"), ("P2", "a", "b")], "pid string, h string, t string")
    want = [("P1", "head", "a", "b"), ("P1", "head", "a", "c"), ("P1", "one", "a", "b"), ("P1", "tail", "b", "a"), ("P2", "head", "a", "b"), ("P2", "one", "a", "b"), ("P2", "tail", "b", "a"), ("P2", "tail", "b", "d")]
    found = G.edge_features(occs, triples)
    assert rows(found, "pid", "kind", "src", "dst") == want
    # Nothing is made distinct after the union.
    assert found._jdf.queryExecution().optimizedPlan().nodeName() == "Union"


def test_pairs_of_samples_are_dealt_once(spark):
    occs = spark.createDataFrame([("s", "P1", "a", "b")] * 2, "sample string, pid string, h string, t string")
    triples = spark.createDataFrame([("b", "P2", "a")] * 2 + [("b", "P1", "a")], "h string, r string, t string")
    found = R_.parallel_by_sample(occs, triples, 1)
    assert rows(found, "sample", "r", "cnt") == [("s", "P2", 1)]
    assert _shuffles(R_.parallel_by_sample(occs, triples, 1)) <= 3


def test_counts_of_terms_are_made_once(spark, monkeypatch):
    from strandline.plans import dataset_queries as Q

    made = []
    real = Q.S.neighbour_terms
    monkeypatch.setattr(Q.S, "neighbour_terms", lambda *a: made.append(1) or real(*a))
    assert Q.CATALOG["tfidf_fitted"][0](spark, "/root/testdata/sf0.001").count() > 0
    assert len(made) == 1


def test_rows_are_limited_in_their_tasks_before_popularity_is_ranked(spark):
    occs = spark.createDataFrame([("P1", f"h{i % 7}", f"t{i}") for i in range(400)], "pid string, h string, t string")
    popularity = spark.createDataFrame([(f"h{i}", i + 1) for i in range(7)] + [(f"t{i}", 1 + i % 3) for i in range(300)], "entity string, cnt long")
    one, other = R_.downsample_by_popularity(occs, popularity), R_.downsample_by_popularity(occs, popularity, large=5)
    assert rows(one, "pid", "h", "t") == rows(other, "pid", "h", "t") and one.count() == 200
    assert "WindowGroupLimit" in one._jdf.queryExecution().executedPlan().toString()


def test_large_relations_are_numbered_without_repeats_or_checkpoints(spark, monkeypatch):
    """Ranges are kept as a compressed table, and rows that repeat are dealt with them."""
    monkeypatch.setattr(R_, "checkpointed", None)
    pairs = spark.createDataFrame([(f"P{i % 3}", f"h{i * 7 % 50:02d}", f"t{i % 11}") for i in range(900)], "pid string, h string, t string")
    sizes = pairs.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    one, other = (R_.numbered(pairs, sizes, ["h", "t"], "nth", large, distinct=True) for large in (10, 1000))
    assert rows(one, "pid", "h", "t", "nth") == rows(other, "pid", "h", "t", "nth") and one.count() == pairs.distinct().count()
    assert "parquet" in one._jdf.queryExecution().executedPlan().toString().lower()


def test_what_is_around_an_entity_is_dealt_as_one_row(spark):
    """Terms with a colon, repeats, and a null relation, which is no term; after the exchange by sample nothing is dealt again."""
    occs = spark.createDataFrame([("s", "P1", "a", "b"), ("s", "P1", "a", "c"), ("u", "P2", "b", "zz")], "sample string, pid string, h string, t string")
    triples = spark.createDataFrame([("a", "P:2", "x"), ("a", "P:2", "x"), ("a", None, "x"), ("b", "P2_k", "y"), ("b", "3:", "y"), ("c", "P1_k", "y")], "h string, r string, t string")
    found = S.neighbour_terms(occs, triples)
    assert rows(found, "doc", "term", "cnt") == [("s", "3:", 1), ("s", "P2_k", 1), ("s", "P:2", 4), ("u", "3:", 1)]
    assert _shuffles(S.neighbour_terms(occs, triples)) <= 4
