"""Readers and writers on small literal files, and the streaming counts."""

import bz2
import gzip
import json

import pytest
from pyspark.sql import functions as F

from strandline.plans import source_queries
from strandline.sources import readers as R
from strandline.sources import writers as W
from strandline.streaming import counts


def put(path, text):
    path.write_text(text)
    return str(path)


def test_occurrences_filter_before_the_limit(spark, tmp_path):
    path = put(tmp_path / "P1.txt", "Q1\tQ2\nx\tQ2\nQ3\tQ4\nQ3\tQ4\n")
    assert [(r.pid, r.h) for r in R.read_occurrences(spark, path, most=2).collect()] == [("P1", "Q1"), ("P1", "Q3")]


def test_hierarchy_labels_keep_commas(spark, tmp_path):
    path = put(tmp_path / "h", "P1,a, b\tP2,c\tP3,d,e\nP9,x\n")
    got = [tuple(r) for r in R.read_hierarchy(spark, path).collect()]
    assert got == [("P1", "a, b", "P2", "c", 0), ("P1", "a, b", "P3", "d,e", 1)]


def test_subgraphs_last_line_wins_and_empty_roots_stay(spark, tmp_path):
    path = put(tmp_path / "g", "Q1\tQ1 P1 Q2\nQ5\nQ1\tQ1 P2 Q3\tQ1 P2 Q4\n")
    got = {r.root: [(e.p, e.e2) for e in r.adj] for r in R.read_subgraphs(spark, path).collect()}
    assert got == {"Q1": [("P2", "Q3"), ("P2", "Q4")], "Q5": []}


def test_nway_quota_and_runs(spark, tmp_path):
    path = put(tmp_path / "n", "0\tP1 a b c d\n0\tP1 a b\n1\tP2 x y\n0\tP1 q r\n")
    assert [r.label for r in R.read_nway(spark, path, one_per_label=True).orderBy("pos").collect()] == [0, 1, 0]
    got = R.read_nway(spark, path, per_relation=1).orderBy("pos").collect()
    assert [(r.pid, len(r.occs)) for r in got] == [("P1", 2), ("P2", 1)]


def test_pointwise_drops_equal_relations(spark, tmp_path):
    path = put(tmp_path / "p", "1\tP1 a b\tP2 c d\n0\tP1 a b\tP1 c d\n")
    assert [(r.p1, r.p2, r.occs2[0].t) for r in R.read_pointwise(spark, path).collect()] == [("P1", "P2", "d")]


def test_bags_sentences_and_maps(spark, tmp_path):
    bags = R.read_bags(spark, put(tmp_path / "b", "1 2\t3 4\n\n5 6\n")).orderBy("sample_id").collect()
    assert [[tuple(x) for x in r.bag] for r in bags] == [[(1, 2), (3, 4)], [], [(5, 6)]]
    sents = R.read_sentences(spark, put(tmp_path / "s", "1 2\t7\t3\t1\n")).first().sents
    assert [(list(s.toks), s.cnt) for s in sents] == [([1, 2], 7), ([3], 1)]
    assert {r.key: r.val for r in R.read_map(spark, put(tmp_path / "m", "a\t1\n\na\t2\nb\t3\n")).collect()} == {"a": "2", "b": "3"}


def test_vectors_check_their_size(spark, tmp_path):
    path = put(tmp_path / "v", "<http://e/Q1>\t1\t2\n")
    assert [(r.id, list(r.vec)) for r in R.read_vectors(spark, path, 2, unwrap=True).collect()] == [("Q1", [1.0, 2.0])]
    with pytest.raises(Exception, match="not of size 3"):
        R.read_vectors(spark, path, 3).collect()


def test_linked_articles_and_relation_sentences(spark, tmp_path):
    line = {"url": "u", "id": [1], "text": "abc def", "annotations": [{"offset": 4, "surface_form": "def", "uri": "D"}]}
    (tmp_path / "a.json.bz2").write_bytes(bz2.compress(json.dumps(line).encode()))
    assert [(r.start, r.end, r.uri) for r in R.read_linked_articles(spark, str(tmp_path / "a.json.bz2")).collect()] == [(4, 7, "D")]
    sents = {"P1": [{"tokens": ["a", "b"], "h": ["a", "Q1", [[0]]], "t": ["b", "Q2", [[1]]]}, {"tokens": ["a"], "h": ["a", "Q1", [[0], [0]]], "t": ["b", "Q2", [[1]]]}]}
    got = R.read_relation_sentences(spark, put(tmp_path / "f.json", json.dumps(sents))).collect()
    assert [(r.pid, r.h, r.t, list(r.h_span)) for r in got] == [("P1", "Q1", "Q2", [0])]


def test_dump_respects_quotes(spark, tmp_path):
    with gzip.open(tmp_path / "d.sql.gz", "wt") as f:
        f.write("CREATE TABLE x;\nINSERT INTO `x` VALUES (1,0,'a,b'),(2,0,'c\\'),(d'),(3,1,'e'),(4,0);\n")
    got = R.read_dump(spark, str(tmp_path / "d.sql.gz"), ["id", "ns", "title"], {"ns": "0"}).collect()
    assert [(r.id, r.title) for r in got] == [("1", "a,b"), ("2", "c'),(d")]


def test_names_and_fallback(spark, tmp_path):
    known = spark.createDataFrame([("Q1",)], "entity string")
    got = R.read_names(spark, put(tmp_path / "n", "Q1\tOne\tEin||One\nQ2\tTwo\n"), known).collect()
    assert [(r.entity, list(r.names)) for r in got] == [("Q1", ["One", "Ein"])]
    a, b = spark.createDataFrame([("P1", 1)], "pid string, x int"), spark.createDataFrame([("P1", 2), ("P2", 3)], "pid string, x int")
    assert sorted(map(tuple, R.prefer(a, b).collect())) == [("P1", 1), ("P2", 3)]


def test_writers(spark, tmp_path):
    occs = spark.createDataFrame([("P1", "a", "b"), ("P2", "c", "d")], "pid string, h string, t string")
    W.write_by_relation(occs, str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).where("pid = 'P2'").select("h").first().h == "c"
    samples = occs.groupBy("pid").agg(F.collect_list(F.struct("h", "t")).alias("occs")).withColumn("label", F.lit(3))
    assert sorted(r.value for r in W.nway_lines(samples).collect()) == ["3\tP1 a b", "3\tP2 c d"]
    edges = spark.createDataFrame([("A", "B"), ("B", "C")], "parent string, child string")
    roots = spark.createDataFrame([("A",)], "pid string")
    assert [r.value for r in W.tree_lines(edges, roots).orderBy("path").collect()] == ["A", "\tB", "\t\tC"]


def test_streamed_popularity(spark, tmp_path):
    spark.createDataFrame([(1, 0, 1, "a"), (1, 3, 4, "a"), (2, 0, 1, "b")], "sid long, start int, end int, wdid string").write.parquet(str(tmp_path / "in"))
    q = counts.running_popularity(counts.stream_mentions(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("popularity").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.wdid, r.cnt) for r in spark.table("popularity").collect()} == {("a", 2), ("b", 1)}


def test_dump_head_keeps_its_lines_in_order(spark):
    """A shuffle gives lines in the order in which executors answer."""
    head = source_queries._dump_head(spark)
    assert head.rdd.getNumPartitions() == 1 and [r.value for r in head.collect()] == source_queries._DUMP_HEAD
    assert "Exchange" not in head._jdf.queryExecution().executedPlan().toString()
