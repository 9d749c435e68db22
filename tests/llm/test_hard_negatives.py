"""Hard negatives against brute force, on clustered, repeated and awkward vectors, and the trees by themselves."""

import random
from collections import defaultdict
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import hard_negatives, queries
from strandline.llm.hard_negatives import BlockTree, UpperTree

SMALL = "/root/testdata/sf0.001"


def by_hand(rows):
    """All rows of the result, from every pair of an anchor and another row."""
    kept = set()
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not isfinite(x) for x in vector):
            continue
        kept.add((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, tuple(floor(256 * float(np.float32(x))) for x in vector)))
    out = []
    for anchor, label, v in kept:
        if anchor % 100:
            continue
        same, other = [], []
        for r in kept:
            if r != (anchor, label, v):
                (same if r[1] == label else other).append((-sum(a * b for a, b in zip(v, r[2])), r[0]))
        other.sort()
        for below, positive in sorted(same)[:5]:
            fits = [(-s, i) for s, i in other if 80 * -below <= 100 * -s <= 100 * -below][:5]
            out += [(anchor, positive, n, i, -below, s) for n, (s, i) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cls", F.lit("x")).withColumn("score", F.lit(None).cast("int"))
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df).collect())


def vectors(n, seed, centres=6, width=8):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(centres, width))
    out = []
    for i in range(n):
        v = middle[i % centres] + r.normal(size=width) * 0.3
        v /= np.linalg.norm(v)
        out.append((i, [float(np.float32(x)) for x in v * r.choice([1, 1, 0.5, 2])], int(r.integers(0, 4))))
    return out


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op11_hard_negatives(spark, SMALL).collect())
    assert got == by_hand(rows) and len(got) > 50


def test_many_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROWS_IN_CELL", 60)
    monkeypatch.setattr(hard_negatives, "ROWS_IN_BLOCK", 40)
    rows = vectors(1500, 3)
    assert mined(spark, rows) == by_hand(rows)


def test_a_third_of_the_rows_share_a_vector(spark):
    """Rows of the hot vector are anchors, positives and negatives; ties go to the smaller ids."""
    rows = vectors(1200, 4)
    hot = rows[0][1]
    rows = [(i, hot if i % 3 == 0 else v, i % 2 if i % 3 == 0 else label) for i, v, label in rows]
    assert mined(spark, rows) == by_hand(rows)


def test_awkward_rows(spark):
    r = random.Random(2)
    rows = [(i, [r.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(r.choice([3, 3, 2, 0]))], r.randrange(2)) for i in range(320)]
    rows += [rows[0], rows[100], (400, None, 1), (None, [1.0, 0.0, 0.0], 1), (500, [1.0, None, 0.0], 1), (600, [float("nan"), 0.0, 1.0], 1), (700, [float("inf"), 0.0, 1.0], 0)]
    rows += [(800, [1.0, 1.0, 1.0], None), (100, [1.0, -1.0, 0.5], 1), (900, [-1.0, -1.0, -1.0], 9), (1000, [30000.0, 0.25, -7.5], 1), (1001, [30000.0, 0.25, -8.5], 1)]
    assert mined(spark, rows) == by_hand([(i, None if v is None else v + [0.0] * (3 - len(v)), x) for i, v, x in rows])


def test_empty_tables_and_lone_anchors(spark):
    assert mined(spark, [(None, None, None)]) == [] and mined(spark, [(100, [1.0, 0.0], 1)]) == []
    assert mined(spark, [(100, [1.0, 0.0], 1), (101, [1.0, 0.0], 1)]) == []
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.hard_negatives(df).count() == 0


def test_components_beyond_the_bound_take_no_part(spark):
    rows = [(100, [1.0, 0.0], 1), (101, [1.0, 0.0], 1), (102, [1.0, 0.0], 2), (103, [1e30, 0.0], 2)]
    assert mined(spark, rows) == [(100, 101, 1, 102, 65536, 65536)]


def test_window_and_shares_are_parameters(spark):
    df = spark.createDataFrame([(1, [4.0], 1), (2, [3.0], 1), (3, [2.0], 2), (4, [1.0], 2)], "vec_id long, embedding array<float>, label int")
    rows = hard_negatives.whole_vectors(df)
    got = hard_negatives.mine(rows, F.col("vec_id") == 1, low_percent=20, positives=1, negatives=1).collect()
    assert [tuple(r) for r in got] == [(1, 2, 1, 3, 786432, 524288)]


@pytest.mark.parametrize("seed", range(3))
def test_block_tree_finds_every_window(seed):
    r = np.random.default_rng(seed)
    v = r.integers(-60, 60, size=(900, 5))
    v[100:300] = v[0]
    labels, ids = r.integers(0, 3, size=900), [[i] for i in range(900)]
    tree = BlockTree(float((v * v).sum(axis=1).max()), v, labels, ids)
    queries, windows = r.integers(-60, 60, size=(40, 5)), ((None, None), (0, 3000), (2500, 2500), (-9000, -100))
    asked = [(q, same, *w) for q in queries for same in (True, False) for w in windows]
    ends = [np.array([fill if a[n] is None else a[n] for a in asked], dtype=float) for n, fill in ((2, -np.inf), (3, np.inf))]
    open_ = np.full(len(asked), -np.inf)
    found = tree.search(np.array([a[0] for a in asked]), np.ones(len(asked), dtype=int), np.array([a[1] for a in asked]), *ends, 5, open_)
    got = defaultdict(list)
    for q, score, vec_id, _ in zip(*(x.tolist() for x in found)):
        got[q].append((-score, vec_id))
    for n, (q, same, low, high) in enumerate(asked):
        want = sorted((-s, i) for i, s in enumerate((v @ q).tolist()) if (labels[i] == 1) == same and (low is None or low <= s <= high))[:5]
        assert got[n] == want


def test_upper_tree_places_by_distance():
    r = np.random.default_rng(1)
    v = r.normal(size=(500, 4))
    tree = UpperTree(v, float((v * v).sum(axis=1).max()), 3)
    cell, way = tree.place(v)
    sizes = defaultdict(int)
    for c in cell:
        sizes[int(c)] += 1
    assert len(sizes) == 8 and max(sizes.values()) < 110 and way.shape == (500, 3)
