"""The queries of the classifiers against the same models fitted and applied in one process, and repeated ids."""

import zlib

import numpy as np
import pandas as pd
import pytest

from strandline.llm import quality_fm, queries, toxicity
from strandline.llm.text_features import counted_words
from tests.llm.test_llm import said

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    return docs, labels


def test_quality_query_equals_one_process(spark, tables):
    docs, labels = tables
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in docs}
    train = [(i, t) for i, t in docs if i in labels and labels[i][0] is not None and not held[i]]
    row, column, value, raw = quality_fm.features([t for _, t in train])
    cuts = np.searchsorted(row, np.arange(len(train) + 1))
    rows = [(column[p:q].astype(np.int32), value[p:q].astype(np.float32)) for p, q in zip(cuts[:-1], cuts[1:], strict=True)]
    machine = quality_fm.fit(rows, raw.astype(np.float32), np.array([labels[i][0] > 0 for i, _ in train], dtype=np.float32))
    want = dict(zip([i for i, _ in docs], quality_fm.predict(machine, [t for _, t in docs]), strict=True))
    got = {r.doc_id: r for r in queries.op9_quality(spark, SMALL).collect()}
    assert got.keys() == want.keys()
    for i, r in got.items():
        assert r.score == pytest.approx(want[i], abs=1e-6) and r.held_out == held[i] and r.predicted == int(r.score >= quality_fm.THRESHOLD)


def test_toxicity_query_equals_one_process(spark, tables):
    docs, labels = tables
    train = [(i, t) for i, t in docs if i in labels and labels[i][1] is not None]
    owner, bucket, _ = counted_words([t for _, t in train], toxicity.BITS, toxicity.HEADS)
    frequent = np.bincount(bucket, minlength=1 << toxicity.BITS)[bucket] >= 4
    y = np.array([[labels[i][0] is not None and labels[i][0] <= 0, labels[i][1] > 0] for i, _ in train], dtype=float)
    fold = (pd.util.hash_array(np.array([i for i, _ in train])) % toxicity.FOLDS).astype(int)
    chain = toxicity.fit_chain(owner[frequent].astype(np.int32), bucket[frequent].astype(np.int32), y, fold)
    want = dict(zip([i for i, _ in docs], toxicity.predict_chain(chain, [t for _, t in docs]), strict=True))
    got = {r.doc_id: r for r in queries.op5_toxicity(spark, SMALL).collect()}
    assert got.keys() == want.keys()
    for i, r in got.items():
        assert (r.p_junk, r.p_toxic) == pytest.approx(tuple(want[i]), abs=1e-6) and r.toxic == (r.p_toxic >= toxicity.THRESHOLD)


def test_repeated_ids_are_learned_by_their_smallest_text(spark):
    rows = [(i, said(30, i) + (" vile scum" if i % 3 == 0 else "")) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    schema = "doc_id long, text string"
    plain = spark.createDataFrame(rows, schema)
    more = spark.createDataFrame(rows + [(i, "~ " + said(40, 900 + i)) for i in range(60) for _ in range(3)], schema).repartition(5)
    for score, name in ((quality_fm.score_quality, "score"), (toxicity.score_toxicity, "p_toxic")):
        want = {(r.doc_id, round(r[name], 9)) for r in score(plain, labels).collect()}
        assert want <= {(r.doc_id, round(r[name], 9)) for r in score(more, labels).collect()}
