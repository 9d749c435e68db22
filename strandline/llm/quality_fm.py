"""Text quality by a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import bounded_batches, one_text_per_id, portions
from strandline.llm.text_features import STATISTICS, counted_words, structure

BITS, RANK = 15, 8
#: Labelled rows that the machine is fitted on at most: those of the smallest hashes of their ids.
SAMPLE_ROWS = 6_000
EPOCHS, BATCH = 12, 256
THRESHOLD = 0.3
#: Buckets of metadata (a text's length in powers of two), after the words and the statistics.
LENGTHS = 32
WIDTH = (1 << BITS) + len(STATISTICS) + LENGTHS


@dataclass
class Machine:
    """score = sigmoid(bias + sum w x + sum over pairs of <v_i, v_j> x_i x_j)."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    centre: np.ndarray
    spread: np.ndarray


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (row, column, value) and the raw statistics of some texts. A text's words have unit length together."""
    owner, bucket, count = counted_words(texts, BITS)
    x = np.log1p(count).astype(np.float32)
    norm = np.sqrt(np.bincount(owner, x * x, minlength=len(texts)))
    chars = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    size = (1 << BITS) + len(STATISTICS) + np.minimum(np.log2(chars + 1), LENGTHS - 1).astype(np.int64)
    row = np.concatenate([owner, np.arange(len(texts))])
    column = np.concatenate([bucket, size])
    value = np.concatenate([x / np.maximum(norm[owner], 1e-9), np.full(len(texts), 0.5)]).astype(np.float32)
    order = np.argsort(row, kind="stable")
    return row[order], column[order], value[order], structure(texts)


def _with_statistics(m: Machine, row: np.ndarray, column: np.ndarray, value: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw)
    scaled = np.clip((raw - m.centre) / m.spread, -4, 4).astype(np.float32) / 2
    places = np.tile(np.arange(1 << BITS, (1 << BITS) + len(STATISTICS)), n)
    r, c, x = np.concatenate([row, np.repeat(np.arange(n), len(STATISTICS))]), np.concatenate([column, places]), np.concatenate([value, scaled.ravel()])
    order = np.argsort(r, kind="stable")
    return r[order], c[order], x[order]


def _sums(row: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
    """Sums of the terms by row; every row has terms, in order."""
    return np.add.reduceat(terms, np.searchsorted(row, np.arange(n)), axis=0)


def raw_scores(m: Machine, row: np.ndarray, column: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores before the sigmoid, in time linear in the features: pairs sum to half of (sum v x)^2 - sum (v x)^2."""
    vx = m.v[column] * x[:, None]
    s = _sums(row, vx, n)
    pairs = 0.5 * ((s * s).sum(1) - _sums(row, (vx * vx).sum(1), n))
    return m.bias + _sums(row, m.w[column] * x, n) + pairs, s


def fit(rows: list[tuple[np.ndarray, np.ndarray]], raw: np.ndarray, y: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> Machine:
    """Fit by Adam on batches. rows: each text's columns and values, without the statistics, which are `raw`."""
    random = np.random.default_rng(seed)
    centre, spread = raw.mean(0), raw.std(0) + 1e-6
    base = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    m = Machine(float(np.log(base / (1 - base))), np.zeros(WIDTH, dtype=np.float32), random.normal(0, 0.02, (WIDTH, RANK)).astype(np.float32), centre, spread)
    if not len(y) or y.min() == y.max():
        m.v[:] = 0
        return m
    moments = [np.zeros((WIDTH, RANK + 1), dtype=np.float32) for _ in range(2)]
    bias_rate, rate = 0.02, 0.01
    for epoch in range(epochs):
        order = random.permutation(len(y))
        for at in range(0, len(y), BATCH):
            pick = order[at : at + BATCH]
            n = len(pick)
            row = np.repeat(np.arange(n), [len(rows[i][0]) for i in pick])
            column = np.concatenate([rows[i][0] for i in pick]).astype(np.int64)
            value = np.concatenate([rows[i][1] for i in pick])
            row, column, x = _with_statistics(m, row, column, value, raw[pick])
            z, s = raw_scores(m, row, column, x, n)
            e = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / n).astype(np.float32)
            ex = e[row] * x
            g = np.concatenate([ex[:, None], ex[:, None] * (s[row] - m.v[column] * x[:, None])], axis=1)
            touched, place = np.unique(column, return_inverse=True)
            by = np.argsort(place, kind="stable")
            g = np.add.reduceat(g[by], np.searchsorted(place[by], np.arange(len(touched))), axis=0)
            g[:, 0] += 1e-5 * m.w[touched]
            g[:, 1:] += 1e-4 * m.v[touched]
            moments[0][touched] = 0.9 * moments[0][touched] + 0.1 * g
            moments[1][touched] = 0.99 * moments[1][touched] + 0.01 * g * g
            step = rate * moments[0][touched] / (np.sqrt(moments[1][touched]) + 1e-7)
            m.w[touched] -= step[:, 0]
            m.v[touched] -= step[:, 1:]
            m.bias -= bias_rate * float(e.sum())
        rate *= 0.85
    return m


def predict(m: Machine, texts: list[str]) -> np.ndarray:
    row, column, value, raw = features(texts)
    row, column, x = _with_statistics(m, row, column, value, raw)
    z, _ = raw_scores(m, row, column, x, len(texts))
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def held_out() -> F.Column:
    """Rows whose labels aren't learned: crc32 of the id as text is divisible by 5. A null id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for a, b in portions(texts):
            row, column, value, raw = features(texts[a:b])
            cuts = np.searchsorted(row, np.arange(b - a + 1))
            parts = [(column[p:q].astype(np.int32).tobytes(), value[p:q].tobytes()) for p, q in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.record_batch(
                [batch.column("doc_id").slice(a, b - a), batch.column("quality").slice(a, b - a), *[pa.array([x[j] for x in parts], pa.binary()) for j in (0, 1)], pa.array([x.tobytes() for x in raw], pa.binary())],
                ["doc_id", "quality", "columns", "values", "raw"],
            )


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Fit on at most `sample_rows` labelled rows that aren't held out, drawn by hash of the id. Of several texts of one id the smallest counts."""
    drawn = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    drawn = drawn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    got = one_text_per_id(docs, drawn).mapInArrow(_training_rows, "doc_id long, quality int, columns binary, values binary, raw binary").toPandas()
    got = got.sort_values("doc_id")
    rows = [(np.frombuffer(c, dtype=np.int32), np.frombuffer(v, dtype=np.float32)) for c, v in zip(got["columns"], got["values"], strict=True)]
    raw = np.array([np.frombuffer(x, dtype=np.float32) for x in got["raw"]]) if len(got) else np.zeros((1, len(STATISTICS)), dtype=np.float32)
    return fit(rows, raw, (got["quality"].to_numpy() > 0).astype(np.float32))


def score_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Quality of every document by its whole text: doc_id, held_out, score (0 to 1, higher is better), predicted.

    Takes frames with doc_id and text, and labels with doc_id and quality; neither labels nor language, source or id are inputs of a
    score. Null texts are empty and score like empty texts. Null ids count as held out; repeated rows score alike; an empty table gives
    no rows. Without labels every score is the prior, a half.
    """
    machine = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in portions(texts):
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(predict(machine.value, texts[a:b]))], ["doc_id", "score"])

    scored = bounded_batches(docs).selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
