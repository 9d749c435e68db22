"""Toxicity by a classifier chain: linear models in sequence, each fed the earlier categories' out-of-fold probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import bounded_batches, one_text_per_id, portions
from strandline.llm.text_features import counted_words, hashed_words

BITS, HEADS = 18, (4, 5, 6)
#: Labelled rows that the chain is fitted on at most: those of the smallest hashes of their ids.
SAMPLE_ROWS = 6_000
#: Categories in the chain's order, those that the labels have: junk text (quality 0) and toxic text.
CATEGORIES = ("junk", "toxic")
THRESHOLD = 0.5
FOLDS = 5


@dataclass
class LinearModel:
    """A logistic model on a few thousand hashed features and the earlier categories' logits."""

    buckets: np.ndarray
    weights: np.ndarray
    chain: np.ndarray
    bias: float


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit_linear(owner: np.ndarray, bucket: np.ndarray, earlier: np.ndarray, y: np.ndarray, most: int = 4000, steps: int = 250, l2: float = 2e-4) -> LinearModel:
    """Features are those most associated with the category by chi-squared; weights by Adam with a ridge."""
    n, positive = len(y), y.sum()
    if not 0 < positive < n:
        return LinearModel(np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(earlier.shape[1]), float(_logit(np.array([positive / max(n, 1)]))[0]))
    with_1 = np.bincount(bucket, y[owner], minlength=1 << BITS)
    seen = np.bincount(bucket, minlength=1 << BITS)
    expected = seen * positive / n
    chi = (with_1 - expected) ** 2 / np.maximum(expected * (1 - positive / n) * (1 - seen / n), 1e-9)
    chi[(seen < 4) | (seen > 0.9 * n)] = 0
    best = np.sort(np.argsort(-chi, kind="stable")[:most])
    best = best[chi[best] > 12]
    place = np.full(1 << BITS, -1, dtype=np.int64)
    place[best] = np.arange(len(best))
    keep = place[bucket] >= 0
    row, col = owner[keep], place[bucket[keep]]
    x = np.concatenate([np.zeros(len(best)), np.zeros(earlier.shape[1]), [_logit(np.array([positive / n]))[0]]])
    m, v = np.zeros_like(x), np.zeros_like(x)
    k = len(best)
    for t in range(1, steps + 1):
        z = np.bincount(row, x[col], minlength=n) + earlier @ x[k:-1] + x[-1]
        e = (_sigmoid(z) - y) / n
        g = np.concatenate([np.bincount(col, e[row], minlength=k) + l2 * x[:k], earlier.T @ e + l2 * x[k:-1], [e.sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return LinearModel(best, x[:k], x[k:-1], float(x[-1]))


def _apply(model: LinearModel, owner: np.ndarray, bucket: np.ndarray, earlier: np.ndarray, n: int) -> np.ndarray:
    dense = np.zeros(1 << BITS)
    dense[model.buckets] = model.weights
    return _sigmoid(np.bincount(owner, dense[bucket], minlength=n)[:n] + earlier @ model.chain + model.bias)


def fit_chain(owner: np.ndarray, bucket: np.ndarray, y: np.ndarray, fold: np.ndarray) -> list[LinearModel]:
    """The chain's models for the columns of y in their order. Later models see earlier categories as predicted out of fold."""
    n, earlier, chain = len(y), np.zeros((len(y), 0)), []
    for c in range(y.shape[1]):
        out_of_fold = np.zeros(n)
        for f in range(FOLDS):
            inside = fold != f
            renumber = np.cumsum(inside) - 1
            use = inside[owner]
            part = _fit_linear(renumber[owner[use]], bucket[use], earlier[inside], y[inside, c])
            out_of_fold[~inside] = _apply(part, owner, bucket, earlier, n)[~inside]
        chain.append(_fit_linear(owner, bucket, earlier, y[:, c]))
        earlier = np.column_stack([earlier, _logit(out_of_fold)])
    return chain


def predict_chain(chain: list[LinearModel], texts: list[str]) -> np.ndarray:
    """One column of probabilities a category."""
    bucket, owner = hashed_words(texts, BITS, HEADS)
    used = np.zeros(1 << BITS, dtype=bool)
    for m in chain:
        used[m.buckets] = True
    keep = used[bucket]
    both = np.unique((owner[keep] << BITS) | bucket[keep])
    owner, bucket = both >> BITS, both & ((1 << BITS) - 1)
    earlier, out = np.zeros((len(texts), 0)), []
    for m in chain:
        out.append(_apply(m, owner, bucket, earlier, len(texts)))
        earlier = np.column_stack([earlier, _logit(out[-1])])
    return np.column_stack(out) if out else np.zeros((len(texts), 0))


def _training_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for a, b in portions(texts):
            owner, bucket, _ = counted_words(texts[a:b], BITS, HEADS)
            cuts = np.searchsorted(owner, np.arange(b - a + 1))
            words = [bucket[cuts[i] : cuts[i + 1]].astype(np.int32).tobytes() for i in range(b - a)]
            yield pa.record_batch([batch.column(c).slice(a, b - a) for c in ("doc_id", "quality", "toxic")] + [pa.array(words, pa.binary())], ["doc_id", "quality", "toxic", "words"])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[LinearModel]:
    """Fit the chain on at most `sample_rows` labelled rows, drawn by hash of the id.

    Rows without an id or a toxic label aren't used, and of several texts of one id the smallest is; without any usable row there is no chain.
    """
    drawn = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    drawn = drawn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = one_text_per_id(docs, drawn).mapInArrow(_training_features, "doc_id long, quality int, toxic int, words binary").toPandas()
    rows = rows.sort_values("doc_id")
    if not len(rows):
        return []
    bucket = np.frombuffer(b"".join(rows["words"]), dtype=np.int32)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(w) // 4 for w in rows["words"]])
    rows = rows[["doc_id", "quality", "toxic"]]
    # Features of a few rows are never used.
    seen = np.bincount(bucket, minlength=1 << BITS)
    frequent = seen[bucket] >= 4
    owner, bucket = owner[frequent], bucket[frequent]
    toxic = (rows["toxic"].to_numpy() > 0).astype(float)
    junk = (rows["quality"].fillna(1).to_numpy() <= 0).astype(float)
    fold = (pd.util.hash_array(rows["doc_id"].to_numpy()) % FOLDS).astype(int)
    return fit_chain(owner, bucket, np.column_stack([junk, toxic]), fold)


def score_toxicity(docs: DataFrame, labels: DataFrame, labelled_docs: DataFrame | None = None, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Probabilities of the chain's categories for every document, by its whole text.

    Takes frames with doc_id and text, and labels with doc_id, quality, toxic. The chain is fitted on `labelled_docs` (default: docs).
    Returns doc_id, p_junk, p_toxic, toxic (p_toxic at or above `threshold`). Null texts are empty and score by the models'
    biases; null ids and repeated rows keep their rows; an empty table gives none. Without labels every probability is 0.
    """
    chain = docs.sparkSession.sparkContext.broadcast(train(labelled_docs if labelled_docs is not None else docs, labels, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in portions(texts):
                p = predict_chain(chain.value, texts[a:b]) if chain.value else np.zeros((b - a, len(CATEGORIES)))
                yield pa.record_batch([batch.column(0).slice(a, b - a), *[pa.array(p[:, j]) for j in range(len(CATEGORIES))]], ["doc_id", *[f"p_{c}" for c in CATEGORIES]])

    scored = bounded_batches(docs).selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, p_junk double, p_toxic double")
    return scored.withColumn("toxic", F.col("p_toxic") >= threshold)


def keep_clean(docs: DataFrame, labels: DataFrame, labelled_docs: DataFrame | None = None, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that aren't toxic; all their columns are unchanged, nulls and repeats included."""
    chain = docs.sparkSession.sparkContext.broadcast(train(labelled_docs if labelled_docs is not None else docs, labels, sample_rows))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            keep = np.ones(len(texts), dtype=bool)
            for a, b in portions(texts):
                if chain.value:
                    keep[a:b] = predict_chain(chain.value, texts[a:b])[:, 1] < threshold
            yield batch.filter(pa.array(keep))

    return bounded_batches(docs).mapInArrow(run, docs.schema)
