"""Exact duplicates: counting quotient filters, merged by sorted remainders, and byte verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import SPACE, join_group_facts, maybe_broadcast, shared_checkpoint, text_of, unused

#: Bits of a fingerprint that select its quotient (a block of the filter); the other 48 are its remainder.
QUOTIENT_BITS = 16
#: Fingerprints that a task gathers before it writes a filter.
FILTER_ROWS = 1 << 20
#: Ids with digests (120 bytes a row) that may be broadcast.
BROADCAST_KEYS = 200_000


def normalised(column: str = "text") -> Column:
    """The text without white space."""
    return F.regexp_replace(text_of(column), SPACE, "")


def _fingerprint(sha: Column) -> Column:
    """The first 64 bits of the digest, as a long."""
    return F.conv(F.substring(sha, 1, 16), 16, -10).cast("long")


def _build_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counting quotient filters of a task's fingerprints: for each quotient, the sorted remainders and their counts."""

    def written(parts: list[np.ndarray]) -> pa.RecordBatch:
        prints, counts = np.unique(np.concatenate(parts), return_counts=True)
        return _blocks(prints, counts.astype(np.int64))

    held, rows = [], 0
    for batch in batches:
        held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        rows += len(held[-1])
        if rows >= FILTER_ROWS:
            yield written(held)
            held, rows = [], 0
    if rows:
        yield written(held)


def _blocks(prints: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    quotient = (prints >> np.uint64(64 - QUOTIENT_BITS)).astype(np.int64)
    firsts = np.flatnonzero(np.diff(quotient, prepend=-1))
    lasts = np.append(firsts[1:], len(prints))
    remainder = prints & np.uint64((1 << (64 - QUOTIENT_BITS)) - 1)
    return pa.record_batch(
        {
            "quotient": pa.array(quotient[firsts].astype(np.int32)),
            "remainders": pa.array([remainder[a:b].tobytes() for a, b in zip(firsts, lasts, strict=True)], pa.binary()),
            "counts": pa.array([counts[a:b].tobytes() for a, b in zip(firsts, lasts, strict=True)], pa.binary()),
        }
    )


def _merge_filters(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One quotient's filters merged: equal remainders add their counts. Emits the fingerprints counted more than once."""
    prints, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    for batch in batches:
        more = [np.frombuffer(x, dtype=np.uint64) for x in batch.column("remainders").to_pylist()]
        n = [np.frombuffer(x, dtype=np.int64) for x in batch.column("counts").to_pylist()]
        prints, place = np.unique(np.concatenate([prints, *more]), return_inverse=True)
        merged = np.zeros(len(prints), dtype=np.int64)
        np.add.at(merged, place, np.concatenate([counts, *n]))
        counts = merged
    whole = (prints | (np.uint64(key[0].as_py()) << np.uint64(64 - QUOTIENT_BITS)))[counts > 1]
    yield pa.record_batch({"fp": pa.array(whole.view(np.int64)), "n": pa.array(counts[counts > 1])})


def repeated_fingerprints(skeleton: DataFrame) -> DataFrame:
    """Fingerprints (fp, n) that occur more than once among the rows' `fp`."""
    blocks = skeleton.select("fp").mapInArrow(_build_filters, "quotient int, remainders binary, counts binary")
    return blocks.groupBy("quotient").applyInArrow(_merge_filters, "fp long, n long")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document with the group of texts that are equal without white space.

    Takes any frame with doc_id and text. Returns doc_id, keep_id, group_size, kept, text_sha256, n_chars (code points of the
    original text). Of a group, the row with the most code points stays, then the smallest doc_id.

    Null or empty texts equal each other. A null doc_id loses every tie; a group of rows without ids has a null keep_id and keeps
    them all. Rows that repeat an id and text of the row that stays are kept with it. An empty table gives no rows; further
    columns are ignored.
    """
    prints = docs.select("doc_id", F.length(text_of()).cast("long").alias("n_chars"), F.sha2(normalised(), 256).alias("text_sha256"))
    prints = shared_checkpoint(prints.withColumn("fp", _fingerprint(F.col("text_sha256"))))

    repeated = shared_checkpoint(repeated_fingerprints(prints).select("fp"))
    bodies = docs.select("doc_id", F.length(text_of()).alias("n_chars"), normalised().alias("body"))
    bodies = bodies.withColumn("fp", _fingerprint(F.sha2("body", 256))).join(maybe_broadcast(repeated, repeated.count()), "fp", "left_semi")
    # One decimal orders by code points, then by smaller id; rows without an id come last among equals.
    rank = F.col("n_chars").cast("decimal(10,0)") * F.expr("100000000000000000000bd") - F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.expr("10000000000000000000bd"))
    verified = bodies.groupBy("fp", "body").agg(F.count(F.lit(1)).alias("group_size"), F.max_by("doc_id", rank).alias("keep_id"))
    facts = shared_checkpoint(verified.where("group_size > 1").select(F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size"))

    out = join_group_facts(prints.drop("fp"), facts, "text_sha256", "group_size")
    return out.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull() | F.col("keep_id").isNull(), True).otherwise(F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False))).alias("kept"),
        "text_sha256",
        "n_chars",
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The documents without the copies that `exact_groups` drops, one row of each group; their columns are unchanged.

    Of rows that repeat the staying row's id, and of a group whose rows all lack an id, a longest one stays. Null and empty
    texts are one group; an empty table gives no rows. Only ids and digests of copies are gathered; where those are few, texts aren't shuffled.
    """
    ident, sha, size, row = unused(docs, "ident", "sha", "size", "row")
    decided = shared_checkpoint(exact_groups(docs).where("group_size > 1").select(F.col("doc_id").alias(ident), F.col("text_sha256").alias(sha), "kept"))
    gone = decided.where("not kept").drop("kept").distinct()
    again = decided.where("kept").groupBy(ident, sha).agg(F.count(F.lit(1)).alias(size)).where(F.col(size) > 1).drop(size)
    marked = docs.withColumn(sha, F.sha2(normalised(), 256))

    def same(keys: DataFrame):
        return F.col("doc_id").eqNullSafe(keys[ident]) & (marked[sha] == keys[sha])

    left = marked.join(maybe_broadcast(gone, gone.count(), BROADCAST_KEYS), same(gone), "left_anti")
    repeats = again.count()
    if not repeats:
        return left.drop(sha)
    again = maybe_broadcast(again, repeats, BROADCAST_KEYS)
    # Summed in the tasks first, so a row that repeats often meets no other task as often.
    one = left.join(again, same(again), "left_semi").groupBy(F.col("doc_id"), sha).agg(F.max_by(F.struct(*docs.columns), F.length(text_of())).alias(row))
    return left.join(again, same(again), "left_anti").select(*docs.columns).unionByName(one.select(f"{row}.*"))
