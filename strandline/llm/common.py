"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
SPACE = "[\\x20\\x09-\\x0D]"

#: Rows above which an id set is joined by shuffle and no longer broadcast (8 bytes a row).
BROADCAST_ROWS = 1_000_000
#: Rows and bytes of an Arrow batch that holds texts.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20
#: Edges that a task of `components` takes.
EDGES_IN_TASK = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder. Where the session names none, a local master gets a temporary one, as in tests; a cluster has to name one that its executors share."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="strandline-"))
    return context._jsc.sc().getCheckpointDir().get()


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Write the rows to the folder named in spark.checkpoint.dir and read them back, so that nothing before is run again."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written_table(df: DataFrame) -> tuple[DataFrame, str]:
    """Write the rows as a compressed table in the shared folder, for texts, and read them back: the frame and the table's folder, for `remove_table`."""
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def remove_table(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def one_text_per_id(docs: DataFrame, drawn: DataFrame) -> DataFrame:
    """The text of each drawn row's document (doc_id, text, and the drawn columns), the smallest of several; `drawn` is a sample of bounded size, so it may be broadcast.

    Repeats go in Spark, in the tasks first, so what follows is no larger than the sample however often an id repeats.
    """
    names = [c for c in drawn.columns if c != "doc_id"]
    met = bounded_batches(docs).select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    return met.groupBy("doc_id", *names).agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def maybe_broadcast(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Mark the frame for broadcast if its counted rows allow it; beyond that Spark joins by shuffle."""
    return F.broadcast(df) if rows <= most else df


def bounded_batches(df: DataFrame) -> DataFrame:
    """The same frame, in a session whose Arrow batches are bounded in rows and bytes: a batch is held whole on both sides, and texts are long."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(conf.get(name).rstrip("bB")) <= most:
            conf.set(name, str(most))
    return df


def join_group_facts(rows: DataFrame, facts: DataFrame, key: str, size: str) -> DataFrame:
    """Left join of rows with one fact row a key, where one key may hold a third of the rows.

    `facts` (checkpointed by the caller) has `key`, `size` (the rows of that key) and further columns. Keys that hold over a
    thousandth of all rows are at most a thousand by arithmetic; those are broadcast, and their rows never
    shuffled. All others are small, and join by shuffle.
    """
    total = facts.agg(F.sum(size)).first()[0] or 0
    hot_from = max(total // 1000, 100)
    hot = facts.where(F.col(size) > hot_from)
    cold = facts.where(F.col(size) <= hot_from)
    names = [c for c in facts.columns if c != key]
    hot = hot.select(F.col(key).alias("_hot_key"), *[F.col(c).alias(f"_hot_{c}") for c in names])
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    near = out.where(F.col("_hot_key").isNotNull()).select(*rows.columns, *[F.col(f"_hot_{c}").alias(c) for c in names])
    far = out.where(F.col("_hot_key").isNull()).select(*rows.columns).join(cold, key, "left").select(*rows.columns, *names)
    return near.unionByName(far)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that the frame doesn't have."""
    held = {c.lower() for c in df.columns}
    return [next(x for x in (name + "_" * i for i in range(1, len(held) + 2)) if x not in held) for name in names]


def text_of(column: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(column), F.lit(""))


# --- words of many texts at once, as numpy arrays -----------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE_TABLE = np.zeros(256, dtype=bool)
_SPACE_TABLE[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True) + np.uint64(seed) * _ODD + _ODD
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_BYTE_CODES = mix64(np.arange(256, dtype=np.uint64), 77)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    if n > 1:
        with np.errstate(over="ignore"):
            np.multiply.accumulate(np.full(n - 1, base, dtype=np.uint64), out=out[1:])
    return out


_POWERS: dict[int, np.ndarray] = {}


def _grown(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = _POWERS[base] = _powers(base, max(n, 1 << 20))
    return have[:n]


def word_hashes(texts: list[str], stop: np.ndarray = _SPACE_TABLE, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Hashes of the words of some texts.

    Returns the 64-bit hash of each word, the text each belongs to, its first and past-the-end byte, and the joined bytes.
    Words are runs of bytes that `stop` doesn't mark; A-Z count as a-z if `lower`.
    """
    joined = "\n".join(texts).encode("utf-8", "surrogatepass")
    lengths = np.fromiter((len(t.encode("utf-8", "surrogatepass")) for t in texts), dtype=np.int64, count=len(texts))
    raw = np.frombuffer(joined, dtype=np.uint8)
    if not len(raw):
        e = np.zeros(0, dtype=np.int64)
        return e.astype(np.uint64), e, e, e, joined
    if lower:
        raw = _LOWER[raw]
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~stop[raw]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_CODES[raw] * _grown(_BASE, len(raw)), out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * _grown(_INVERSE, len(raw))[starts]
    ends_of_texts = np.cumsum(lengths + 1) - 1
    owner = np.searchsorted(ends_of_texts, starts, side="right")
    return mix64(hashes), owner, starts, ends, joined


def shingle_sets(texts: list[str], k: int = 5) -> list[np.ndarray]:
    """The set of k-word shingles of each text as sorted 64-bit hashes; a text of fewer words is one shingle, without words none."""
    words, owner, *_ = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    rolled = np.zeros(0, dtype=np.uint64)
    if len(words) >= k:
        with np.errstate(over="ignore"):
            rolled = np.zeros(len(words) - k + 1, dtype=np.uint64)
            for j in range(k):
                rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + words[j : len(words) - k + 1 + j]
        rolled = mix64(rolled, 5)
    out = []
    for i in range(len(texts)):
        a, b = bounds[i], bounds[i + 1]
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            with np.errstate(over="ignore"):
                h = np.uint64(b - a)
                for w in words[a:b]:
                    h = h * np.uint64(0xC2B2AE3D27D4EB4F) + w
            out.append(mix64(np.array([h], dtype=np.uint64), 9))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def portions(texts: list[str], most: int = 1 << 18):
    """Index ranges of consecutive texts of about `most` characters together, so that arrays stay small."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Smallest node reachable from each node of an undirected edge table: rows (node, component).

    Every node points to the smallest node it knows; each round takes the smallest pointer among the neighbours and then
    the pointer's pointer, until nothing changes. Both steps are joins on small rows, and only a count comes to the driver.
    """
    both = edges.select(F.col(left).alias("node"), F.col(right).alias("other"))
    both = shared_checkpoint(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).where("node <> other").distinct())
    # Rounds work on few rows, in as many tasks as those need.
    tasks = both.count() // EDGES_IN_TASK + 1
    both = both.coalesce(tasks)
    label = shared_checkpoint(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")).coalesce(tasks))
    while True:
        near = both.join(label.select(F.col("node").alias("other"), F.col("component").alias("seen")), "other").coalesce(tasks).groupBy("node").agg(F.min("seen").alias("seen"))
        stepped = label.join(near, "node").coalesce(tasks).select("node", F.col("component").alias("was"), F.least("component", "seen").alias("component"))
        jump = label.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = stepped.join(jump, "component", "left").select("node", "was", F.least("component", F.coalesce("further", "component")).alias("component"))
        after = shared_checkpoint(after.coalesce(tasks))
        label = after.select("node", "component")
        if not after.where("component <> was").limit(1).count():
            return label
