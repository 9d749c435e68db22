"""Lineage cuts for iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows up to which a side of a join is broadcast after its count.
FEW = 50_000


def _folder(df: DataFrame) -> str:
    """The session's checkpoint folder; a local session without one gets a temporary one, a cluster has to name it."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="strandline-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Rows written to the session's checkpoint folder and read back."""
    _folder(df)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The same as a compressed table, for as many rows as the input has; it stays in the folder, as the result is read from it."""
    folder = f"{_folder(df)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """The rows, checkpointed, as a side of a join on a key that many rows share, such as a relation: broadcast where they are `most` at most, so no task gets all rows of a key."""
    held = checkpointed(df)
    return F.broadcast(held) if held.limit(most + 1).count() <= most else held
