"""Intermediate tables in the folder all executors share; reading them back ends the lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.session import scratch_path

BROADCAST_BYTES = 32 << 20
BATCH_ROWS = 1000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession) -> None:
    """Send texts to Arrow functions at most ``BATCH_ROWS`` at a time; the session keeps a smaller setting of its own.

    A batch lies in the memory of the executor and of its worker at once, and a worker keeps
    much of its peak between stages.
    """
    now = int(spark.conf.get(_BATCH_SETTING))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(_BATCH_SETTING, BATCH_ROWS)


def small(df: DataFrame, row_bytes: int | None = None, most: int = BROADCAST_BYTES) -> DataFrame:
    """A stored table, marked for broadcast if its measured size is at most ``most`` bytes; unmarked beyond that.

    ``row_bytes`` is the size of a row of fixed width; rows are measured as JSON without it.
    """
    if row_bytes:
        size = df.count() * row_bytes
    else:
        size = df.agg(F.sum(F.length(F.to_json(F.struct(*df.columns))))).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def unused(df: DataFrame, *stems: str) -> list[str]:
    """A name for each stem that no column of ``df`` has, upper and lower case being the same."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
