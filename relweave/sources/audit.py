"""Audit logs: JSON lines, one event each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AUDIT_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("privacy_tier", T.StringType()),
        T.StructField("schema_hash", T.StringType()),
        T.StructField("tokens_sent", T.LongType()),
        T.StructField("tokens_received", T.LongType()),
        T.StructField("cost_estimate", T.DoubleType()),
        T.StructField("cached", T.BooleanType()),
        T.StructField("duration_seconds", T.DoubleType()),
    ]
)
_DEFAULTS = {"tokens_sent": 0, "tokens_received": 0, "cost_estimate": 0.0, "cached": False}


def parse_audit_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events of the well-formed lines.

    A line is skipped when it is no JSON object, has an unknown field, a field of the wrong
    type, or lacks timestamp or provider.
    """
    names = AUDIT_SCHEMA.fieldNames()
    schema = T.StructType([*AUDIT_SCHEMA.fields, T.StructField("_bad", T.StringType())])
    event = F.from_json(column, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    unknown = F.array_except(F.json_object_keys(column), F.array(*[F.lit(n) for n in names]))
    parsed = lines.select(event.alias("e"), F.size(unknown).alias("_unknown"))
    good = parsed.where(
        "e IS NOT NULL AND e._bad IS NULL AND _unknown = 0 "
        "AND e.timestamp IS NOT NULL AND e.provider IS NOT NULL"
    )
    return good.select(
        *[
            F.coalesce(F.col(f"e.{n}"), F.lit(_DEFAULTS[n])).alias(n) if n in _DEFAULTS else F.col(f"e.{n}")
            for n in names
        ]
    )


def last_events(events: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest events, oldest first; each task keeps only its own ``n``."""
    order = ["timestamp", *[c for c in events.columns if c != "timestamp"]]
    newest = events.orderBy(*[F.col(c).desc() for c in order]).limit(n)
    return newest.orderBy(*order)


def read_audit_log(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    events = parse_audit_lines(spark.read.text(path))
    return events if last is None else last_events(events, last)


def audit_summary(events: DataFrame) -> DataFrame:
    """Calls, cache hits, tokens and cost per provider, model and tier."""
    return events.groupBy("provider", "model", "privacy_tier").agg(
        F.count("*").alias("calls"),
        F.count_if("cached").alias("cache_hits"),
        F.sum("tokens_sent").alias("tokens_sent"),
        F.sum("tokens_received").alias("tokens_received"),
        F.sum(F.col("cost_estimate").cast("decimal(20,6)")).cast("decimal(28,6)").alias("cost"),
    )
