"""The quality report: one row with metadata, integrity, fidelity and detection."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = "1.0.0"

# Fixed values: (green, yellow) limits of the score colours.
FIDELITY_BANDS = (0.8, 0.5)
DETECTION_BANDS = (0.55, 0.7)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, rows) for every table."""
    parts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def fidelity_band(score: Column) -> Column:
    green, yellow = FIDELITY_BANDS
    return F.when(score >= green, "green").when(score >= yellow, "yellow").otherwise("red")


def detection_band(accuracy: Column) -> Column:
    green, yellow = DETECTION_BANDS
    return F.when(accuracy <= green, "green").when(accuracy <= yellow, "yellow").otherwise("red")


def _gather(rows: DataFrame, name: str) -> DataFrame:
    """All rows as one sorted array; their number is fixed by the schema."""
    return rows.agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias(name))


def quality_report(
    integrity: DataFrame,
    counts: DataFrame,
    *,
    schema_hash: str,
    engine: str,
    seed: int,
    fidelity: DataFrame | None = None,
    detection: DataFrame | None = None,
    fidelity_threshold: float = 0.7,
    detection_threshold: float = 0.6,
    timestamp: str | None = None,
) -> DataFrame:
    """One row ``(version, metadata, integrity, fidelity, detection, passed)``.

    ``passed`` is the conjunction of the parts present.
    """
    report = _gather(counts.select("table", "rows"), "row_counts")
    checks = _gather(integrity.select("check", "table", "column", "passed", "details"), "checks")
    report = report.withColumn("checks", checks.scalar())
    # verdicts come from the gathered rows, so every check and metric is computed once
    intact = F.forall("checks", lambda c: c["passed"])
    parts = [intact]
    blocks = {
        "integrity": F.struct(intact.alias("passed"), "checks"),
        "fidelity": F.lit(None).cast("struct<passed:boolean,overall_score:double>"),
        "detection": F.lit(None).cast("struct<passed:boolean,overall_score:double>"),
    }
    optional = (
        ("fidelity", fidelity, "score", 0.0, lambda overall: overall >= fidelity_threshold),
        ("detection", detection, "accuracy", 0.5, lambda overall: overall <= detection_threshold),
    )
    for name, rows, score, default, judge in optional:
        if rows is None:
            continue
        report = report.withColumn(f"{name}_metrics", _gather(rows, "metrics").scalar())
        metrics = F.col(f"{name}_metrics")
        total = F.aggregate(metrics[score], F.lit(0.0), lambda a, v: a + v)
        overall = F.when(F.size(metrics) > 0, total / F.size(metrics)).otherwise(F.lit(default))
        parts.append(judge(overall))
        blocks[name] = F.struct(
            judge(overall).alias("passed"), overall.alias("overall_score"), metrics.alias("metrics")
        )
    stamp = F.lit(timestamp) if timestamp else F.current_timestamp().cast("string")
    metadata = F.struct(
        stamp.alias("timestamp"), F.lit(schema_hash).alias("schema_hash"),
        F.map_from_entries("row_counts").alias("row_counts"),
        F.lit(engine).alias("engine"), F.lit(seed).alias("seed"),
    )
    return report.select(
        F.lit(VERSION).alias("version"),
        metadata.alias("metadata"),
        *[block.alias(name) for name, block in blocks.items()],
        reduce(lambda a, b: a & b, parts).alias("passed"),
    )


def report_json(report: DataFrame) -> DataFrame:
    return report.select(F.to_json(F.struct(*report.columns), {"ignoreNullFields": "false"}).alias("report"))
