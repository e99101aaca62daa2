"""Spec-driven columns: distributions, enum override, nullable rate, provider names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave import schema as S
from relweave.functions.draws import Cell
from relweave.functions.generators import REGISTRY, build, pick, uniform_hundredths
from relweave.operators.coherence import derive_columns, lookup_columns

DEFAULT_MAX = 1000.0


@dataclass(frozen=True)
class ColumnSpec:
    provider: str
    params: dict[str, Any] = field(default_factory=dict)
    distribution: str | None = None
    distribution_params: dict[str, float] = field(default_factory=dict)
    min_value: float | None = None
    max_value: float | None = None
    enum_values: tuple[str, ...] | None = None
    nullable_rate: float = 0.0


@dataclass(frozen=True)
class TableSpec:
    table_name: str
    columns: Mapping[str, ColumnSpec]
    row_count: int = 100
    derived: Sequence[tuple[str, str, Sequence[str]]] = ()
    lookups: Sequence[tuple[DataFrame, Mapping[str, str]]] = ()


def distributed(cell: Cell, spec: ColumnSpec) -> Column:
    """Uniform or clipped normal in [min, max], two decimals."""
    lo = 0.0 if spec.min_value is None else spec.min_value
    hi = DEFAULT_MAX if spec.max_value is None else spec.max_value
    if spec.distribution != "normal":
        return uniform_hundredths(cell, lo, hi)
    mean = spec.distribution_params.get("mean", (lo + hi) / 2)
    deviation = spec.distribution_params.get("std", (hi - lo) / 6)
    # Box-Muller; 1 - u keeps the logarithm finite
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - cell.unit()))
    angle = F.lit(6.283185307179586) * cell.unit(1)
    value = F.lit(float(mean)) + F.lit(float(deviation)) * radius * F.cos(angle)
    return F.round(F.least(F.greatest(value, F.lit(float(lo))), F.lit(float(hi))), 2)


def provider_column(cell: Cell, spec: ColumnSpec, *, strict: bool = True) -> Column:
    """The column of a provider name.

    ``numpy.*`` are distributions; otherwise the last part of the name is a generator.
    An unknown name raises, or gives ``val_<row>`` with ``strict=False``.
    """
    if spec.provider in ("builtin.autoincrement", "builtin.default"):
        return F.lit(None).cast("string")
    if spec.provider.startswith("numpy."):
        return distributed(cell, spec)
    name = spec.provider.rsplit(".", 1)[-1]
    if name in REGISTRY:
        return build(name, cell)
    if strict:
        raise ValueError(f"unknown provider {spec.provider!r}")
    return F.concat(F.lit("val_"), cell.row_id.cast("string"))


def spec_column(cell: Cell, spec: ColumnSpec | None, *, strict: bool = True) -> Column:
    """Enum values override the provider; the nullable rate is applied last."""
    if spec is None:
        return F.lit(None).cast("string")
    cell = Cell(cell.seed, cell.table, cell.column, cell.row_id, {**spec.params})
    value = pick(cell, spec.enum_values) if spec.enum_values else provider_column(cell, spec, strict=strict)
    if spec.nullable_rate > 0:
        chance = Cell(cell.seed, cell.table, cell.column + ":null", cell.row_id)
        value = F.when(chance.unit() >= F.lit(float(spec.nullable_rate)), value)
    return value


def add_spec_columns(
    df: DataFrame, table: S.Table, spec: TableSpec, *, seed: int, strict: bool = True
) -> DataFrame:
    """Add the specified columns to a frame of ``_row`` and keys; a column without
    specification is NULL."""
    out = []
    for c in table.columns:
        if c.name in df.columns:
            out.append(F.col(c.name))
        else:
            cell = Cell(seed, table.name, c.name, F.col("_row"))
            value = spec_column(cell, spec.columns.get(c.name), strict=strict)
            out.append(value.cast(c.spark_type).alias(c.name))
    df = df.select("_row", *out)
    for lookup, columns in spec.lookups:
        df = lookup_columns(df, lookup, columns, seed=seed, table=table.name, row_id="_row")
    return derive_columns(df, spec.derived) if spec.derived else df


def generate_table_from_spec(
    spark: SparkSession, table: S.Table, spec: TableSpec, n: int, *, seed: int, strict: bool = True
) -> DataFrame:
    """``_row`` plus all columns; foreign keys and generated keys stay NULL."""
    known = [c for c in table.columns if c.name in table.fk_columns or c.name in table.auto_columns]
    df = spark.range(n).withColumnRenamed("id", "_row")
    df = df.select("_row", *[F.lit(None).cast(c.spark_type).alias(c.name) for c in known])
    return add_spec_columns(df, table, spec, seed=seed, strict=strict)
