"""Repair of NOT NULL, CHECK and UNIQUE on any table, and constructive uniqueness."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave import schema as S
from relweave.functions.draws import Cell
from relweave.functions.generators import (
    decimal_up_to, pick, random_date, random_datetime, random_letters, random_list, random_time,
    uniform_hundredths, uuid4,
)
from relweave.operators import keys
from relweave.operators.allocation import DomainExhausted, allocate_unique, codec_of
from relweave.session import shared_dir

MAX_ATTEMPTS = 10
DEFAULT_SPAN = 1000  # width of a one-sided CHECK range


class ConstraintError(ValueError):
    """A constraint that redrawing did not satisfy."""

    def __init__(self, table: str, column: str, constraint: str, attempts: int) -> None:
        super().__init__(f"{constraint} on {table} ({column}) is still violated after {attempts} redraws")
        self.table = table
        self.column = column
        self.constraint = constraint
        self.attempts = attempts


# --- values ------------------------------------------------------------------
def fallback_value(column: S.Column, cell: Cell) -> Column:
    """A value of the column's type, used where the original has to go."""
    kind = column.data_type
    if kind in S.INTEGERS:
        top = 2**15 if kind == "smallint" else 2**31
        return cell.below(top).cast(column.spark_type)
    if kind == "decimal":
        t = column.spark_type
        return decimal_up_to(cell, max(10 ** (t.precision - t.scale) - 1, 1), t.precision, t.scale)
    if kind == "float":
        return uniform_hundredths(cell, 0, 10000)
    if kind == "boolean":
        return cell.below(2) == 1
    if kind == "enum" and column.enum_values:
        return pick(cell, column.enum_values)
    if kind == "uuid":
        return uuid4(cell)
    temporal = {"date": random_date, "datetime": random_datetime, "timestamp": random_datetime, "time": random_time}
    if kind in temporal:
        return temporal[kind](cell).cast(column.spark_type)
    if kind == "array":
        return random_list(cell)
    if kind == "binary":
        return F.unhex(cell.hex())
    if kind == "json":
        return F.concat(F.lit("{\"value\":"), cell.below(10000).cast("string"), F.lit("}"))
    return random_letters(cell, min(column.max_length or 20, 50))


@dataclass(frozen=True)
class Domain:
    """What a CHECK allows: a range, or a list of values."""

    minimum: float | None = None
    maximum: float | None = None
    minimum_open: bool = False
    maximum_open: bool = False
    allowed: tuple[str, ...] | None = None

    def bounds(self, integral: bool) -> tuple[float, float]:
        """A closed finite range; a missing side is DEFAULT_SPAN away from the other."""
        step = 1 if integral else 0.01
        lo, hi = self.minimum, self.maximum
        if lo is not None and self.minimum_open:
            lo += step
        if hi is not None and self.maximum_open:
            hi -= step
        if lo is None:
            lo = hi - DEFAULT_SPAN
        return lo, lo + DEFAULT_SPAN if hi is None else hi

    def violated(self, value: Column) -> Column:
        """NULL values satisfy every CHECK."""
        if self.allowed is not None:
            return F.coalesce(~value.cast("string").isin(list(self.allowed)), F.lit(False))
        tests = []
        if self.minimum is not None:
            low = F.lit(float(self.minimum))
            tests.append(value <= low if self.minimum_open else value < low)
        if self.maximum is not None:
            high = F.lit(float(self.maximum))
            tests.append(value >= high if self.maximum_open else value > high)
        return F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))

    def draw(self, column: S.Column, cell: Cell) -> Column:
        """A value inside the domain, in the column's own type."""
        if self.allowed is not None:
            return pick(cell, self.allowed).cast(column.spark_type)
        lo, hi = self.bounds(column.data_type in S.INTEGERS)
        if column.data_type in S.INTEGERS:
            return cell.between(int(lo), int(hi)).cast(column.spark_type)
        scale = column.spark_type.scale if column.data_type == "decimal" else 2
        return uniform_hundredths(cell, lo, hi, scale).cast(column.spark_type)


# --- CHECK expressions as catalog data ----------------------------------------
_NUMBER = r"(-?\d+(?:\.\d+)?)"


def check_domains(catalog: DataFrame) -> DataFrame:
    """Range and value list of every CHECK in a catalog table.

    Adds ``min_value, max_value, min_open, max_open, allowed_values, parsed``.
    BETWEEN comes first, then IN, then comparisons; of several bounds on one side the
    last holds.  An expression without AND carries a single comparison.
    """
    text = F.trim(F.col("check_expr"))
    between = rf"(?i)BETWEEN\s+{_NUMBER}\s+AND\s+{_NUMBER}"
    has_between = text.rlike(between)
    in_list = F.regexp_extract(text, r"(?i)IN\s*\(\s*((?:'[^']*'(?:\s*,\s*'[^']*')*)\s*)\)", 1)
    listed = F.transform(
        F.regexp_extract_all(in_list, F.lit(r"'([^']*)'"), F.lit(1)), lambda v: F.trim(v)
    )
    has_in = in_list != ""

    def last(pattern: str, group: int) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        return F.try_element_at(found, F.lit(-1))

    lower, upper = rf">(=?)\s*{_NUMBER}", rf"<(=?)\s*{_NUMBER}"
    lone = ~text.rlike(r"(?i)\bAND\b")
    compares = ~has_between & ~has_in
    low = F.when(compares, last(lower, 2))
    # without AND only the first side found counts, lower bound first
    high = F.when(compares & ~(lone & low.isNotNull()), last(upper, 2))
    minimum = F.when(has_between, F.regexp_extract(text, between, 1)).otherwise(low)
    maximum = F.when(has_between, F.regexp_extract(text, between, 2)).otherwise(high)
    return catalog.withColumns(
        {
            "min_value": minimum.cast("double"),
            "max_value": maximum.cast("double"),
            "min_open": F.coalesce(low.isNotNull() & (last(lower, 1) == ""), F.lit(False)),
            "max_open": F.coalesce(high.isNotNull() & (last(upper, 1) == ""), F.lit(False)),
            "allowed_values": F.when(~has_between & has_in, listed),
        }
    ).withColumn(
        "parsed",
        F.coalesce(F.col("min_value"), F.col("max_value")).isNotNull()
        | F.col("allowed_values").isNotNull(),
    )


def database_domains(spark: SparkSession, db: S.Database) -> dict[str, dict[str, Domain]]:
    """table -> column -> domain of its CHECK; the rows collected number at most the columns."""
    checked = tuple(t for t in db.tables if any(c.check for c in t.columns))
    out: dict[str, dict[str, Domain]] = {t.name: {} for t in db.tables}
    if checked:
        for r in check_domains(S.catalog_frame(spark, S.Database(checked))).where("parsed").collect():
            allowed = r["allowed_values"]
            out[r["table"]][r["column"]] = Domain(
                r["min_value"], r["max_value"], r["min_open"], r["max_open"],
                None if allowed is None else tuple(allowed),
            )
    return out


def table_domains(spark: SparkSession, table: S.Table) -> dict[str, Domain]:
    return database_domains(spark, S.Database((table,)))[table.name]


def repair_check(
    df: DataFrame, domains: Mapping[str, Domain], table: S.Table, *, seed: int, row_id: str
) -> DataFrame:
    """Replace values outside their domain by values inside; NULL stays."""
    fixed = {}
    for name, domain in domains.items():
        column = table.column(name)
        if domain.allowed is None and column.data_type not in S.NUMERIC:
            continue
        cell = Cell(seed, table.name, name + ":check", F.col(row_id))
        fixed[name] = F.when(domain.violated(F.col(name)), domain.draw(column, cell)).otherwise(F.col(name))
    return df.withColumns(fixed) if fixed else df


def check_violations(df: DataFrame, domains: Mapping[str, Domain], table: str) -> DataFrame:
    """Violations per CHECK in one scan, as integrity rows."""
    counts = df.agg(
        F.count("*").alias("_rows"),
        *[F.count_if(d.violated(F.col(c))).alias(f"_v{k}") for k, (c, d) in enumerate(domains.items())],
    )
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.col(f"_v{k}").alias("n"))
                for k, c in enumerate(domains)
            ]
        )
    )
    return counts.where("_rows > 0").select(rows.alias("r")).select(
        F.lit("check").alias("check"),
        F.lit(table).alias("table"),
        F.col("r.column").alias("column"),
        (F.col("r.n") == 0).alias("passed"),
        F.when(F.col("r.n") == 0, "").otherwise(
            F.concat(F.col("r.n").cast("string"), F.lit(" CHECK violations"))
        ).alias("details"),
    )


def repair_not_null(
    df: DataFrame, table: S.Table, *, seed: int, row_id: str,
    domains: Mapping[str, Domain] | None = None,
) -> DataFrame:
    """Fill NULLs of non-nullable columns, except foreign keys and generated keys."""
    fixed = {}
    for c in table.columns:
        if c.nullable or c.autoincrement or c.name in table.fk_columns:
            continue
        cell = Cell(seed, table.name, c.name + ":notnull", F.col(row_id))
        domain = (domains or {}).get(c.name)
        value = domain.draw(c, cell) if domain else fallback_value(c, cell)
        fixed[c.name] = F.coalesce(F.col(c.name), value)
    return df.withColumns(fixed) if fixed else df


# --- UNIQUE -------------------------------------------------------------------
def unique_keepers(df: DataFrame, columns: Sequence[str], row_id: str) -> DataFrame:
    """The first row (lowest id) of every value: columns and ``_keeper``.

    Grouping combines on the map side, so a very frequent value costs one row per task.
    """
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return df.where(complete).groupBy(*columns).agg(F.min(row_id).alias("_keeper"))


def mark_repeats(
    df: DataFrame, columns: Sequence[str], row_id: str, keepers: DataFrame | None = None
) -> DataFrame:
    """Add ``_repeat``: the row has a complete key and is not the first to hold it.

    The join is on the row id, which is unique, never on the value.
    """
    if keepers is None:
        keepers = unique_keepers(df, columns, row_id)
    first = keepers.select(F.col("_keeper").alias(row_id), F.lit(True).alias("_kept"))
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return df.join(first, row_id, "left").select(
        *df.columns, (complete & F.col("_kept").isNull()).alias("_repeat")
    )


def repair_unique(
    df: DataFrame,
    columns: Sequence[str],
    regenerate: Callable[[int], Mapping[str, Column]],
    *,
    row_id: str,
    table: str,
    attempts: int = MAX_ATTEMPTS,
) -> DataFrame:
    """Keep the first row of every value and redraw the others until all differ.

    ``regenerate(attempt)`` gives new columns from the row id.  Each round works on the
    rows still repeated; tables carried from round to round are checkpointed in the
    shared folder, so no lineage grows and lost executors cost no restart.
    """
    shared_dir(df.sparkSession)
    columns = list(columns)
    keepers = unique_keepers(df, columns, row_id).checkpoint()  # the one grouping of all values
    marked = mark_repeats(df, columns, row_id, keepers)
    remaining = marked.where("_repeat").drop("_repeat").checkpoint()
    if remaining.isEmpty():
        return df
    taken = keepers.select(*columns)
    placed: DataFrame | None = None
    for attempt in range(attempts):
        fresh = remaining.withColumns(dict(regenerate(attempt)))
        first = unique_keepers(fresh, columns, row_id)
        clash = first.join(taken, columns).select("_keeper")
        won = first.join(clash, "_keeper", "left_anti")
        won = won.select(F.col("_keeper").alias(row_id), *columns).checkpoint()
        placed = won if placed is None else placed.unionByName(won)
        remaining = remaining.join(won.select(row_id), row_id, "left_anti").checkpoint()
        if remaining.isEmpty():
            break
        taken = taken.unionByName(won.select(*columns))
    else:
        kind = "UNIQUE" if len(columns) == 1 else "UNIQUE (composite)"
        raise ConstraintError(table, ", ".join(columns), kind, attempts)
    new = placed.select(
        row_id, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_placed")
    )
    joined = df.join(new, row_id, "left")
    return joined.select(
        *[
            F.when(F.col("_placed"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
            if c in columns
            else F.col(c)
            for c in df.columns
        ]
    )


def repair_unique_sets(
    df: DataFrame, table: S.Table, *, seed: int, row_id: str,
    domains: Mapping[str, Domain] | None = None,
) -> DataFrame:
    """UNIQUE columns, UNIQUE indexes and the primary key of a table.

    Of a set's columns the one with the largest domain gets free values, in one pass; types whose
    values cannot be counted off (uuid, json, binary, lists, times) are redrawn in rounds.  Foreign-key columns are never redrawn; a set made of them alone is left to
    :func:`relweave.operators.keys.fill_junction`.
    """
    sets = list(table.unique_sets)
    pk = tuple(table.primary_key)
    if pk and pk not in sets:
        sets.append(pk)
    auto = {c.name for c in table.columns if c.autoincrement}
    for columns in sets:
        free = [c for c in columns if c not in table.fk_columns and c not in auto]
        if not free or auto & set(columns):
            continue

        counted = {name: codec_of(table.column(name), (domains or {}).get(name)) for name in free}
        counted = {name: codec for name, codec in counted.items() if codec is not None}
        if counted:
            name = max(counted, key=lambda c: counted[c].last - counted[c].first)
            try:
                df = allocate_unique(df, columns, name, counted[name], row_id=row_id)
            except DomainExhausted as short:
                kind = "UNIQUE" if len(columns) == 1 else "UNIQUE (composite)"
                raise ConstraintError(table.name, ", ".join(columns), kind, 0) from short
            continue

        def regenerate(attempt: int, columns=columns, free=free) -> dict[str, Column]:
            out = {}
            for name in free:
                column = table.column(name)
                cell = Cell(seed, table.name, f"{name}:unique{attempt}", F.col(row_id))
                domain = (domains or {}).get(name)
                value = domain.draw(column, cell) if domain else fallback_value(column, cell)
                out[name] = value.cast(column.spark_type)
            return out

        df = repair_unique(df, columns, regenerate, row_id=row_id, table=table.name)
    return df


DIGITS36 = "0123456789abcdefghijklmnopqrstuvwxyz"


def base36(number: Column) -> Column:
    return F.lower(F.conv(number.cast("string"), 10, 36))


def unique_text(value: Column, row_id: Column, max_length: int | None = None) -> Column:
    """Make a text unique by a suffix from the row id; the base is cut, never the suffix."""
    suffix = F.concat(F.lit("_"), base36(row_id))
    if max_length is None:
        return F.concat(value, suffix)
    room = F.greatest(F.lit(max_length) - F.length(suffix), F.lit(0))
    return F.concat(F.substring(value, F.lit(1), room), suffix)


def unique_int(row_id: Column, span: int, first: int = 0) -> Column:
    """Distinct integers in [first, first + span) for row ids below ``span``."""
    number = "decimal(38,0)"
    a = keys.pair_multiplier(span)
    mixed = (
        row_id.cast("decimal(18,0)") * F.lit(a).cast("decimal(18,0)") + F.lit(span // 3).cast("decimal(18,0)")
    ).cast(number) % F.lit(span).cast("decimal(18,0)")
    return mixed.cast("bigint") + first


# --- everything ---------------------------------------------------------------
def enforce_constraints(
    df: DataFrame, table: S.Table, *, seed: int, row_id: str, position: Column | None = None
) -> DataFrame:
    """Generated keys, NOT NULL, CHECK, then UNIQUE (redrawn inside the CHECK domain).

    ``row_id`` is a unique column of ``df``; ``position`` numbers the rows from 0 where
    the table has an autoincrement key.
    """
    domains = table_domains(df.sparkSession, table)
    if table.auto_columns and position is not None:
        df = keys.autoincrement(df, table.auto_columns, position)
    df = repair_not_null(df, table, seed=seed, row_id=row_id, domains=domains)
    df = repair_check(df, domains, table, seed=seed, row_id=row_id)
    return repair_unique_sets(df, table, seed=seed, row_id=row_id, domains=domains)
