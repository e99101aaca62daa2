"""Whole databases: generate, relate, repair.

Every table is a lazy plan over ``spark.range``; nothing is computed until a sink or a
check asks, and a parent is recomputed column-pruned where a child needs its key.
"""

from __future__ import annotations

import json
from collections.abc import Collection, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave import schema as S
from relweave.functions.draws import Cell
from relweave.functions.generators import STRING_GENERATORS, build
from relweave.operators import constraints as C
from relweave.operators import keys as K
from relweave.operators.catalog import map_columns
from relweave.operators.coherence import geo_coherence
from relweave.operators.positions import dense_index
from relweave.plans.spec import TableSpec, add_spec_columns

_NUMBERS = {"random_int", "random_float", "random_decimal", "age", "latitude", "longitude", "price"}
_MOMENTS = {"random_datetime", "datetime", "random_date", "date_of_birth"}


@dataclass(frozen=True)
class GeneratorMapping:
    generator: str | None
    params: dict = field(default_factory=dict)


@dataclass
class Generated:
    """Lazy tables in insertion order; ``_row`` has been dropped."""

    tables: dict[str, DataFrame]
    order: list[str]
    rows: dict[str, int]

    @property
    def total_rows(self) -> int:
        return sum(self.rows.values())


def column_mappings(spark: SparkSession, db: S.Database) -> dict[tuple[str, str], GeneratorMapping]:
    """Generators for every column, from the classification of the schema's catalog."""
    numbers = {"max_length": int, "precision": int, "scale": int, "min": float, "max": float, "enum_values": json.loads}
    rows = map_columns(S.catalog_frame(spark, db)).select("table", "column", "generator", "params").collect()
    return {
        (r["table"], r["column"]): GeneratorMapping(
            r["generator"], {k: numbers[k](v) for k, v in r["params"].items()}
        )
        for r in rows
    }


def _fits(generator: str, column: S.Column) -> bool:
    """Whether the generator's values can be held by the column's type."""
    kind = column.data_type
    if kind in ("varchar", "text", "unknown"):
        return True
    if kind in S.NUMERIC:
        return generator in _NUMBERS
    if kind in ("date", "datetime", "timestamp"):
        return generator in _MOMENTS
    exact = {
        "boolean": "random_bool", "time": "random_time", "uuid": "uuid4", "json": "random_json",
        "binary": "random_bytes", "array": "random_list",
    }
    if kind == "enum":
        return not column.enum_values or generator == "random_choice"
    return exact.get(kind) == generator


def mapped_column(column: S.Column, mapping: GeneratorMapping | None, cell: Cell) -> Column:
    """A generated column in the column's own type."""
    if mapping is None or mapping.generator is None:
        return F.lit(None).cast(column.spark_type)
    cell = Cell(cell.seed, cell.table, cell.column, cell.row_id, mapping.params)
    if column.data_type == "enum" and column.enum_values:
        return build("random_choice", Cell(cell.seed, cell.table, cell.column, cell.row_id, {"enum_values": list(column.enum_values)}))
    if not _fits(mapping.generator, column):
        return C.fallback_value(column, cell)
    value = build(mapping.generator, cell)
    return value if mapping.generator in STRING_GENERATORS else value.cast(column.spark_type)


def key_frame(spark: SparkSession, table: S.Table, n: int) -> DataFrame:
    """``_row``, the generated keys 1..n, and the foreign keys still NULL."""
    df = spark.range(n).withColumnRenamed("id", "_row")
    keys = [c for c in table.columns if c.name in table.fk_columns or c.name in table.auto_columns]
    df = df.select("_row", *[F.lit(None).cast(c.spark_type).alias(c.name) for c in keys])
    return K.autoincrement(df, table.auto_columns, F.col("_row")) if table.auto_columns else df


def add_columns(
    df: DataFrame, table: S.Table, mappings: Mapping[str, GeneratorMapping], *, seed: int
) -> DataFrame:
    """Add the generated columns to a frame of keys: one narrow projection, no shuffle.

    Columns that are not the table's stay.
    """
    named = {c.name for c in table.columns}
    out = [F.col(c) for c in df.columns if c != "_row" and c not in named]
    for c in table.columns:
        if c.name in df.columns:
            out.append(F.col(c.name))
        else:
            cell = Cell(seed, table.name, c.name, F.col("_row"))
            out.append(mapped_column(c, mappings.get(c.name), cell).alias(c.name))
    return df.select("_row", *out)


def generate_table(
    spark: SparkSession, table: S.Table, mappings: Mapping[str, GeneratorMapping], n: int, *, seed: int
) -> DataFrame:
    """``_row`` plus all columns; foreign keys stay NULL."""
    return add_columns(key_frame(spark, table, n), table, mappings, seed=seed)


def _make_unique(
    df: DataFrame, table: S.Table, n: int, domains: Mapping[str, C.Domain], seed: int
) -> DataFrame:
    """Uniqueness by construction where a text or integer column allows it, else by repair."""
    row = F.col("_row")
    sets = list(table.unique_sets)
    if table.primary_key and tuple(table.primary_key) not in sets:
        sets.append(tuple(table.primary_key))
    done: set[str] = set(table.auto_columns)
    repairs = []
    for columns in sets:
        if done & set(columns) or all(c in table.fk_columns for c in columns):
            continue
        for name in columns:
            column, domain = table.column(name), domains.get(name)
            if name in table.fk_columns or domain and domain.allowed:
                continue
            if column.data_type in ("varchar", "text"):
                room = column.max_length
                if room is None or 36 ** (room - 1) > n:
                    df = df.withColumn(name, C.unique_text(F.col(name), row, room))
                    done.add(name)
                    break
            elif column.data_type in S.INTEGERS:
                lo, hi = domain.bounds(True) if domain else (0, 2**15 - 1 if column.data_type == "smallint" else 2**31 - 1)
                if domain and domain.maximum is None:
                    hi = max(hi, lo + n - 1)
                span = int(hi) - int(lo) + 1
                if span < n:
                    raise C.ConstraintError(table.name, name, "UNIQUE", 0)
                df = df.withColumn(name, C.unique_int(row, span, int(lo)).cast(column.spark_type))
                done.add(name)
                break
            elif column.data_type == "uuid":
                done.add(name)  # 122 digest bits of distinct keys
                break
        else:
            repairs.append(columns)
    if repairs:
        singles = {c[0] for c in repairs if len(c) == 1}
        left = S.Table(
            table.name,
            tuple(replace(c, unique=c.name in singles) for c in table.columns),
            foreign_keys=table.foreign_keys,
            indexes=tuple(S.Index(c, True) for c in repairs if len(c) > 1),
        )
        df = C.repair_unique_sets(df, left, seed=seed, row_id="_row", domains=domains)
    return df


def _dense_key(db: S.Database, rows: Mapping[str, int], fk: S.ForeignKey) -> tuple[int, int] | None:
    """(1, n) where the foreign key points at a generated key 1..n."""
    parent = db.table(fk.ref_table)
    if len(fk.ref_columns) == 1 and fk.ref_columns[0] in parent.auto_columns:
        return 1, rows[fk.ref_table]
    return None


def _unique_key_sets(table: S.Table, left: Collection[S.ForeignKey], done: Mapping[str, DataFrame]) -> list[list[S.ForeignKey]]:
    """Foreign keys that must be drawn without repeating: those that make up a primary key or UNIQUE set by themselves.

    The smallest sets come first; a set that holds an earlier one is unique with it.
    """
    sets = [set(table.primary_key)] if table.primary_key else []
    sets += [set(columns) for columns in table.unique_sets]
    out: list[list[S.ForeignKey]] = []
    held: list[set[str]] = []
    for columns in sorted(sets, key=len):
        own = [fk for fk in left if set(fk.columns) <= columns and fk.ref_table != table.name and fk.ref_table in done]
        if columns != {c for fk in own for c in fk.columns} or any(columns >= h for h in held):
            continue
        if any(columns & h for h in held):
            raise C.ConstraintError(table.name, ", ".join(sorted(columns)), "UNIQUE over foreign keys of another UNIQUE set", 0)
        out.append(own)
        held.append(columns)
    return out


def _relate(
    df: DataFrame, table: S.Table, db: S.Database, done: Mapping[str, DataFrame], existing: Collection[str],
    rows: Mapping[str, int], deferred: Collection[S.ForeignKey], seed: int,
) -> DataFrame:
    n = rows[table.name]
    left = [fk for fk in table.foreign_keys if fk not in deferred and set(fk.columns) <= set(df.columns)]
    known = {fk: None if fk.ref_table in existing else _dense_key(db, rows, fk) for fk in left if fk.ref_table in done}

    def parent(fk: S.ForeignKey) -> DataFrame:
        return done[fk.ref_table].dropna(subset=list(fk.ref_columns)) if fk.ref_table in existing else done[fk.ref_table]

    for keys in _unique_key_sets(table, left, done):
        try:
            df = K.fill_junction(
                df, [(parent(fk), fk.columns, fk.ref_columns) for fk in keys], position="_row", n_rows=n,
                dense=[known[fk] for fk in keys], seed=seed, table=table.name,
            )
        except ValueError as short:
            raise C.ConstraintError(table.name, ", ".join(c for fk in keys for c in fk.columns), "UNIQUE over foreign keys", 0) from short
        left = [fk for fk in left if fk not in keys]
    # the last join bounds the rows of a task; an empty parent gives NULL, which would not spread
    joins = [fk for fk in left if fk.ref_table in done and not known[fk] and rows[fk.ref_table]]
    for fk in left:
        if fk.ref_table in done:
            df = K.fill_fk(
                df, parent(fk), fk.columns, fk.ref_columns, seed=seed, table=table.name, row_id="_row", dense=known[fk],
                n_rows=n if joins and fk is joins[-1] else None,
            )
    return df


def _relate_to_itself(df: DataFrame, table: S.Table, n: int, seed: int) -> DataFrame:
    for fk in table.foreign_keys:
        if fk.ref_table == table.name:
            dense = len(fk.columns) == 1 and fk.ref_columns[0] in table.auto_columns
            df = K.self_reference(
                df, fk.columns, fk.ref_columns, seed=seed, table=table.name, position="_row",
                size=n, dense_first=1 if dense else None,
            )
    return df


def generate_database(
    spark: SparkSession,
    db: S.Database,
    rows: int | Mapping[str, int],
    *,
    seed: int = 42,
    default_rows: int = 100,
    exclude: Collection[str] = (),
    specs: Mapping[str, TableSpec] | None = None,
    places: DataFrame | None = None,
    existing: Mapping[str, DataFrame] | None = None,
) -> Generated:
    """Tables in parent-first order: generate, fill keys, repair, then close cycles.

    ``rows`` is one number or a number per table.  An excluded table is absent and keys to
    it stay NULL.  ``specs`` gives some tables a specification instead of the name rules.

    ``existing`` gives tables that are there already: their rows and columns stay as they are, other tables
    refer to their keys, and columns of the schema that they lack are generated for them.  They need
    their primary key.  UNIQUE sets made of foreign keys alone are drawn without repeating.
    """
    existing = dict(existing or {})
    order, deferred = S.table_order(db)
    order = [name for name in order if name not in set(exclude)]
    counts = {
        name: existing[name].count() if name in existing else rows if isinstance(rows, int) else rows.get(name, default_rows)
        for name in order
    }
    mappings = column_mappings(spark, db)
    all_domains = C.database_domains(spark, db)
    done: dict[str, DataFrame] = {}
    for name in order:
        table, n = db.table(name), counts[name]
        later = [fk for t, fk in deferred if t == name]
        whole, given = table, existing.get(name)
        if given is not None:
            table = _lacking(table, given)
            if not table.columns:
                done[name] = given
                continue
            if specs and name in specs:
                raise ValueError(f"columns that existing table {name} lacks follow the name rules, not a specification")
            empty = [F.lit(None).cast(c.spark_type).alias(c.name) for c in table.columns if c.name in table.fk_columns]
            df = dense_index(given, list(whole.primary_key), index="_row").select("_row", *given.columns, *empty)
        else:
            df = key_frame(spark, table, n)
        # keys first: their joins move keys only, the wide columns are computed afterwards
        df = _relate(df, table, db, done, existing, counts, later, seed)
        if specs and name in specs:
            df = add_spec_columns(df, table, specs[name], seed=seed)
        else:
            own = {c.name: mappings[(name, c.name)] for c in table.columns}
            df = add_columns(df, table, own, seed=seed)
        domains = {c: d for c, d in all_domains[name].items() if c in {own.name for own in table.columns}}
        df = geo_coherence(df, seed=seed, table=name, row_id="_row", places=places)
        df = C.repair_not_null(df, table, seed=seed, row_id="_row", domains=domains)
        df = C.repair_check(df, domains, table, seed=seed, row_id="_row")
        df = _make_unique(df, table, n, domains, seed)
        df = _relate_to_itself(df, table, n, seed)  # last: it copies final key values
        done[name] = df.select("_row", *[c.name for c in whole.columns])
    for name, fk in deferred:
        if name in done and fk.ref_table in done and not (name in existing and set(fk.columns) <= set(existing[name].columns)):
            done[name] = K.fill_fk(
                done[name], done[fk.ref_table], fk.columns, fk.ref_columns, seed=seed, table=name, row_id="_row",
                dense=None if fk.ref_table in existing else _dense_key(db, counts, fk), n_rows=counts[name] if counts[fk.ref_table] else None,
            )
    made = {n: df if df is existing.get(n) else df.drop("_row") for n, df in done.items()}
    return Generated(made, order, counts)


def _lacking(table: S.Table, given: DataFrame) -> S.Table:
    """The columns a given table has not, with the keys and UNIQUE sets made of them alone."""
    if not table.primary_key or not set(table.primary_key) <= set(given.columns):
        raise ValueError(f"existing table {table.name} needs its primary key")
    names = {c.name for c in table.columns} - set(given.columns)
    return replace(
        table, columns=tuple(c for c in table.columns if c.name in names), primary_key=(),
        foreign_keys=tuple(fk for fk in table.foreign_keys if set(fk.columns) <= names),
        indexes=tuple(ix for ix in table.indexes if set(ix.columns) <= names),
    )

