"""Columns that agree with each other: places, lookups, derived expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.functions import words
from relweave.functions.draws import draw
from relweave.functions.texts import text_sql
from relweave.operators.positions import dense_index

# The exact lowercase names that mark a geographic column.
CITY_COLUMNS = ("city", "town", "municipality")
STATE_COLUMNS = ("state", "state_code", "province", "region")
ZIP_COLUMNS = ("zip", "zip_code", "postal_code", "zipcode")


def detect_geo_columns(columns: Sequence[str]) -> dict[str, str]:
    """city/state/zip -> column name; empty unless at least two kinds are present."""
    kinds = {"city": CITY_COLUMNS, "state": STATE_COLUMNS, "zip": ZIP_COLUMNS}
    found = {k: c for c in columns for k, names in kinds.items() if c.lower() in names}
    return found if len(found) >= 2 else {}


def geo_coherence(
    df: DataFrame, *, seed: int, table: str, row_id: str, places: DataFrame | None = None
) -> DataFrame:
    """Overwrite the geographic columns with one place per row.

    ``places`` (city, state, zip) replaces the built-in list of places; any size goes.
    """
    found = detect_geo_columns(df.columns)
    if not found:
        return df
    if places is not None:
        return lookup_columns(
            df, places, {column: kind for kind, column in found.items()},
            seed=seed, table=table, row_id=row_id, tag="geo",
        )
    options = F.expr(
        "array("
        + ", ".join(
            f"named_struct('city', {text_sql(c)}, 'state', {text_sql(s)}, 'zip', {text_sql(z)})"
            for c, s, z in words.PLACES
        )
        + ")"
    )
    at = draw(seed, table, "geo", F.col(row_id)) % F.lit(len(words.PLACES)).cast("bigint")
    place = F.element_at(options, (at + 1).cast("int"))
    return df.withColumns({column: place[kind] for kind, column in found.items()})


def lookup_columns(
    df: DataFrame,
    lookup: DataFrame,
    columns: Mapping[str, str],
    *,
    seed: int,
    table: str,
    row_id: str,
    tag: str = "lookup",
) -> DataFrame:
    """Set several columns from one drawn row of a lookup table.

    ``columns`` maps target column -> lookup column; rows that repeat weigh accordingly.
    Spark broadcasts the lookup only when its measured size is below the broadcast threshold.
    """
    used = list(dict.fromkeys(columns.values()))
    size = lookup.agg(F.nullif(F.count("*"), F.lit(0))).scalar()
    numbered = dense_index(lookup, lookup.columns, index="_ix", unique=False).select(
        "_ix", *[F.col(c).alias(f"_lk_{c}") for c in used]
    )
    joined = df.withColumn("_ix", draw(seed, table, tag, F.col(row_id)) % size).join(
        numbered, "_ix", "left"
    )
    values = {target: F.col(f"_lk_{source}") for target, source in columns.items()}
    kept = [values[c].alias(c) if c in values else F.col(c) for c in df.columns]
    return joined.select(*kept, *[v.alias(t) for t, v in values.items() if t not in df.columns])


def derive_columns(
    df: DataFrame, derived: Sequence[tuple[str, str, Sequence[str]]]
) -> DataFrame:
    """Add ``(column, expression, depends_on)`` columns, dependencies first."""
    waiting = list(derived)
    while waiting:
        targets = {c for c, _, _ in waiting}
        ready = [d for d in waiting if not (set(d[2]) & targets - {d[0]})]
        if not ready:
            raise ValueError(f"derived columns depend on each other: {sorted(targets)}")
        df = df.withColumns({c: F.expr(expression) for c, expression, _ in ready})
        waiting = [d for d in waiting if d not in ready]
    return df
