"""Keys and relationships: dense keys, foreign keys, self references, junction pairs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relweave.functions.draws import draw, unit
from relweave.operators.positions import PREFIX_LENGTH, bucket_offsets, dense_index, split_buckets, spread_rows

SELF_REFERENCE_ROOTS = 5  # the first n/5 rows have no parent
PAIR_MULTIPLIER = 1_000_003
FEISTEL_ROUNDS = 2
PARENTS_PER_BLOCK = 64


def autoincrement(df: DataFrame, columns: Sequence[str], position: Column) -> DataFrame:
    """1, 2, 3, ... in row order for every listed column."""
    return df.withColumns({c: (position + 1).cast(df.schema[c].dataType) for c in columns})


def _tag(columns: Sequence[str]) -> str:
    return "fk:" + ",".join(columns)


def fill_fk(
    child: DataFrame,
    parent: DataFrame | None,
    columns: Sequence[str],
    ref_columns: Sequence[str],
    *,
    seed: int,
    table: str,
    row_id: str,
    null_rate: float = 0.0,
    dense: tuple[int, int] | None = None,
    n_rows: int | None = None,
) -> DataFrame:
    """Give each child row the key of one uniformly drawn parent row.

    All columns of a composite key come from the same parent row.  The draw names
    table and key columns, so several keys of one table are independent.  A missing
    or empty parent gives NULL.  ``dense=(first, n)`` states that the parent key is
    first..first+n-1, which needs no join.  Otherwise parent keys are numbered and
    joined on the number; the draw is uniform, so no parent number is hot.  ``n_rows``, the
    number of children, bounds the rows of a task after that join.
    """
    tag = _tag(columns)
    row = F.col(row_id)
    keep = None
    if null_rate:
        keep = unit(seed, table, tag + ":null", row) >= F.lit(float(null_rate))
    if parent is None and dense is None or dense and dense[1] == 0:
        return _with_columns(child, {c: F.lit(None) for c in columns})
    if dense:
        first, n = dense
        value = F.lit(first).cast("bigint") + draw(seed, table, tag, row) % F.lit(n).cast("bigint")
        return _with_columns(child, {columns[0]: value if keep is None else F.when(keep, value)})

    size = parent.agg(F.nullif(F.count("*"), F.lit(0))).scalar()
    ix = draw(seed, table, tag, row) % size
    if keep is not None:
        ix = F.when(keep, ix)
    names = [f"_ref{k}" for k in range(len(columns))]
    numbered = dense_index(parent.select(*ref_columns), ref_columns, index="_ix").select(
        "_ix", *[F.col(r).alias(n) for r, n in zip(ref_columns, names, strict=True)]
    )
    joined = spread_rows(child.withColumn("_ix", ix), n_rows, "_ix").join(numbered, "_ix", "left")
    return _with_columns(joined, {c: F.col(n) for c, n in zip(columns, names, strict=True)}, child)


def fill_foreign_keys(
    child: DataFrame,
    keys: Sequence[tuple[Sequence[str], DataFrame | None, Sequence[str]]],
    *,
    seed: int,
    table: str,
    row_id: str,
) -> DataFrame:
    """Fill several foreign keys in declaration order."""
    for columns, parent, ref_columns in keys:
        child = fill_fk(
            child, parent, columns, ref_columns, seed=seed, table=table, row_id=row_id
        )
    return child


def fill_deferred(child: DataFrame, parent: DataFrame, columns, ref_columns, *, seed, table, row_id, null_rate=0.0):
    """Second pass for a key left NULL to open a cycle; rows already set are kept."""
    before = {c: f"_old{k}" for k, c in enumerate(columns)}
    staged = child.withColumns({old: F.col(c) for c, old in before.items()})
    filled = fill_fk(
        staged, parent, columns, ref_columns, seed=seed, table=table, row_id=row_id,
        null_rate=null_rate,
    )
    was_empty = F.lit(True)
    for old in before.values():
        was_empty &= F.col(old).isNull()
    chosen = {c: F.when(was_empty, F.col(c)).otherwise(F.col(old)) for c, old in before.items()}
    return _with_columns(filled, chosen, child)


def self_reference(
    df: DataFrame,
    columns: Sequence[str],
    ref_columns: Sequence[str],
    *,
    seed: int,
    table: str,
    position: str,
    size: Column | int,
    dense_first: int | None = None,
) -> DataFrame:
    """The first fifth of the rows are roots; row i refers to a uniformly drawn earlier row.

    References go to lower positions only, hence no cycle.  ``dense_first`` states
    that the key is position + dense_first, which needs no join.
    """
    pos = F.col(position)
    n = size if isinstance(size, Column) else F.lit(size).cast("bigint")
    roots = F.greatest(F.call_function("div", n, F.lit(SELF_REFERENCE_ROOTS).cast("bigint")), F.lit(1).cast("bigint"))
    earlier = F.when(
        pos >= roots, draw(seed, table, _tag(columns), pos) % F.nullif(pos, F.lit(0).cast("bigint"))
    )
    if dense_first is not None:
        return _with_columns(df, {columns[0]: earlier + dense_first})
    names = [f"_ref{k}" for k in range(len(columns))]
    targets = df.select(
        pos.alias("_earlier"),
        *[F.col(r).alias(n) for r, n in zip(ref_columns, names, strict=True)],
    )
    joined = df.withColumn("_earlier", earlier).join(targets, "_earlier", "left")
    return _with_columns(joined, {c: F.col(n) for c, n in zip(columns, names, strict=True)}, df)


def pair_multiplier(total: int) -> int:
    """A multiplier without common divisor with ``total``."""
    a = PAIR_MULTIPLIER
    while math.gcd(a, total) != 1:
        a += 2
    return a


def spread_multiplier(total: int) -> int:
    """About total / golden ratio, without common divisor with ``total``: multiples of it lie far apart."""
    a = max(int(total * 0.6180339887498949), 1)
    while math.gcd(a, total) != 1:
        a += 1
    return a


def spread_position(position: Column, total: int) -> Column:
    """A bijection of 0..total-1 that sends neighbours far apart."""
    wide = "decimal(38,0)"
    product = position.cast("decimal(18,0)") * F.lit(spread_multiplier(total)).cast("decimal(19,0)")
    return ((product.cast(wide) + F.lit(total // 3).cast(wide)).cast(wide) % F.lit(total).cast("decimal(19,0)")).cast("bigint")


def junction_codes(
    df: DataFrame, position: str, sizes: Sequence[int], n_rows: int, *, seed: int = 0, table: str = "junction"
) -> DataFrame:
    """Add ``ix0, ix1, ...``: distinct index tuples, spread evenly over all parents.

    The position's digits in mixed radix are the first tuple.  Then each digit in turn is moved by a draw
    from the others, modulo its own size: a Feistel network whose halves are the digits themselves, so
    every round is a bijection of the tuples whatever the sizes, and nothing is shuffled.
    A parent's number of tuples follows a draw without replacement: about n_rows / size, with deviations of its root.
    """
    total = math.prod(sizes)
    if n_rows > total:
        raise ValueError(f"{n_rows} distinct pairs asked for, only {total} exist")
    if len(sizes) == 1:
        return df.withColumn("ix0", spread_position(F.col(position), total))
    rest = F.col(position).cast("bigint")
    digits = {}
    for k, n in enumerate(sizes):
        size = F.lit(n).cast("bigint")
        digits[f"ix{k}"] = rest % size
        rest = F.call_function("div", rest, size)
    df = df.withColumns(digits)
    for r in range(FEISTEL_ROUNDS):
        for k, n in enumerate(sizes):
            others = F.concat_ws(":", *[F.col(f"ix{j}").cast("string") for j in range(len(sizes)) if j != k])
            moved = F.col(f"ix{k}") + draw(seed, table, f"pair{r}:{k}", others)
            df = df.withColumn(f"ix{k}", moved % F.lit(n).cast("bigint"))
    return df


def fill_junction(
    df: DataFrame,
    parents: Sequence[tuple[DataFrame, Sequence[str], Sequence[str]]],
    *,
    position: str,
    n_rows: int,
    dense: Sequence[tuple[int, int] | None] = (),
    seed: int = 0,
    table: str = "junction",
) -> DataFrame:
    """Fill the foreign keys ``(parent, columns, ref_columns)`` with distinct combinations.

    ``dense`` gives (first, n) for parents whose key is first..first+n-1; the others are
    counted, numbered and joined on the number.  The last of these joins bounds the rows of a task.
    """
    dense = list(dense) or [None] * len(parents)
    last = max((k for k, known in enumerate(dense) if not known), default=-1)
    sizes = [d[1] if d else p.count() for (p, _, _), d in zip(parents, dense, strict=True)]
    out = junction_codes(df, position, sizes, n_rows, seed=seed, table=table)
    for k, ((parent, columns, refs), known) in enumerate(zip(parents, dense, strict=True)):
        ix = f"ix{k}"
        if known:
            out = _with_columns(out, {columns[0]: F.col(ix) + known[0]})
            continue
        names = [f"_ref{i}" for i in range(len(columns))]
        numbered = dense_index(parent.select(*refs), refs, index=ix).select(
            ix, *[F.col(r).alias(n) for r, n in zip(refs, names, strict=True)]
        )
        joined = (spread_rows(out, n_rows, ix) if k == last else out).join(numbered, ix, "left")
        out = _with_columns(joined, {c: F.col(n) for c, n in zip(columns, names, strict=True)}, out)
    return out.select(*df.columns)


def fill_within_capacity(
    child: DataFrame,
    parent: DataFrame,
    columns: Sequence[str],
    ref_columns: Sequence[str],
    capacity: Column | int,
    *,
    position: str,
    n_rows: int,
) -> DataFrame:
    """Draw parents without replacement: a parent row is used at most ``capacity`` times.

    Each parent has as many slots as its capacity, numbered one parent after another; positions 0..n_rows-1 of
    the children are sent to distinct slots by a bijection.  Slots and parents meet by blocks of slots that hold about
    PARENTS_PER_BLOCK parents.  A capacity of 1 makes a UNIQUE foreign key.  Rows of the parent with a NULL
    in the key or without capacity are not used; ValueError if the slots do not suffice.
    """
    names = [f"_ref{k}" for k in range(len(columns))]
    cap = capacity if isinstance(capacity, Column) else F.lit(capacity)
    refs = list(ref_columns)
    slots = parent.dropna(subset=refs).select(*refs, cap.cast("bigint").alias("_cap")).where("_cap > 0")
    total, parents = slots.agg(F.coalesce(F.sum("_cap"), F.lit(0)), F.count("*")).first()
    if n_rows > total:
        raise ValueError(f"{n_rows} children for parents of capacity {total}")
    if not n_rows:
        return child
    slots = split_buckets(slots, refs, slots, PREFIX_LENGTH)
    within = W.partitionBy("_bucket", "_sub").orderBy(*refs).rowsBetween(W.unboundedPreceding, -1)
    offsets = bucket_offsets(slots, F.sum("_cap"))
    slots = slots.withColumn("_before", F.coalesce(F.sum("_cap").over(within), F.lit(0)))
    slots = slots.join(offsets, ["_bucket", "_sub"]).withColumn("_start", F.col("_offset") + F.col("_before"))
    width = max(1, PARENTS_PER_BLOCK * total // parents)
    blocks = F.sequence(F.expr(f"_start div {width}"), F.expr(f"(_start + _cap - 1) div {width}"))
    slots = slots.select(
        F.explode(blocks).alias("_block"), "_start", "_cap", *[F.col(r).alias(n) for r, n in zip(refs, names, strict=True)]
    )
    placed = child.withColumn("_slot", spread_position(F.col(position), total)).withColumn("_block", F.expr(f"_slot div {width}"))
    joined = placed.join(slots, (placed["_block"] == slots["_block"]) & F.expr("_slot >= _start AND _slot < _start + _cap"))
    return _with_columns(joined, {c: F.col(n) for c, n in zip(columns, names, strict=True)}, child)


def _with_columns(df: DataFrame, values: dict[str, Column], shape: DataFrame | None = None) -> DataFrame:
    """Set columns, in the column order and types of ``shape``."""
    shape = df if shape is None else shape
    typed = {
        c: v.cast(shape.schema[c].dataType) if c in shape.columns else v for c, v in values.items()
    }
    extra = [c for c in values if c not in shape.columns]
    return df.select(
        *[typed[c].alias(c) if c in typed else F.col(c) for c in shape.columns],
        *[typed[c].alias(c) for c in extra],
    )
