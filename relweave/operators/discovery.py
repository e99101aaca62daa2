"""Keys found in the data: inclusion dependencies by value, and minimal unique column sets.

Nothing here looks at names.  All tables are read once for all pairs of columns: values of all
columns meet in one grouping, counted in tasks first, so a value that fills a third of a table is one
row per task and column.  What leaves a grouping is bound by the number of columns, not rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave.functions.texts import array_sql, name_sql, stack_rows, text_sql, value_text

WORD = 63  # columns in one word of a set of columns
SAMPLE_ROWS = 1_000_000  # about as many rows of a table test a candidate before all do


def value_class(dtype: T.DataType) -> str | None:
    """Columns of one class are compared; None for nested types, which are no keys."""
    if isinstance(dtype, (T.IntegralType, T.DecimalType)):
        return "exact"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(dtype, T.StringType):
        return "text"
    return dtype.typeName() if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType, T.BinaryType)) else None


def class_text(column: str, dtype: T.DataType) -> str:
    """Text equal exactly where two values of one class are; 5, 5.0 and 5.00 are one exact number."""
    if isinstance(dtype, T.DecimalType) and dtype.scale > 0:
        return f"regexp_replace(string({name_sql(column)}), '[.]?0*$', '')"
    return value_text(column, dtype)


class _Sets:
    """Sets of numbered columns as words of bits."""

    def __init__(self, count: int) -> None:
        self.count, self.words = count, range(-(-count // WORD))

    def word(self, k: int, column: str, when: str = "true") -> Column:
        return F.expr(f"if({column} div {WORD} = {k} AND {when}, shiftleft(1L, int({column} % {WORD})), 0L)")

    def holds(self, mark: str, column: str) -> str:
        """SQL test: the set in columns ``mark0``, ``mark1``, ... holds the number ``column``."""
        words = ", ".join(f"{mark}{k}" for k in self.words)
        return f"shiftright(get(array({words}), int({column} div {WORD})), int({column} % {WORD})) % 2 = 1"


def inclusion_dependencies(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Every pair of columns where each value of one is a value of the other.

    Columns: child, column, parent, ref_column, child_rows and child_values (not NULL, distinct),
    coverage (share of the parent's values that the child has), parent_unique.  A column without
    values takes no part; NULL is no value; a table may refer to another column of its own.

    A value's row holds the set of columns that have it.  Equal sets are counted, and the sets
    that hold a column are intersected: what is left are the columns that include it.
    """
    known = [(t, f.name, f.dataType) for t, df in tables.items() for f in df.schema if value_class(f.dataType)]
    sets = _Sets(len(known))
    cells: dict[str, list[list[str]]] = {}
    for number, (table, column, dtype) in enumerate(known):
        cells.setdefault(table, []).append([str(number), text_sql(value_class(dtype)), class_text(column, dtype)])
    values = reduce(
        DataFrame.unionByName, [tables[t].select(stack_rows(rows, ["number", "class", "value"])) for t, rows in cells.items()]
    ).where("value IS NOT NULL")
    grouped = values.groupBy("class", "value", "number").agg(F.count("*").alias("n"))
    marks = [F.bit_or(sets.word(k, "number")).alias(f"m{k}") for k in sets.words]
    marks += [F.bit_or(sets.word(k, "number", "n > 1")).alias(f"r{k}") for k in sets.words]
    kinds = grouped.groupBy("class", "value").agg(*marks)
    kinds = kinds.groupBy(*kinds.columns[2:]).agg(F.count("*").alias("values"))
    every = F.explode(F.expr(f"sequence(0, {len(known) - 1})"))
    columns = kinds.select("*", every.alias("number")).where(sets.holds("m", "number")).groupBy("number").agg(
        F.sum("values").alias("values"), F.bool_or(F.expr(sets.holds("r", "number"))).alias("repeats"),
        *[F.bit_and(f"m{k}").alias(f"m{k}") for k in sets.words],
    )
    rows = grouped.groupBy("number").agg(F.sum("n").alias("child_rows"))
    parents = F.broadcast(columns.select(F.col("number").alias("ref"), F.col("values").alias("ref_values"), "repeats"))  # one row to a column
    pairs = (
        columns.drop("repeats").join(F.broadcast(rows), "number").select("*", every.alias("ref"))
        .where(f"ref <> number AND {sets.holds('m', 'ref')}").join(parents, "ref")
    )

    def name(k: int, number: str, alias: str) -> Column:
        return F.expr(f"get({array_sql([c[k] for c in known])}, {number})").alias(alias)

    return pairs.select(
        name(0, "number", "child"), name(1, "number", "column"), name(0, "ref", "parent"), name(1, "ref", "ref_column"),
        "child_rows", F.col("values").alias("child_values"), (F.col("values") / F.col("ref_values")).alias("coverage"),
        (~F.col("repeats")).alias("parent_unique"),
    )


# --- unique column sets ---------------------------------------------------------
def _digest(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """128 bits of a row's values in the columns; NULL is a value of its own, 0.0 and -0.0 are one."""
    parts = []
    for c in columns:
        value = name_sql(c)
        if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
            value = f"({value} + 0.0D)"
        parts += [value, f"{name_sql(c)} IS NULL"]
    text = ", ".join(parts)
    return [f"xxhash64({text})", f"xxhash64('b', {text})"]


def _repeated(tables: Mapping[str, DataFrame], candidates: Sequence[tuple[str, tuple[str, ...]]], shares: Mapping[str, int]) -> set[int]:
    """Numbers of the candidates (table, columns) that some rows share a key of.

    Of a table with ``shares`` above 1 one digest in so many is looked at: equal keys have
    equal digests, so repeats found there are repeats, and others may be missed.
    """
    cells: dict[str, list[list[str]]] = {}
    for number, (table, columns) in enumerate(candidates):
        cells.setdefault(table, []).append([str(number), *_digest(tables[table], columns)])
    parts = []
    for table, rows in cells.items():
        part = tables[table].select(stack_rows(rows, ["number", "h1", "h2"]))
        share = shares.get(table, 1)
        parts.append(part.where(f"pmod(h1, {share}) = 0") if share > 1 else part)
    if not parts:
        return set()
    found = reduce(DataFrame.unionByName, parts).groupBy("number", "h1", "h2").count().where("count > 1")
    return {r["number"] for r in found.select("number").distinct().collect()}  # at most one row to a candidate


def _level_one(tables: Mapping[str, DataFrame]) -> dict[str, dict[str, tuple[int, int, int]]]:
    """table -> column -> (rows, nulls, distinct values, NULL being one), from one grouping over all tables."""
    parts = []
    names = [(t, f.name) for t, df in tables.items() for f in df.schema if not isinstance(f.dataType, T.MapType)]
    for t, df in tables.items():
        rows = [[str(n), *_digest(df, [c]), f"{name_sql(c)} IS NULL"] for n, (u, c) in enumerate(names) if u == t]
        parts.append(df.select(stack_rows(rows, ["number", "h1", "h2", "empty"])))
    grouped = reduce(DataFrame.unionByName, parts).groupBy("number", "h1", "h2", "empty").agg(F.count("*").alias("n"))
    found = grouped.groupBy("number").agg(F.sum("n").alias("rows"), F.sum(F.expr("if(empty, n, 0L)")).alias("nulls"), F.count("*").alias("values"))
    out: dict[str, dict[str, tuple[int, int, int]]] = {t: {} for t in tables}
    for r in found.collect():  # one row to a column
        t, c = names[r["number"]]
        out[t][c] = (r["rows"], r["nulls"], r["values"])
    return out


def unique_column_sets(tables: Mapping[str, DataFrame], *, max_width: int = 2, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Minimal sets of at most ``max_width`` columns in which no two rows of a table agree.

    Columns: table, columns, width, rows, nullable, pk_candidate.  NULL counts as a value, as in
    a primary key; ``nullable`` tells that the set holds one.  Tables without rows have no sets.

    Sets are searched by width, all tables together.  No superset of a unique set is tried; a table two
    of whose rows are equal has none; a set cannot be unique if its columns' distinct values multiply
    to fewer than the rows.  Of large tables a sample by digest refutes most sets; one pass over all rows
    confirms the rest of a width.
    """
    spark = next(iter(tables.values())).sparkSession
    stats = _level_one(tables)
    live = {t: [c for c in tables[t].columns if c in stats[t]] for t in tables if stats[t] and next(iter(stats[t].values()))[0] > 0}
    rows = {t: next(iter(stats[t].values()))[0] for t in live}
    shares = {t: max(1, n // sample_rows) for t, n in rows.items()}
    found: dict[str, list[tuple[str, ...]]] = {t: [(c,) for c in live[t] if stats[t][c][2] == rows[t]] for t in live}
    # tables without a unique column may have equal rows, and then no set at all
    whole = [(t, tuple(live[t])) for t in live if not found[t]]
    equal = {whole[n][0] for n in _repeated(tables, whole, {})}
    for width in range(2, max_width + 1):
        level = []
        for t in live:
            if t in equal:
                continue
            open_ = [c for c in live[t] if (c,) not in found[t]]
            for columns in combinations(open_, width):
                some = set(columns)
                if any(some.issuperset(f) for f in found[t]):
                    continue
                most = 1
                for c in columns:
                    most *= stats[t][c][2]
                if most >= rows[t]:
                    level.append((t, columns))
        sampled = {t: s for t, s in shares.items() if s > 1}
        if sampled:
            bad = _repeated(tables, [c for c in level if c[0] in sampled], sampled)
            tested = [c for c in level if c[0] in sampled]
            refuted = {tested[n] for n in bad}
            level = [c for c in level if c not in refuted]
        bad = _repeated(tables, level, {})
        for number, (t, columns) in enumerate(level):
            if number not in bad:
                found[t].append(columns)
    out = []
    for t, sets in found.items():
        for columns in sets:
            empty = any(stats[t][c][1] for c in columns)
            out.append((t, list(columns), len(columns), rows[t], empty, not empty))
    return spark.createDataFrame(out, "table string, columns array<string>, width int, rows bigint, nullable boolean, pk_candidate boolean")


# --- composite foreign keys --------------------------------------------------------
def _composite_candidates(pairs: Iterable, keys: Iterable[tuple[str, Sequence[str]]]) -> list[tuple[str, tuple[str, ...], str, tuple[str, ...]]]:
    """(child, columns, parent, key) whose columns are included one by one; a column stands for one key column only."""
    included: dict[tuple[str, str], dict[str, list[str]]] = {}
    for r in pairs:
        included.setdefault((r["parent"], r["ref_column"]), {}).setdefault(r["child"], []).append(r["column"])
    out = []
    for parent, key in keys:
        for child in sorted(set().union(*[included.get((parent, k), {}) for k in key])):
            choices = [included.get((parent, k), {}).get(child, []) for k in key]
            if child == parent:
                choices = [[*own, k] for own, k in zip(choices, key, strict=True)]
            out += [
                (child, columns, parent, tuple(key)) for columns in product(*choices)
                if len(set(columns)) == len(columns) and not (child == parent and set(columns) & set(key))
            ]
    return out


def composite_foreign_keys(tables: Mapping[str, DataFrame], keys: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Column tuples of one table whose every complete tuple is a key of another, for the composite keys given.

    ``keys`` has (table, columns), as :func:`unique_column_sets` returns them; single columns are left to
    :func:`inclusion_dependencies`.  Result: child, columns, parent, ref_columns, child_rows.

    Level by level: a tuple is tried only if each of its columns is included in its key column.  A
    sample by digest of the tuples, the same on both sides, refutes most of the tries; one grouping of the
    tuples of all others, which holds the set of tries that have a tuple, confirms the rest.
    """
    spark = keys.sparkSession
    schema = "child string, columns array<string>, parent string, ref_columns array<string>, child_rows bigint"
    composite = [(r["table"], r["columns"]) for r in keys.where(F.size("columns") > 1).select("table", "columns").collect()]
    if not composite:
        return spark.createDataFrame([], schema)
    pairs = inclusion_dependencies(tables).select("child", "column", "parent", "ref_column").collect()  # at most the square of the columns
    tries = _composite_candidates(pairs, composite)
    rows = max((df.count() for df in tables.values()), default=0)
    if rows > sample_rows and tries:
        held = _contained(tables, tries, rows // sample_rows)
        tries = [t for n, t in enumerate(tries) if n in held]
    held = _contained(tables, tries, 1)
    return spark.createDataFrame([(c, list(a), p, list(b), held[n]) for n, (c, a, p, b) in enumerate(tries) if held.get(n)], schema)


def _tuple_text(df: DataFrame, columns: Sequence[str]) -> str:
    """The values as one text with their lengths before them, NULL if one is NULL."""
    texts = [class_text(c, df.schema[c].dataType) for c in columns]
    return "concat(" + ", ".join(f"string(length({t})), ':', {t}" for t in texts) + ")"


def _contained(tables: Mapping[str, DataFrame], tries: Sequence[tuple], share: int) -> dict[int, int]:
    """Tries without a child tuple that the parent lacks, with their numbers of complete child tuples."""
    if not tries:
        return {}
    sets = _Sets(len(tries))
    owners = sorted({(p, b) for _, _, p, b in tries})
    cells: dict[str, list[list[str]]] = {}
    for number, (child, columns, parent, key) in enumerate(tries):
        owner = owners.index((parent, key))
        cells.setdefault(child, []).append([str(owner), str(number), _tuple_text(tables[child], columns)])
    for owner, (parent, key) in enumerate(owners):
        cells.setdefault(parent, []).append([str(owner), "-1", _tuple_text(tables[parent], key)])
    values = reduce(
        DataFrame.unionByName, [tables[t].select(stack_rows(r, ["owner", "number", "value"])) for t, r in cells.items()]
    ).where("value IS NOT NULL")
    if share > 1:
        values = values.where(F.pmod(F.xxhash64("value"), F.lit(share)) == 0)
    grouped = values.groupBy("owner", "value", "number").agg(F.count("*").alias("n"))
    by_value = grouped.groupBy("owner", "value").agg(
        F.max((F.col("number") < 0).cast("int")).alias("there"),
        *[F.bit_or(F.when(F.col("number") >= 0, sets.word(k, "number")).otherwise(F.lit(0).cast("bigint"))).alias(f"m{k}") for k in sets.words],
    )
    lacking = by_value.where("there = 0").agg(*[F.coalesce(F.bit_or(f"m{k}"), F.lit(0)).alias(f"m{k}") for k in sets.words]).first()
    counts = {r["number"]: r["n"] for r in grouped.where("number >= 0").groupBy("number").agg(F.sum("n").alias("n")).collect()}
    if share > 1:  # tuples that the sample does not hold are no proof against a try
        counts = {n: counts.get(n, 0) for n in range(len(tries))}
    return {n: c for n, c in counts.items() if not lacking[n // WORD] >> (n % WORD) & 1}
