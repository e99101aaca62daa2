"""Column classification, fingerprints and inference over catalog tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relweave import schema as S
from relweave.functions.rules import NAME_RULES, PII_PATTERNS, TYPE_FALLBACKS
from relweave.functions.texts import array_sql, stack_rows, text_sql, value_text
from relweave.operators.discovery import inclusion_dependencies

CAMEL_FACTOR = 0.9
FALLBACK_CONFIDENCE = 0.5
FINGERPRINT_LENGTH = 16
SKETCH_ITEMS = 1024


def first_rule(name: str) -> Column:
    """Number of the first name rule that matches the SQL expression ``name``, else NULL.

    The rules are literals of one expression: each pattern is compiled once per task and
    no rule table has to be joined to the catalog.
    """
    tests = " ".join(f"WHEN {name} RLIKE {text_sql(rule[0])} THEN {k}" for k, rule in enumerate(NAME_RULES))
    return F.expr(f"CASE {tests} END")


# camelCase to camel_case, hyphens to underscores, lowercase
SPLIT_CAMEL = "lower(replace(regexp_replace(column, '([a-z])([A-Z])', '$1_$2'), '-', '_'))"


def _map_sql(values: Mapping[str, str]) -> str:
    if not values:
        return "cast(map() AS map<string, string>)"
    return "map(" + ", ".join(f"{text_sql(k)}, {text_sql(v)}" for k, v in values.items()) + ")"


def _params(rule: str) -> Column:
    """Rule parameters, overridden by column metadata."""
    with_params = [(k, r[4]) for k, r in enumerate(NAME_RULES) if r[4]]
    of_rule = (
        f"CASE {rule} " + " ".join(f"WHEN {k} THEN {_map_sql(p)}" for k, p in with_params)
        + f" ELSE {_map_sql({})} END"
    )
    own = (
        "map_filter(map('max_length', string(max_length), 'precision', string(precision), "
        "'scale', string(scale), 'enum_values', if(size(enum_values) > 0, to_json(enum_values), NULL)), "
        "(k, v) -> v IS NOT NULL)"
    )
    return F.expr(f"map_concat(map_filter({of_rule}, (k, v) -> NOT map_contains_key({own}, k)), {own})")


def map_columns(catalog: DataFrame) -> DataFrame:
    """Add ``generator, provider, confidence, params``: first rule on the lowercase name,
    then on the camel-split name (confidence x 0.9), then the type's fallback."""
    ruled = catalog.withColumn("_full", first_rule("lower(column)"))
    # only names the first pass left open, and only where splitting changes them
    retry = f"if(_full IS NULL AND {SPLIT_CAMEL} <> lower(column), {SPLIT_CAMEL}, NULL)"
    ruled = ruled.withColumn("_split_name", F.expr(retry))
    ruled = ruled.withColumn("_split", first_rule("_split_name")).withColumn("_rule", F.coalesce("_full", "_split"))

    def of_rule(position: int) -> str:
        return f"get({array_sql([r[position] for r in NAME_RULES])}, _rule)"

    by_type = f"coalesce(try_element_at({_map_sql(TYPE_FALLBACKS)}, data_type), 'random_string')"
    confidence = array_sql([r[3] for r in NAME_RULES]).replace(",", "D,").replace(")", "D)")
    certainty = (
        f"CASE WHEN _full IS NOT NULL THEN get({confidence}, _full) "
        f"WHEN _split IS NOT NULL THEN get({confidence}, _split) * {CAMEL_FACTOR}D "
        f"ELSE {FALLBACK_CONFIDENCE}D END"
    )
    return ruled.select(
        *catalog.columns,
        F.expr(f"coalesce({of_rule(1)}, {by_type})").alias("generator"),
        F.expr(f"coalesce({of_rule(2)}, 'builtin')").alias("provider"),
        F.expr(certainty).alias("confidence"),
        _params("_rule").alias("params"),
    )


def mapping_to_spec(mapped: DataFrame) -> DataFrame:
    """One column configuration per mapped column; no generator means the column default."""
    named = F.concat_ws(".", "provider", "generator")
    provider = F.when(F.col("generator").isNull(), "builtin.default").otherwise(named)
    return mapped.select("db", "table", "column", provider.alias("provider"), "params")


def flag_pii_columns(catalog: DataFrame) -> DataFrame:
    """Add ``is_pii``; one combined pattern, one search per name."""
    anywhere = "(?i)" + "|".join(f"(?:{p})" for p in PII_PATTERNS)
    return catalog.withColumn("is_pii", F.col("column").rlike(anywhere))


def check_values(catalog: DataFrame) -> DataFrame:
    """Add ``allowed``: sorted values of ``col IN ('a', 'b')`` in a CHECK, else NULL."""
    inside = F.regexp_extract("check_expr", r"(?i)\bIN\s*\(([^)]*)\)", 1)
    values = F.array_sort(F.regexp_extract_all(inside, F.lit(r"'([^']*)'"), F.lit(1)))
    return catalog.withColumn("allowed", F.when(F.size(values) > 0, values))


def schema_fingerprint(catalog: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """(db, fingerprint): the same for any order of tables, columns, enum values, foreign keys and indexes.

    ``references`` has one row to a foreign key or index: db, kind (``fk`` or ``index``), table, columns, ref_table,
    ref_columns, on_delete, on_update, deferrable, initially, unique.  Names of keys and comments take no part, nor does the
    order of columns inside a key.  Each line is hashed and the hashes are added up in four
    parts; sums combine on the map side, so the lines of a database never meet.
    """

    def hashed(rows: DataFrame, fields: list[str]) -> DataFrame:
        line = ", ".join(f"coalesce(string({f}), '\\\\N')" for f in fields)
        return rows.select("db", F.expr(f"sha2(concat_ws('\x1f', {line}), 256)").alias("_line"))

    lines = hashed(catalog, [
        "table", "column", "data_type", "nullable", "is_pk", "is_unique", "autoincrement", "default",
        "max_length", "precision", "scale", "array_join(array_sort(enum_values), '\x1e')", "check_expr",
    ])
    if references is not None:
        lines = lines.unionByName(hashed(references, [
            "kind", "table", "array_join(array_sort(columns), '\x1e')", "ref_table", "array_join(array_sort(ref_columns), '\x1e')",
            "on_delete", "on_update", "deferrable", "initially", "unique",
        ]))
    sums = [
        F.expr(f"string(sum(cast(conv(substring(_line, {1 + 16 * k}, 15), 16, 10) AS decimal(20, 0))))")
        for k in range(4)
    ]
    totals = F.concat_ws(":", F.count("*").cast("string"), *sums)
    return lines.groupBy("db").agg(totals.alias("_sums")).select(
        "db", F.substring(F.sha2("_sums", 256), 1, FINGERPRINT_LENGTH).alias("fingerprint")
    )


# --- inference ----------------------------------------------------------------
def column_profile(df: DataFrame, table: str, *, max_allowed: int = 20) -> DataFrame:
    """Per column: rows, nulls, distinct values, nullable/unique flags and allowed values.

    One grouping over the unpivoted columns.  Allowed values are listed for text columns
    with at most ``max_allowed`` distinct values.
    """
    rows = [
        [str(k), text_sql(c), text_sql(S.data_type_of(f.dataType)), value_text(c, f.dataType)]
        for k, (c, f) in enumerate(zip(df.columns, df.schema, strict=True))
    ]
    keys = ["ordinal", "column", "data_type"]
    grouped = (
        df.select(stack_rows(rows, [*keys, "value"])).groupBy(*keys, "value")
        .agg(F.count("*").alias("n"))
    )
    stats = grouped.groupBy(*keys).agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.count("value").alias("distinct_values"),
        # a sketch of fixed size, exact while the column has few values
        F.expr(f"approx_top_k(value, {max_allowed + 1}, {SKETCH_ITEMS})").alias("_top"),
    )
    filled = F.col("rows") - F.col("nulls")
    few = F.col("data_type").isin(list(S.CATEGORICAL)) & (F.col("distinct_values") <= max_allowed)
    values = F.array_sort(F.filter(F.transform("_top", lambda t: t["item"]), lambda v: v.isNotNull()))
    listed = F.when(few, F.array_join(values, "|"))
    return stats.select(
        F.lit(table).alias("table"), "ordinal", "column", "data_type", "rows", "nulls",
        "distinct_values",
        (F.col("nulls") > 0).alias("nullable"),
        ((filled > 0) & (F.col("distinct_values") == filled)).alias("is_unique"),
        ((F.col("nulls") == 0) & (filled > 0) & (F.col("distinct_values") == filled)).alias("pk_candidate"),
        F.coalesce(listed, F.lit("")).alias("allowed"),
    )


def infer_catalog(tables: Mapping[str, DataFrame], *, max_allowed: int = 20) -> DataFrame:
    """The profile of every column of every table."""
    return reduce(
        DataFrame.unionByName,
        [column_profile(df, name, max_allowed=max_allowed) for name, df in tables.items()],
    )


def fk_candidates(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Every pair (child column, parent column) that could be a foreign key, found by value alone.

    The parent's column is unique and holds all values of the child's; names take no part.
    """
    found = inclusion_dependencies(tables).where("parent_unique")
    return found.select("child", "column", "parent", "ref_column", "child_rows", "coverage")
