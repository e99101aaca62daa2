"""Fidelity of synthetic against reference data: KS, total variation, cardinality, correlation.

All per-column metrics come from one table of distinct values with a count per side.
It is built by one grouping over the unpivoted columns; the map side combines, so a
frequent value is one row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave import schema as S
from relweave.functions.texts import array_sql, name_sql, stack_rows, value_text
from relweave.operators.positions import running_before, slot_of

RANK_BUCKETS = 1024


def _number_sql(column: str, dtype: T.DataType) -> str:
    """As double; text that is no number and NaN become NULL, -0.0 becomes 0.0."""
    cast = "try_cast" if isinstance(dtype, T.StringType) else "cast"
    return f"nullif({cast}({name_sql(column)} AS double) + 0.0D, double('NaN'))"


def _slots(column: str, dtype: T.DataType, kind: str) -> list[str]:
    """(num, whole, txt): the value as double, and what a double would blur."""
    num, whole, txt = "double(NULL)", "bigint(NULL)", "string(NULL)"
    if kind != "numeric":
        txt = value_text(column, dtype)
    else:
        num = _number_sql(column, dtype)
        if isinstance(dtype, T.LongType):
            whole = name_sql(column)
        elif isinstance(dtype, (T.DecimalType, T.StringType)):
            txt = value_text(column, dtype)
    return [num, whole, txt]


def value_counts(
    reference: DataFrame, synthetic: DataFrame, columns: Mapping[str, str]
) -> DataFrame:
    """(column, kind, num, whole, txt, ref_n, syn_n): distinct non-null values per column.

    ``columns`` maps a name to its kind: ``numeric``, ``categorical`` or ``other``.
    """
    labels, kinds = list(columns), list(columns.values())

    def unpivot(df: DataFrame, is_reference: int) -> DataFrame:
        rows = [
            [str(k), *_slots(c, df.schema[c].dataType, kind), f"{name_sql(c)} IS NOT NULL"]
            for k, (c, kind) in enumerate(columns.items())
        ]
        return df.select(stack_rows(rows, ["_c", "num", "whole", "txt", "_present"])).where("_present").selectExpr(
            "_c", "num", "whole", "txt", f"{is_reference} AS ref", f"{1 - is_reference} AS syn"
        )

    both = unpivot(reference, 1).unionByName(unpivot(synthetic, 0))
    # the column number is the grouping key: shorter rows in the exchange than its name
    return both.groupBy("_c", "num", "whole", "txt").agg(
        F.sum("ref").alias("ref_n"), F.sum("syn").alias("syn_n")
    ).selectExpr(
        # never NULL, which keeps join filters from reaching below the grouping
        f"coalesce(get({array_sql(labels)}, _c), '') AS column",
        f"coalesce(get({array_sql(kinds)}, _c), '') AS kind",
        "num", "whole", "txt", "ref_n", "syn_n",
    )


def _share(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def tv_and_cardinality(counts: DataFrame) -> DataFrame:
    """Per column: totals and distinct counts per side, and both scores."""
    totals = counts.groupBy("column").agg(
        F.sum("ref_n").alias("ref_total"), F.sum("syn_n").alias("syn_total")
    )
    joined = counts.join(F.broadcast(totals), "column")  # one row per measured column
    gap = F.abs(
        F.coalesce(_share(F.col("ref_n"), F.col("ref_total")), F.lit(0.0))
        - F.coalesce(_share(F.col("syn_n"), F.col("syn_total")), F.lit(0.0))
    )
    stats = joined.groupBy("column", "kind").agg(
        F.max("ref_total").alias("ref_total"),
        F.max("syn_total").alias("syn_total"),
        F.count_if(F.col("ref_n") > 0).alias("ref_distinct"),
        F.count_if(F.col("syn_n") > 0).alias("syn_distinct"),
        F.sum(gap).alias("_distance"),
    )
    either_empty = (F.col("ref_total") == 0) | (F.col("syn_total") == 0)
    largest = F.greatest("ref_distinct", "syn_distinct").cast("double")
    return stats.select(
        "column", "kind", "ref_total", "syn_total", "ref_distinct", "syn_distinct",
        F.when(either_empty, 1.0).otherwise(1.0 - 0.5 * F.col("_distance")).alias("tv"),
        F.when(either_empty, 0.0)
        .otherwise(1.0 - F.abs(F.col("ref_distinct") - F.col("syn_distinct")) / largest)
        .alias("cardinality"),
    )


def ks_scores(counts: DataFrame, buckets: int = RANK_BUCKETS) -> DataFrame:
    """(column, ref_total, syn_total, ks): 1 - the two-sample KS statistic, exact.

    Distinct values are cut at approximate quantiles into buckets in value order, cumulated
    inside each bucket, and completed by the broadcast sums of the buckets before.  The
    cuts only balance the work; every value is counted where it belongs.
    """
    # tested above the grouping: all metrics then share one exchange of the value counts
    values = counts.where("if(ref_n + syn_n > 0, num, NULL) IS NOT NULL")
    cuts = values.groupBy("column").agg(
        F.percentile_approx("num", [k / buckets for k in range(1, buckets)]).alias("_cuts"),
        F.sum("ref_n").alias("ref_total"),
        F.sum("syn_n").alias("syn_total"),
    )
    slot = F.coalesce(slot_of(F.col("num"), F.col("_cuts"), buckets.bit_length()), F.lit(0))
    slotted = values.join(F.broadcast(cuts), "column").select(  # one row per measured column
        "column", "num", "ref_n", "syn_n", "ref_total", "syn_total", slot.alias("_slot")
    )
    by_slot = slotted.groupBy("column", "_slot", "ref_total", "syn_total").agg(
        F.sum("ref_n").alias("_ref"), F.sum("syn_n").alias("_syn")
    )
    offsets = by_slot.select(
        "column", "_slot",
        running_before("_ref", "_slot", "column").alias("_ref_before"),
        running_before("_syn", "_slot", "column").alias("_syn_before"),
        "ref_total", "syn_total",
    )
    within = W.partitionBy("column", "_slot").orderBy("num")  # equal numbers count together
    running = slotted.select(
        "column", "_slot",
        F.sum("ref_n").over(within).alias("_ref_run"),
        F.sum("syn_n").over(within).alias("_syn_run"),
    ).join(F.broadcast(offsets), ["column", "_slot"])  # at most `buckets` rows per column
    gap = F.abs(
        _share(F.col("_ref_before") + F.col("_ref_run"), F.col("ref_total"))
        - _share(F.col("_syn_before") + F.col("_syn_run"), F.col("syn_total"))
    )
    # one side empty: the shares are NULL and the score is 1
    return running.groupBy("column").agg(
        F.max("ref_total").alias("ref_total"),
        F.max("syn_total").alias("syn_total"),
        (1.0 - F.coalesce(F.max(gap), F.lit(0.0))).alias("ks"),
    )


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, j, r) for i < j plus (i, i, 1); pairwise complete rows, 0 where a side is constant.

    One aggregate over the rows, with the moments of every pair side by side; only its one row is spread
    into pairs.
    """
    names = [f"_v{k}" for k in range(len(columns))]
    values = df.select(*[F.expr(_number_sql(c, df.schema[c].dataType)).alias(n) for c, n in zip(columns, names, strict=True)])
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    moments = []
    for i, j in pairs:
        # pairs of which one side is missing take no part in any of the three
        x, y = f"if({names[j]} IS NULL, NULL, {names[i]})", f"if({names[i]} IS NULL, NULL, {names[j]})"
        moments.append(f"named_struct('n', count({x}), 'c', covar_pop({x}, {y}), 'sx', stddev_pop({x}), 'sy', stddev_pop({y})) AS p{i}_{j}")
    row = values.selectExpr(*moments) if moments else values.selectExpr("count(*) AS _none")
    cells = ", ".join(f"{i}, {j}, p{i}_{j}.n, p{i}_{j}.c, p{i}_{j}.sx, p{i}_{j}.sy" for i, j in pairs)
    moments = row.selectExpr(f"stack({len(pairs)}, {cells}) AS (i, j, _n, _c, _sx, _sy)").where("_n > 0")
    scale = F.nullif(F.col("_sx") * F.col("_sy"), F.lit(0.0))
    r = F.when(F.col("i") == F.col("j"), F.when(F.col("_sx") > 0, 1.0).otherwise(0.0)).otherwise(
        F.coalesce(F.col("_c") / scale, F.lit(0.0))
    )
    return moments.select("i", "j", F.nanvl(r, F.lit(0.0)).alias("r"))


def correlation_similarity(
    reference: DataFrame, synthetic: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """One row (column, correlation): max(0, 1 - Frobenius distance / sqrt(2 n^2)).

    Columns without a number on either side do not count; below two columns the score is 1.
    All tables here have a size fixed by the number of columns.
    """
    columns = sorted(columns)
    none = F.lit(None).cast("double")
    both = correlations(reference, columns).select("i", "j", F.col("r").alias("a"), none.alias("b"))
    both = both.unionByName(
        correlations(synthetic, columns).select("i", "j", none.alias("a"), F.col("r").alias("b"))
    )
    pairs = both.groupBy("i", "j").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    # one row from here on, so the moments are computed once
    gathered = pairs.agg(F.collect_list(F.struct("i", "j", "a", "b")).alias("_all"))
    usable = gathered.selectExpr(
        "_all",
        "transform(filter(_all, p -> p.i = p.j AND p.a IS NOT NULL AND p.b IS NOT NULL), p -> p.i) AS _in",
    )
    sums = usable.selectExpr(
        "double(size(_in)) AS _n",
        f"array_sort(transform(_in, i -> get({array_sql(columns)}, i))) AS _names",
        "aggregate(filter(_all, p -> array_contains(_in, p.i) AND array_contains(_in, p.j)), 0D, (s, p) -> "
        "s + if(p.i = p.j, 1D, 2D) * pow(coalesce(p.a, 0D) - coalesce(p.b, 0D), 2D)) AS _squares",
    )
    score = 1.0 - F.sqrt("_squares") / (F.sqrt(F.lit(2.0)) * F.col("_n"))
    return sums.select(
        F.array_join("_names", ", ").alias("column"),
        F.when(F.col("_n") < 2, 1.0).otherwise(F.greatest(F.lit(0.0), score)).alias("correlation"),
        F.col("_n").cast("int").alias("columns"),
    )


def column_kinds(table: S.Table, *frames: DataFrame) -> dict[str, str]:
    """name -> numeric / categorical / other, for columns every frame has."""
    shared = set.intersection(*[set(f.columns) for f in frames])
    return {
        c.name: "numeric" if c.data_type in S.NUMERIC
        else "categorical" if c.data_type in S.CATEGORICAL else "other"
        for c in table.columns
        if c.name in shared
    }


def table_fidelity(
    reference: DataFrame, synthetic: DataFrame, table: S.Table, buckets: int = RANK_BUCKETS
) -> DataFrame:
    """Rows ``(metric, table, column, score, details)`` of one table."""
    kinds = column_kinds(table, reference, synthetic)
    counts = value_counts(reference, synthetic, kinds)
    stats = tv_and_cardinality(counts).where("ref_total > 0 AND syn_total > 0")
    entries = F.array(
        F.struct(F.lit("tv_complement").alias("metric"), F.lit("tv").alias("short"),
                 F.when(F.col("kind") == "categorical", F.col("tv")).alias("score")),
        F.struct(F.lit("cardinality_similarity").alias("metric"), F.lit("card").alias("short"),
                 F.col("cardinality").alias("score")),
    )
    parts = [
        stats.select("column", F.explode(entries).alias("e"))
        .select("e.metric", "e.short", "column", "e.score").where("score IS NOT NULL")
    ]
    numeric = sorted(c for c, kind in kinds.items() if kind == "numeric")
    if numeric:
        parts.append(
            ks_scores(counts, buckets).where("ref_total > 0 AND syn_total > 0").select(
                F.lit("ks_complement").alias("metric"), F.lit("ks").alias("short"),
                "column", F.col("ks").alias("score"),
            )
        )
    if len(numeric) >= 2:
        parts.append(
            correlation_similarity(reference, synthetic, numeric).where("columns >= 2").select(
                F.lit("correlation_similarity").alias("metric"), F.lit("corr").alias("short"),
                "column", F.col("correlation").alias("score"),
            )
        )
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select(
        "metric", F.lit(table.name).alias("table"), "column", "score",
        F.concat("short", F.lit("_score="), F.format_string("%.3f", "score")).alias("details"),
    )


def validate_fidelity(
    synthetic: Mapping[str, DataFrame], reference: Mapping[str, DataFrame], db: S.Database
) -> DataFrame:
    """Metrics of every table present on both sides."""
    parts = [
        table_fidelity(reference[t.name], synthetic[t.name], t)
        for t in db.tables
        if t.name in synthetic and t.name in reference
    ]
    if not parts:
        raise ValueError("no table is present on both sides")
    return reduce(DataFrame.unionByName, parts)


def fidelity_verdict(metrics: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row: plain mean of all scores (0.0 without metrics), and whether it reaches the threshold."""
    overall = F.coalesce(F.avg("score"), F.lit(0.0))
    return metrics.agg(
        F.count("*").alias("metrics"),
        overall.alias("overall_score"),
        (overall >= F.lit(float(threshold))).alias("passed"),
    )
