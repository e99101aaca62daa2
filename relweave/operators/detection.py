"""Detection: how well a classifier tells synthetic from real rows (two-sample test).

Scaling and category codes are fitted on all rows; the classifier sees at most
MAX_SAMPLE rows of each class, which is part of the measure.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relweave import schema as S
from relweave.functions.texts import name_sql, stack_rows, text_sql
from relweave.operators.positions import dense_codes, key_text, running_before, spread_copies
from relweave.session import written

MAX_SAMPLE = 10_000
MIN_ROWS = 10
FOLDS = 5
MAX_STEPS = 40
TOLERANCE = 1e-9  # of a weight in one Newton step
TABLES_AT_ONCE = 4
PREFIX_LENGTH = 4


def subsample(df: DataFrame, limit: int = MAX_SAMPLE, row_key: Sequence[str] | None = None) -> DataFrame:
    """``limit`` rows without replacement: those with the lowest digest, kept in ``_rank``.

    ``row_key`` names columns that identify a row.  Without it equal rows are counted and
    every copy gets a digest of its own.  A histogram of digest prefixes finds where the
    limit falls, so only about ``limit`` rows reach the final sort.
    """
    if row_key:
        ranked = df.withColumn("_rank", F.md5(key_text(row_key)))
    else:
        # the digest of the row is made once, before the grouping; later steps only extend it
        digested = df.withColumn("_digest", F.md5(key_text(df.columns)))
        copies = digested.groupBy("_digest", *df.columns).agg(F.count("*").alias("_copies"))
        rank = F.md5(F.concat_ws(":", "_digest", F.col("_copy").cast("string")))
        ranked = spread_copies(copies).select(*df.columns, rank.alias("_rank"))
    prefix = F.substring("_rank", 1, PREFIX_LENGTH)
    histogram = ranked.groupBy(prefix.alias("_prefix")).agg(F.count("*").alias("_n"))
    # at most 16^PREFIX_LENGTH rows
    cut = (
        histogram.withColumn("_before", running_before("_n", "_prefix"))
        .where(F.col("_before") < limit).agg(F.max("_prefix")).scalar()
    )
    return ranked.where(prefix <= cut).orderBy("_rank").limit(limit)


def _number(name: str, dtype) -> Column:
    """Anything that is no number becomes 0.0."""
    value = F.col(name)
    value = value.try_cast("double") if dtype.typeName() == "string" else value.cast("double")
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


def _long(columns: Sequence[str]) -> Column:
    return stack_rows([[text_sql(c), name_sql(c)] for c in columns], ["column", "value"])


def category_codes(combined: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, code): place of each distinct text value in its column's sorted order."""
    distinct = combined.select(_long(columns)).distinct().selectExpr(
        # never NULL, which keeps join filters above the grouping, so that it is shared
        "coalesce(column, '') AS column", "coalesce(value, '') AS value",
    )
    return dense_codes(distinct, ["column"], "value")


def features(
    real: DataFrame,
    synthetic: DataFrame,
    table: S.Table,
    *,
    limit: int = MAX_SAMPLE,
    row_key: Sequence[str] | None = None,
) -> tuple[DataFrame, list[str]]:
    """Sampled rows ``(label, _rank, one double per feature)`` and the usable feature names.

    Numbers are standardized by mean and population deviation of all rows of both sides;
    other columns become the ordinal code of their text among all distinct texts.
    Features without variance are dropped.
    """
    kinds = {c.name: c.data_type in S.NUMERIC for c in table.columns}
    shared = sorted(set(real.columns) & set(synthetic.columns) & set(kinds))
    numeric = [c for c in shared if kinds[c]]
    other = [c for c in shared if not kinds[c]]

    def plain(df: DataFrame) -> DataFrame:
        return df.select(
            *[_number(c, df.schema[c].dataType).alias(c) for c in numeric],
            *[F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c) for c in other],
        )

    combined = plain(real).unionByName(plain(synthetic))
    stats = combined.agg(
        *[F.avg(c).alias(f"m_{c}") for c in numeric],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in numeric],
        *[(F.min(c) < F.max(c)).alias(f"v_{c}") for c in other],
    ).first()  # one row, as wide as the table
    usable = [c for c in numeric if stats[f"s_{c}"]] + [c for c in other if stats[f"v_{c}"]]
    numeric = [c for c in numeric if c in usable]
    other = [c for c in other if c in usable]

    def sample(df: DataFrame, label: int) -> DataFrame:
        rows = subsample(df.select(*dict.fromkeys([*shared, *(row_key or [])])), limit, row_key)
        return rows.select(
            F.lit(label).alias("label"), "_rank",
            *[
                ((_number(c, df.schema[c].dataType) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"])).alias(c)
                for c in numeric
            ],
            *[F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c) for c in other],
        )

    sampled = sample(real, 1).unionByName(sample(synthetic, 0))
    if other:
        long = sampled.select("label", "_rank", *numeric, _long(other))
        coded = category_codes(combined, other).join(long, ["column", "value"])
        sampled = coded.groupBy("label", "_rank", *numeric).pivot("column", other).agg(F.max("code"))
        sampled = sampled.select(
            "label", "_rank", *numeric, *[F.col(c).cast("double").alias(c) for c in other]
        )
    return sampled, usable


def _fold_sums(folded: DataFrame, width: int, weights: np.ndarray) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """For each fold: loss, gradient and Gram matrix of the rows outside of it, at the weights of its fit.

    One aggregate for all fits.  The weights come as a table of FOLDS rows, so every step runs the same compiled plan.
    """
    spark = folded.sparkSession
    given = spark.createDataFrame([(f, w.tolist()) for f, w in enumerate(weights)], "fit int, w array<double>")
    others = F.expr(f"explode(filter(sequence(0, {FOLDS - 1}), f -> f <> fold)) AS fit")
    rows = folded.select("*", others).join(F.broadcast(given), "fit")  # FOLDS rows
    places = range(width)
    rows = rows.withColumn("eta", F.expr(" + ".join(f"w[{j}] * x{j}" for j in places)))
    rows = rows.withColumn("p", F.expr("1 / (1 + exp(-eta))"))
    rows = rows.selectExpr(
        "fit", *[f"x{j}" for j in places], "p - label AS e", "p * (1 - p) AS v",
        "greatest(eta, 0D) + log1p(exp(-abs(eta))) - label * eta AS loss",
    )
    sums = [f"sum(e * x{j}) AS g{j}" for j in places] + [f"sum(v * x{i} * x{j}) AS h{i}_{j}" for i in places for j in places if i <= j]
    out = {}
    for r in rows.groupBy("fit").agg(F.sum("loss").alias("loss"), *[F.expr(x) for x in sums]).collect():
        gram = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in places] for i in places])
        out[r["fit"]] = (r["loss"], np.array([r[f"g{j}"] for j in places]), gram)
    return out


def fit_folds(folded: DataFrame, width: int) -> np.ndarray:
    """Weights of the logistic regression of every fold's training part, all folds fitted side by side.

    Newton steps on the log loss plus half the squared weights, the first one (constant) free of
    penalty.  A step that raises the loss is halved.  Sums come from Spark, the equations of ``width``
    unknowns are solved here.  Nothing is drawn, so the result is the same each time.
    """
    penalty = np.ones(width)
    penalty[0] = 0.0
    now, before = np.zeros((FOLDS, width)), np.zeros((FOLDS, width))
    least = np.full(FOLDS, np.inf)
    open_ = set(range(FOLDS))
    for _ in range(MAX_STEPS):
        found = _fold_sums(folded, width, now)
        open_ &= set(found)
        for fold in sorted(open_):
            loss, gradient, gram = found[fold]
            loss += 0.5 * float(penalty @ now[fold] ** 2)
            if loss > least[fold] + 1e-9 * abs(least[fold]):
                now[fold] = (now[fold] + before[fold]) / 2
                continue
            least[fold], before[fold] = loss, now[fold].copy()
            step = np.linalg.lstsq(gram + np.diag(penalty), gradient + penalty * now[fold], rcond=None)[0]
            now[fold] = now[fold] - step
            if np.abs(step).max() < TOLERANCE:
                open_.discard(fold)
        if not open_:
            break
    return now


def c2st_accuracy(sampled: DataFrame, columns: Sequence[str]) -> float:
    """Mean accuracy of 5-fold stratified logistic regression with an L2 strength of 1; 0.5 without features."""
    if not columns:
        return 0.5
    place = F.row_number().over(W.partitionBy("label").orderBy("_rank"))  # bounded by the sample
    features_ = [F.lit(1.0).alias("x0"), *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(columns, 1)]]
    folded = sampled.select(F.col("label").cast("double").alias("label"), (place % FOLDS).cast("int").alias("fold"), *features_)
    folded = written(folded, "folds")
    if folded.isEmpty():
        return 0.5
    width = len(columns) + 1
    weights = fit_folds(folded, width)
    given = folded.sparkSession.createDataFrame([(f, w.tolist()) for f, w in enumerate(weights)], "fold int, w array<double>")
    eta = F.expr(" + ".join(f"w[{j}] * x{j}" for j in range(width)))
    right = ((eta > 0) == (F.col("label") > 0)).cast("double")
    scores = folded.join(F.broadcast(given), "fold").groupBy("fold").agg(F.avg(right).alias("accuracy"))  # FOLDS rows
    return scores.agg(F.avg("accuracy")).first()[0]


def validate_detection(
    synthetic: Mapping[str, DataFrame],
    reference: Mapping[str, DataFrame],
    db: S.Database,
    *,
    row_keys: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Rows ``(metric, table, accuracy, details)``; tables below 10 rows per class are left out."""
    spark = next(iter({**synthetic, **reference}.values())).sparkSession

    def measure(table: S.Table) -> tuple | None:
        syn, ref = synthetic.get(table.name), reference.get(table.name)
        if syn is None or ref is None:
            return None
        if min(syn.limit(MIN_ROWS).count(), ref.limit(MIN_ROWS).count()) < MIN_ROWS:
            return None
        row_key = (row_keys or {}).get(table.name) or list(table.primary_key) or None
        sampled, columns = features(ref, syn, table, row_key=row_key)
        if not columns:
            return None
        accuracy = c2st_accuracy(sampled, columns)
        return "c2st", table.name, accuracy, f"c2st_accuracy={accuracy:.3f}"

    # samples are small: the jobs of several tables run side by side
    with ThreadPool(TABLES_AT_ONCE) as pool:
        rows = [r for r in pool.map(inheritable_thread_target(spark)(measure), db.tables) if r]
    return spark.createDataFrame(rows, "metric string, table string, accuracy double, details string")


def detection_verdict(metrics: DataFrame, threshold: float = 0.6) -> DataFrame:
    """One row: mean accuracy (0.5 without metrics); passes at or below the threshold."""
    overall = F.coalesce(F.avg("accuracy"), F.lit(0.5))
    return metrics.agg(
        F.count("*").alias("metrics"),
        overall.alias("overall_score"),
        (overall <= F.lit(float(threshold))).alias("passed"),
    )
