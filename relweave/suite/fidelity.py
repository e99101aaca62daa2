"""Fidelity and detection: even against odd orders, and a shifted copy."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave import schema as S
from relweave.operators import detection as D
from relweave.operators import fidelity as Q
from relweave.suite.base import STAR, query

LINEITEM = STAR.table("lineitem")
ORDERS = STAR.table("orders")
NUMERIC = [c.name for c in LINEITEM.columns if c.data_type in S.NUMERIC]
CATEGORICAL = [c.name for c in LINEITEM.columns if c.data_type in S.CATEGORICAL]


def _sides(t):
    return t.lineitem.where("l_orderkey % 2 = 0"), t.lineitem.where("l_orderkey % 2 = 1")


def _shifted(t):
    """Prices a quarter higher, no returns, every fifth quantity missing."""
    return t.lineitem.withColumns(
        {
            "l_extendedprice": F.col("l_extendedprice") * 1.25,
            "l_returnflag": F.expr("replace(l_returnflag, 'R', 'A')"),
            "l_quantity": F.expr("if(l_partkey % 5 = 0, NULL, l_quantity)"),
        }
    )


EVEN = "(SELECT * FROM lineitem WHERE l_orderkey % 2 = 0)"
ODD = "(SELECT * FROM lineitem WHERE l_orderkey % 2 = 1)"
SHIFTED = (
    "(SELECT * REPLACE (l_extendedprice * 1.25::DOUBLE AS l_extendedprice, replace(l_returnflag, 'R', 'A') AS l_returnflag, "
    "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_quantity END AS l_quantity) FROM lineitem)"
)


def ks_sql(column: str, ref: str, syn: str) -> str:
    return f"""SELECT 1 - max(abs(fr - fs)) FROM (
      SELECT v, sum(r) OVER (ORDER BY v) / (SELECT count({column}) FROM {ref})::DOUBLE AS fr,
             sum(s) OVER (ORDER BY v) / (SELECT count({column}) FROM {syn})::DOUBLE AS fs
      FROM (SELECT v, sum(r)::DOUBLE AS r, sum(s)::DOUBLE AS s FROM (
        SELECT {column}::DOUBLE + 0 AS v, 1 AS r, 0 AS s FROM {ref} WHERE {column} IS NOT NULL
        UNION ALL SELECT {column}::DOUBLE + 0, 0, 1 FROM {syn} WHERE {column} IS NOT NULL) GROUP BY v))"""


def tv_sql(column: str, ref: str, syn: str) -> str:
    return f"""SELECT 1 - 0.5::DOUBLE * sum(abs(coalesce(p, 0) - coalesce(q, 0))) FROM
      (SELECT {column} AS v, count(*)::DOUBLE / (SELECT count({column}) FROM {ref}) AS p FROM {ref} WHERE {column} IS NOT NULL GROUP BY 1) a
      FULL JOIN (SELECT {column} AS v, count(*)::DOUBLE / (SELECT count({column}) FROM {syn}) AS q FROM {syn} WHERE {column} IS NOT NULL GROUP BY 1) b USING (v)"""


def card_sql(column: str, ref: str, syn: str) -> str:
    r, s = f"(SELECT count(DISTINCT {column}) FROM {ref})", f"(SELECT count(DISTINCT {column}) FROM {syn})"
    return f"SELECT 1 - abs({r} - {s})::DOUBLE / greatest({r}, {s})"


def corr_sql(columns: list[str], ref: str, syn: str) -> str:
    columns = sorted(columns)
    n = len(columns)

    def r(a: str, b: str, side: str) -> str:
        return (
            f"(SELECT coalesce(covar_pop({a}::DOUBLE, {b}::DOUBLE) / nullif(stddev_pop({a}::DOUBLE) * stddev_pop({b}::DOUBLE), 0), 0) "
            f"FROM {side} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
        )

    squares = " + ".join(
        f"2 * pow({r(columns[i], columns[j], ref)} - {r(columns[i], columns[j], syn)}, 2)"
        for i in range(n) for j in range(i + 1, n)
    )
    return f"SELECT greatest(0, 1 - sqrt({squares}) / sqrt({2.0 * n * n}::DOUBLE))"


def metric_rows(metric: str, column: str, table: str, score: str) -> str:
    short = {"ks_complement": "ks", "tv_complement": "tv", "cardinality_similarity": "card", "correlation_similarity": "corr"}[metric]
    return (
        f"SELECT '{metric}' AS metric, '{table}' AS \"table\", '{column}' AS \"column\", round(({score}), 9) AS score, "
        f"'{short}_score=' || printf('%.3f', ({score})) AS details"
    )


def report_sql(table: S.Table, ref: str, syn: str) -> str:
    rows = []
    numeric = [c.name for c in table.columns if c.data_type in S.NUMERIC]
    for c in table.columns:
        if c.data_type in S.NUMERIC:
            rows.append(metric_rows("ks_complement", c.name, table.name, ks_sql(c.name, ref, syn)))
        elif c.data_type in S.CATEGORICAL:
            rows.append(metric_rows("tv_complement", c.name, table.name, tv_sql(c.name, ref, syn)))
        rows.append(metric_rows("cardinality_similarity", c.name, table.name, card_sql(c.name, ref, syn)))
    rows.append(metric_rows("correlation_similarity", ", ".join(sorted(numeric)), table.name, corr_sql(numeric, ref, syn)))
    return " UNION ALL ".join(rows)


def _scores(columns: list[str], make, ref: str, syn: str, name: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(({make(c, ref, syn)}), 9) AS {name}" for c in columns
    )


@query("fid_ks", _scores(NUMERIC, ks_sql, EVEN, ODD, "ks"))
def fid_ks(t):
    counts = Q.value_counts(*_sides(t), {c: "numeric" for c in NUMERIC})
    return Q.ks_scores(counts).select("column", F.round("ks", 9).alias("ks"))


@query("fid_ks_shifted", _scores(NUMERIC, ks_sql, "lineitem", SHIFTED, "ks"))
def fid_ks_shifted(t):
    counts = Q.value_counts(t.lineitem, _shifted(t), {c: "numeric" for c in NUMERIC})
    return Q.ks_scores(counts).select("column", F.round("ks", 9).alias("ks"))


@query("fid_tv", _scores(CATEGORICAL, tv_sql, "lineitem", SHIFTED, "tv"))
def fid_tv(t):
    counts = Q.value_counts(t.lineitem, _shifted(t), {c: "categorical" for c in CATEGORICAL})
    return Q.tv_and_cardinality(counts).select("column", F.round("tv", 9).alias("tv"))


@query("fid_cardinality", _scores([c.name for c in LINEITEM.columns], card_sql, EVEN, ODD, "cardinality"))
def fid_cardinality(t):
    ref, syn = _sides(t)
    counts = Q.value_counts(ref, syn, Q.column_kinds(LINEITEM, ref, syn))
    return Q.tv_and_cardinality(counts).select("column", F.round("cardinality", 9).alias("cardinality"))


@query(
    "fid_correlation",
    f"SELECT round(({corr_sql(NUMERIC, 'lineitem', SHIFTED)}), 9) AS correlation, {len(NUMERIC)} AS columns",
)
def fid_correlation(t):
    found = Q.correlation_similarity(t.lineitem, _shifted(t), NUMERIC)
    return found.select(F.round("correlation", 9).alias("correlation"), "columns")


@query("fid_report", report_sql(LINEITEM, EVEN, ODD))
def fid_report(t):
    rows = Q.table_fidelity(*_sides(t), LINEITEM)
    return rows.withColumn("score", F.round("score", 9))


@query("fid_report_shifted", report_sql(LINEITEM, "lineitem", SHIFTED))
def fid_report_shifted(t):
    rows = Q.table_fidelity(t.lineitem, _shifted(t), LINEITEM)
    return rows.withColumn("score", F.round("score", 9))


DOCUMENTS = S.Table(
    "documents",
    (S.Column("doc_id", "bigint"), S.Column("text", "text"), S.Column("lang", "varchar"),
     S.Column("source", "varchar"), S.Column("n_chars", "bigint")),
    ("doc_id",),
)


@query(
    "fid_verdict",
    f"SELECT count(*) AS metrics, round(avg(score), 9) AS overall_score, avg(score) >= 0.7 AS passed FROM "
    f"({report_sql(DOCUMENTS, '(SELECT * FROM documents WHERE n_chars % 2 = 0)', '(SELECT * FROM documents WHERE n_chars % 2 = 1)')})",
)
def fid_verdict(t):
    """Whole texts take part in the metrics of the text column."""
    db = S.Database((DOCUMENTS,))
    real, made = t.documents.where("n_chars % 2 = 0"), t.documents.where("n_chars % 2 = 1")
    rows = Q.validate_fidelity({"documents": made}, {"documents": real}, db)
    rows = rows.withColumn("score", F.round("score", 9))
    return Q.fidelity_verdict(rows).withColumn("overall_score", F.round("overall_score", 9))


# --- detection ------------------------------------------------------------------
_KEY = "md5(o_orderkey::VARCHAR)"
_SAMPLE = (
    f"(SELECT * FROM (SELECT 1 AS label, *, {_KEY} AS rk FROM orders WHERE o_custkey % 2 = 0 ORDER BY rk LIMIT 10000) "
    f"UNION ALL SELECT * FROM (SELECT 0 AS label, *, {_KEY} AS rk FROM orders WHERE o_custkey % 2 = 1 ORDER BY rk LIMIT 10000))"
)


@query(
    "det_subsample",
    f"SELECT o_orderkey, o_custkey FROM orders ORDER BY {_KEY} LIMIT 10000",
)
def det_subsample(t):
    return D.subsample(t.orders, row_key=["o_orderkey"]).select("o_orderkey", "o_custkey")


_group = "l_returnflag || chr(31) || l_linestatus"


@query(
    "det_subsample_copies",
    f"SELECT l_returnflag, l_linestatus FROM (SELECT l_returnflag, l_linestatus, md5(md5({_group}) || ':' || "
    f"(row_number() OVER (PARTITION BY l_returnflag, l_linestatus) - 1)::VARCHAR) AS rk FROM lineitem) ORDER BY rk LIMIT 10000",
)
def det_subsample_copies(t):
    """Rows without a key: six different rows in ten thousands of copies."""
    return D.subsample(t.lineitem.select("l_returnflag", "l_linestatus")).drop("_rank")


def _z(c: str) -> str:
    return f"round((s.{c} - (SELECT avg({c}) FROM orders)) / (SELECT stddev_pop({c}) FROM orders), 6) AS {c}"


_TEXTS = {
    "o_orderdate": "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')",
    "o_orderpriority": "o_orderpriority",
    "o_orderstatus": "o_orderstatus",
}


@query(
    "det_features",
    "SELECT s.label, s.rk, " + ", ".join(_z(c) for c in ("o_custkey", "o_orderkey", "o_totalprice")) + ", "
    + ", ".join(f"k_{c}.k AS {c}" for c in _TEXTS)
    + f" FROM (SELECT *, {', '.join(f'{text} AS {c}_text' for c, text in _TEXTS.items())} FROM {_SAMPLE}) s "
    + " ".join(
        f"JOIN (SELECT v, (row_number() OVER (ORDER BY v) - 1)::DOUBLE AS k FROM (SELECT DISTINCT {text} AS v FROM orders)) k_{c} ON k_{c}.v = s.{c}_text"
        for c, text in _TEXTS.items()
    ),
)
def det_features(t):
    real, made = t.orders.where("o_custkey % 2 = 0"), t.orders.where("o_custkey % 2 = 1")
    sampled, _ = D.features(real, made, ORDERS, row_key=["o_orderkey"])
    scaled = {c: F.round(c, 6) for c in ("o_custkey", "o_orderkey", "o_totalprice")}
    return sampled.withColumns(scaled).withColumnRenamed("_rank", "rk")


def _features_sql(table: S.Table, ref: str, syn: str, rank: str) -> tuple[str, list[str]]:
    """Sampled rows (label, rk, features): numbers standardized, other columns as codes of their text.

    ``rank`` makes ``rk`` from a row and ``copy``, its number among equal rows.
    """
    columns = sorted(c.name for c in table.columns)
    kinds = {c.name: c.data_type in S.NUMERIC for c in table.columns}
    text = {c.name: f"strftime({c.name}, '%Y-%m-%d %H:%M:%S')" if c.data_type == "timestamp" else f"{c.name}::VARCHAR" for c in table.columns}
    both = f"(SELECT 1 AS label, {', '.join(columns)} FROM {ref} UNION ALL SELECT 0, {', '.join(columns)} FROM {syn})"
    key = rank or f"md5(md5(concat_ws(chr(31), {', '.join(text[c] for c in columns)})) || ':' || copy::VARCHAR)"
    copied = f"(SELECT *, row_number() OVER (PARTITION BY ALL_COLUMNS) - 1 AS copy FROM {both})".replace("ALL_COLUMNS", "label, " + ", ".join(columns))
    sampled = f"(SELECT * FROM (SELECT *, {key} AS rk FROM {copied}) QUALIFY row_number() OVER (PARTITION BY label ORDER BY rk) <= {D.MAX_SAMPLE})"
    cells = [
        f"(s.{c} - (SELECT avg({c}) FROM {both})) / (SELECT stddev_pop({c}) FROM {both}) AS {c}" if kinds[c] else f"k_{c}.k AS {c}" for c in columns
    ]
    joins = " ".join(
        f"JOIN (SELECT v, (row_number() OVER (ORDER BY v) - 1)::DOUBLE AS k FROM (SELECT DISTINCT {text[c]} AS v FROM {both})) k_{c} ON k_{c}.v = s.{c}_text"
        for c in columns if not kinds[c]
    )
    texts = ", ".join(f"{text[c]} AS {c}_text" for c in columns if not kinds[c])
    return f"SELECT label, rk, {', '.join(cells)} FROM (SELECT *, {texts} FROM {sampled}) s {joins}", columns


def c2st_sql(table: S.Table, ref: str, syn: str, rank: str = "", steps: int = 12) -> str:
    """One value, the mean accuracy of five folds: Newton steps, each with its equations solved by elimination."""
    rows, columns = _features_sql(table, ref, syn, rank)
    n = len(columns) + 1
    parts = [
        f"f AS MATERIALIZED (SELECT label::DOUBLE AS y, row_number() OVER (PARTITION BY label ORDER BY rk) % 5 AS fold, [1.0::DOUBLE, {', '.join(columns)}] AS x FROM ({rows}))",
        f"w0 AS MATERIALIZED (SELECT unnest(range(5)) AS fit, list_transform(range({n}), lambda i: 0.0::DOUBLE) AS w)",
    ]
    for k in range(steps):
        cells = ", ".join(
            "[" + ", ".join([f"sum(v * x[{i}] * x[{j}]) + {float(i == j and i > 1)}::DOUBLE" for j in range(1, n + 1)] + [f"sum(e * x[{i}]) + {float(i > 1)}::DOUBLE * any_value(w[{i}])"]) + "]"
            for i in range(1, n + 1)
        )
        parts += [
            f"q{k} AS MATERIALIZED (SELECT fit, w, x, p * (1 - p) AS v, p - y AS e FROM (SELECT fit, w, x, y, 1 / (1 + exp(-list_dot_product(w, x))) AS p FROM f JOIN w{k} ON fold <> fit))",
            f"g{k}(fit, k, m) AS (SELECT fit, 0, [{cells}] FROM q{k} GROUP BY fit UNION ALL SELECT fit, k + 1, list_transform(range(1, {n + 1}), lambda i: CASE WHEN i = k + 1 "
            f"THEN list_transform(m[i], lambda c: c / m[i][i]) ELSE list_transform(range(1, {n + 2}), lambda j: m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) FROM g{k} WHERE k < {n})",
            f"w{k + 1} AS MATERIALIZED (SELECT w{k}.fit, list_transform(range(1, {n + 1}), lambda i: w[i] - m[i][{n + 1}]) AS w FROM w{k} JOIN g{k} ON w{k}.fit = g{k}.fit AND g{k}.k = {n})",
        ]
    right = f"SELECT avg(((list_dot_product(w, x) > 0) = (y > 0))::INT::DOUBLE) AS a FROM f JOIN w{steps} ON fold = fit GROUP BY fold"
    return f"(WITH RECURSIVE {', '.join(parts)} SELECT avg(a) FROM ({right}))"


_MADE = f"(SELECT * REPLACE (l_orderkey - 1 AS l_orderkey) FROM {ODD})"
_FAR = f"(SELECT * REPLACE (l_extendedprice * 3 AS l_extendedprice) FROM {_MADE})"


@query(
    "det_c2st",
    "SELECT 'c2st' AS metric, name AS \"table\", round(a, 9) AS accuracy, 'c2st_accuracy=' || printf('%.3f', a) AS details FROM "
    f"(SELECT 'same' AS name, {c2st_sql(LINEITEM, EVEN, _MADE)} AS a UNION ALL SELECT 'shifted', {c2st_sql(LINEITEM, EVEN, _FAR)})",
)
def det_c2st(t):
    """Same distribution: accuracy near one half.  Shifted prices: well above."""
    db = S.Database((S.Table("same", LINEITEM.columns), S.Table("shifted", LINEITEM.columns)))
    even, odd = _sides(t)
    odd = odd.withColumn("l_orderkey", F.col("l_orderkey") - 1)
    far = odd.withColumn("l_extendedprice", F.col("l_extendedprice") * 3)
    rows = D.validate_detection({"same": odd, "shifted": far}, {"same": even, "shifted": even}, db)
    return rows.withColumn("accuracy", F.round("accuracy", 9))


EVEN_ORDERS = "(SELECT * FROM orders WHERE o_custkey % 2 = 0)"
ODD_ORDERS = "(SELECT * REPLACE (o_custkey - 1 AS o_custkey) FROM orders WHERE o_custkey % 2 = 1)"
ORDERS_ACCURACY = c2st_sql(ORDERS, EVEN_ORDERS, ODD_ORDERS, _KEY)


def orders_detection(t):
    """Orders of even customers against those of odd ones."""
    db = S.Database((ORDERS,))
    real, made = t.orders.where("o_custkey % 2 = 0"), t.orders.where("o_custkey % 2 = 1")
    made = made.withColumn("o_custkey", F.col("o_custkey") - 1)
    return D.validate_detection({"orders": made}, {"orders": real}, db, row_keys={"orders": ["o_orderkey"]})


@query("det_verdict", f"SELECT 1::BIGINT AS metrics, round(a, 9) AS overall_score, a <= 0.6 AS passed FROM (SELECT {ORDERS_ACCURACY} AS a)")
def det_verdict(t):
    return D.detection_verdict(orders_detection(t)).withColumn("overall_score", F.round("overall_score", 9))
