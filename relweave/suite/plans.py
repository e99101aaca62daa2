"""Whole databases, reports and audit logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave import schema as S
from relweave.functions import words
from relweave.functions.generators import DAY, TIME_SPAN
from relweave.operators import fidelity as Q
from relweave.operators import integrity as I
from relweave.operators import keys as K
from relweave.plans import report as R
from relweave.plans.generate import generate_database
from relweave.sources import audit as A
from relweave.suite.base import (
    SEED, STAR, Tables, base36_sql, between_sql, draw_sql, hex_sql, pick_sql, query, star_tables, unit_sql,
)
from relweave.suite.fidelity import EVEN, EVEN_ORDERS, LINEITEM, ODD, ODD_ORDERS, ORDERS, ORDERS_ACCURACY, orders_detection
from relweave.suite.fidelity import report_sql as fidelity_sql
from relweave.suite.integrity import report_sql as integrity_sql
from relweave.suite.keys import index_sql

# --- audit ------------------------------------------------------------------------
_KINDS = 7  # of seven lines, three are malformed


def _lines(t):
    """Events as audit lines; some cut off, some with a foreign field, some without provider."""
    good = (
        "to_json(named_struct('timestamp', date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS'), 'provider', event_type, "
        "'model', concat('m', user_id % 3), 'privacy_tier', 'local', 'tokens_sent', user_id, 'tokens_received', user_id * 2, "
        "'cost_estimate', value, 'cached', user_id % 2 = 0))"
    )
    return t.events.selectExpr(
        f"CASE event_id % {_KINDS} WHEN 1 THEN substr({good}, 1, 40) WHEN 2 THEN concat('{{\"extra\":1,', substr({good}, 2)) "
        f"WHEN 3 THEN '{{\"timestamp\":\"2024-01-01\"}}' ELSE {good} END AS value"
    )


_good = (
    f"(SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp, event_type AS provider, 'm' || (user_id % 3) AS model, user_id AS tokens_sent, "
    f"user_id * 2 AS tokens_received, value AS cost_estimate, user_id % 2 = 0 AS cached FROM events WHERE event_id % {_KINDS} NOT IN (1, 2, 3))"
)


@query("src_audit_events", f"SELECT timestamp, provider, model, tokens_sent, tokens_received, cost_estimate, cached FROM {_good}")
def audit_events(t):
    events = A.parse_audit_lines(_lines(t))
    return events.select("timestamp", "provider", "model", "tokens_sent", "tokens_received", "cost_estimate", "cached")


@query("src_audit_last_n", f"SELECT timestamp, provider, tokens_sent FROM {_good} ORDER BY timestamp DESC, provider DESC LIMIT 50")
def audit_last(t):
    return A.last_events(A.parse_audit_lines(_lines(t)), 50).select("timestamp", "provider", "tokens_sent")


@query(
    "src_audit_summary",
    f"SELECT provider, model, 'local' AS privacy_tier, count(*) AS calls, count(*) FILTER (cached) AS cache_hits, sum(tokens_sent)::BIGINT AS tokens_sent, "
    f"sum(tokens_received)::BIGINT AS tokens_received, round(sum(cost_estimate::DECIMAL(20,6))::DOUBLE, 4) AS cost FROM {_good} GROUP BY 1, 2",
)
def audit_summary(t):
    out = A.audit_summary(A.parse_audit_lines(_lines(t)))
    return out.withColumn("cost", F.round(F.col("cost").cast("double"), 4))


# --- report -----------------------------------------------------------------------
@query(
    "rpt_quality",
    f"WITH i AS ({integrity_sql()}), f AS ({fidelity_sql(LINEITEM, EVEN, ODD)}) "
    "SELECT '1.0.0' AS version, 'abc' AS schema_hash, (SELECT count(*) FROM lineitem) AS lineitem_rows, (SELECT count(*) FROM i) AS checks, "
    "(SELECT bool_and(passed) FROM i) AS integrity_passed, (SELECT count(*) FROM f) AS metrics, round((SELECT avg(score) FROM f), 6) AS fidelity_score, "
    "(SELECT avg(score) >= 0.7 FROM f) AS fidelity_passed, false AS passed, 42 AS seed",
)
def quality(t):
    tables = star_tables(t)
    even, odd = t.lineitem.where("l_orderkey % 2 = 0"), t.lineitem.where("l_orderkey % 2 = 1")
    report = R.quality_report(
        I.validate_integrity(tables, STAR), R.row_counts(tables), schema_hash="abc", engine="rules", seed=SEED,
        fidelity=Q.table_fidelity(even, odd, LINEITEM), timestamp="2025-01-01T00:00:00",
    )
    return report.select(
        "version", "metadata.schema_hash", F.col("metadata.row_counts")["lineitem"].alias("lineitem_rows"),
        F.size("integrity.checks").cast("bigint").alias("checks"), F.col("integrity.passed").alias("integrity_passed"),
        F.size("fidelity.metrics").cast("bigint").alias("metrics"),
        F.round("fidelity.overall_score", 6).alias("fidelity_score"),
        F.col("fidelity.passed").alias("fidelity_passed"), "passed", "metadata.seed",
    )


@query(
    "rpt_quality_detection",
    f"WITH i AS ({integrity_sql()}), f AS ({fidelity_sql(ORDERS, EVEN_ORDERS, ODD_ORDERS)}), d AS (SELECT {ORDERS_ACCURACY} AS a) "
    "SELECT '1.0.0' AS version, (SELECT count(*) FROM i) AS checks, (SELECT bool_and(passed) FROM i) AS integrity_passed, "
    "(SELECT count(*) FROM f) AS metrics, round((SELECT avg(score) FROM f), 6) AS fidelity_score, (SELECT avg(score) >= 0.7 FROM f) AS fidelity_passed, "
    "1::BIGINT AS detections, round(a, 6) AS detection_score, a <= 0.6 AS detection_passed, "
    "(SELECT bool_and(passed) FROM i) AND (SELECT avg(score) >= 0.7 FROM f) AND a <= 0.6 AS passed FROM d",
)
def quality_with_detection(t):
    """The whole report with its detection block."""
    tables = star_tables(t)
    even, odd = t.orders.where("o_custkey % 2 = 0"), t.orders.where("o_custkey % 2 = 1").withColumn("o_custkey", F.col("o_custkey") - 1)
    report = R.quality_report(
        I.validate_integrity(tables, STAR), R.row_counts(tables), schema_hash="abc", engine="rules", seed=SEED,
        fidelity=Q.table_fidelity(even, odd, ORDERS), detection=orders_detection(t), timestamp="2025-01-01T00:00:00",
    )
    return report.select(
        "version", F.size("integrity.checks").cast("bigint").alias("checks"), F.col("integrity.passed").alias("integrity_passed"),
        F.size("fidelity.metrics").cast("bigint").alias("metrics"), F.round("fidelity.overall_score", 6).alias("fidelity_score"),
        F.col("fidelity.passed").alias("fidelity_passed"), F.size("detection.metrics").cast("bigint").alias("detections"),
        F.round("detection.overall_score", 6).alias("detection_score"), F.col("detection.passed").alias("detection_passed"), "passed",
    )


_bands = (
    "CASE WHEN v >= 0.8 THEN 'green' WHEN v >= 0.5 THEN 'yellow' ELSE 'red' END AS fidelity_band, "
    "CASE WHEN v <= 0.55 THEN 'green' WHEN v <= 0.7 THEN 'yellow' ELSE 'red' END AS detection_band"
)


@query("rpt_bands", f"SELECT o_orderkey, {_bands} FROM (SELECT o_orderkey, (o_orderkey % 101) / 100.0::DOUBLE AS v FROM orders)")
def bands(t):
    score = F.expr("(o_orderkey % 101) / 100D")
    return t.orders.select(
        "o_orderkey", R.fidelity_band(score).alias("fidelity_band"), R.detection_band(score).alias("detection_band")
    )


# --- whole databases ----------------------------------------------------------------
def shop() -> S.Database:
    """Self reference, composite key, junction, CHECKs, UNIQUE texts, places and a cycle."""
    key = {"nullable": False, "primary_key": True}
    auto = S.Column("id", "bigint", autoincrement=True, **key)

    def ref(column: str, table: str) -> S.ForeignKey:
        return S.ForeignKey((column,), table, ("id",))

    return S.Database(
        (
            S.Table("users", (
                auto, S.Column("email", "varchar", nullable=False, unique=True, max_length=60),
                S.Column("full_name", "varchar"), S.Column("city", "varchar"), S.Column("state", "varchar"),
                S.Column("zip_code", "varchar"), S.Column("age", "integer", nullable=False, check="age >= 21 AND age <= 65"),
                S.Column("favourite_id", "bigint"), S.Column("is_active", "boolean", nullable=False),
            ), ("id",), (ref("favourite_id", "products"),)),
            S.Table("categories", (auto, S.Column("label", "varchar", nullable=False), S.Column("parent_id", "bigint")),
                    ("id",), (ref("parent_id", "categories"),)),
            S.Table("products", (
                auto, S.Column("category_id", "bigint", nullable=False), S.Column("seller_id", "bigint"),
                S.Column("sku", "varchar", nullable=False, unique=True, max_length=20),
                S.Column("price", "decimal", precision=10, scale=2, check="price BETWEEN 5 AND 900"),
                S.Column("status", "varchar", check="status IN ('draft', 'active')"), S.Column("created_at", "timestamp"),
            ), ("id",), (ref("category_id", "categories"), ref("seller_id", "users"))),
            S.Table("tags", (S.Column("label", "varchar", max_length=16, **key), S.Column("color", "varchar")), ("label",)),
            S.Table("product_tags", (S.Column("product_id", "bigint", **key), S.Column("tag", "varchar", **key)),
                    ("product_id", "tag"),
                    (ref("product_id", "products"), S.ForeignKey(("tag",), "tags", ("label",)))),
            S.Table("order_lines", (
                S.Column("user_id", "bigint", **key), S.Column("line_no", "integer", **key),
                S.Column("product_id", "bigint", nullable=False), S.Column("quantity", "integer", nullable=False),
                S.Column("uuid", "uuid", nullable=False, unique=True), S.Column("shipped", "date"),
            ), ("user_id", "line_no"), (ref("user_id", "users"), ref("product_id", "products"))),
        ),
        name="shop",
    )


def shop_tables(t: Tables):
    """A shop around rows that exist: customers are its users, parts its products, suppliers its tags.

    Users and products keep the columns given here; the others are generated for them.
    """
    existing = {
        "users": t.customer.selectExpr("c_custkey AS id", "c_name AS full_name"),
        "products": t.part.selectExpr("p_partkey AS id", "cast(p_retailprice AS decimal(10,2)) AS price"),
        "tags": t.supplier.selectExpr("s_name AS label", "string(s_nationkey) AS color"),
    }
    rows = {"categories": t.nation.count(), "product_tags": t.orders.count(), "order_lines": t.lineitem.count()}
    return generate_database(t.spark, shop(), rows, seed=SEED, existing=existing)


def _all_pass_sql() -> str:
    parts = []
    for table in shop().tables:
        if table.primary_key:
            parts.append(("pk_uniqueness", table.name, ", ".join(table.primary_key)))
        parts += [("unique", table.name, ", ".join(c)) for c in table.unique_sets]
        parts += [("not_null", table.name, c.name) for c in table.columns if not c.nullable]
        parts += [("fk_satisfaction", table.name, ", ".join(fk.columns)) for fk in table.foreign_keys]
    values = ", ".join(f"('{a}', '{b}', '{c}', true, '')" for a, b, c in parts)
    return (
        f"SELECT * FROM (VALUES {values}) v(\"check\", \"table\", \"column\", passed, details) "
        "WHERE (SELECT count(*) FROM lineitem) > 0"
    )


@query("pipe_shop_integrity", _all_pass_sql())
def shop_integrity(t):
    """Every check of a generated database passes."""
    return I.validate_integrity(shop_tables(t).tables, shop())


@query(
    "pipe_shop_rows",
    " UNION ALL ".join(
        f"SELECT '{a}' AS \"table\", count(*) AS rows FROM {b}"
        for a, b in (("users", "customer"), ("categories", "nation"), ("products", "part"), ("tags", "supplier"),
                     ("product_tags", "orders"), ("order_lines", "lineitem"))
    ),
)
def shop_rows(t):
    return R.row_counts(shop_tables(t).tables)


# Existing rows are numbered by (md5 prefix of the key, key); new ones 0, 1, 2, ...
_users = index_sql("customer", "c_custkey", "c_custkey, c_name")
_place = f"{draw_sql('users', 'geo', 'r')} % {len(words.PLACES)}"
_places = ", ".join(f"({i}, '{c}', '{s}', '{z}')" for i, (c, s, z) in enumerate(words.PLACES))
_mail = (
    f"lower({pick_sql(words.FIRST_NAMES, 'users', 'email', 'r')}) || '_' || lower({pick_sql(words.LAST_NAMES, 'users', 'email', 'r', 1)}) "
    f"|| {between_sql('users', 'email', 'r', 0, 9999, 2)} || '@' || {pick_sql(words.MAIL_DOMAINS, 'users', 'email', 'r', 3)}"
)
_age = between_sql("users", "age", "r", 18, 90)
_products = index_sql("part", "p_partkey", "p_partkey")


@query(
    "pipe_shop_users",
    f"SELECT c_custkey AS id, substr({_mail}, 1, 60 - length('_' || {base36_sql('r')})) || '_' || {base36_sql('r')} AS email, c_name AS full_name, "
    f"p.city, p.state, p.zip AS zip_code, (CASE WHEN {_age} BETWEEN 21 AND 65 THEN {_age} ELSE {between_sql('users', 'age:check', 'r', 21, 65)} END)::INT AS age, "
    f"f.p_partkey AS favourite_id, {unit_sql('users', 'is_active', 'r')} < 0.5::DOUBLE AS is_active "
    f"FROM (SELECT *, pos AS r FROM ({_users})) u JOIN (VALUES {_places}) p(ix, city, state, zip) ON p.ix = {_place} "
    f"JOIN ({_products}) f ON f.pos = {draw_sql('users', 'fk:favourite_id', 'r')} % (SELECT count(*) FROM part)",
)
def shop_users(t):
    return shop_tables(t).tables["users"]


_uuid = hex_sql("order_lines", "uuid", "r")
_uuid_text = (
    f"substr({_uuid}, 1, 8) || '-' || substr({_uuid}, 9, 4) || '-4' || substr({_uuid}, 14, 3) || '-' || "
    f"translate(substr({_uuid}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({_uuid}, 18, 3) || '-' || substr({_uuid}, 21, 12)"
)


@query(
    "pipe_shop_lines",
    f"SELECT u.c_custkey AS user_id, ((r::HUGEINT * {K.pair_multiplier(2**31)} + {2**31 // 3}) % {2**31})::INT AS line_no, "
    f"p.p_partkey AS product_id, {between_sql('order_lines', 'quantity', 'r', 1, 100)}::INT AS quantity, {_uuid_text} AS uuid, "
    f"(DATE '2020-01-01' + (({draw_sql('order_lines', 'shipped', 'r')} % {TIME_SPAN}) // {DAY})::INT)::VARCHAR AS shipped "
    f"FROM (SELECT row_number() OVER () - 1 AS r FROM lineitem) JOIN ({_users}) u ON u.pos = {draw_sql('order_lines', 'fk:user_id', 'r')} % (SELECT count(*) FROM customer) "
    f"JOIN ({_products}) p ON p.pos = {draw_sql('order_lines', 'fk:product_id', 'r')} % (SELECT count(*) FROM part)",
)
def shop_lines(t):
    return shop_tables(t).tables["order_lines"].withColumn("shipped", F.col("shipped").cast("string"))


def star_synthetic(t: Tables):
    """New orders and lines for the customers, parts and suppliers that exist."""
    kept = {n: getattr(t, n) for n in ("region", "nation", "customer", "supplier", "part")}
    rows = {"orders": t.orders.count(), "lineitem": t.lineitem.count()}
    return generate_database(t.spark, STAR, rows, seed=SEED, existing=kept).tables


def _star_pass_sql() -> str:
    parts = []
    for table in STAR.tables:
        parts.append(("pk_uniqueness", table.name, ", ".join(table.primary_key)))
        parts += [("unique", table.name, ", ".join(c)) for c in table.unique_sets]
        parts += [("not_null", table.name, c.name) for c in table.columns if not c.nullable]
        parts += [("fk_satisfaction", table.name, ", ".join(fk.columns)) for fk in table.foreign_keys]
    values = ", ".join(f"('{a}', '{b}', '{c}', true, '')" for a, b, c in parts)
    return f"SELECT * FROM (VALUES {values}) v(\"check\", \"table\", \"column\", passed, details) WHERE (SELECT count(*) FROM orders) > 0"


@query("pipe_star_integrity", _star_pass_sql())
def star_integrity(t):
    """The parents that exist and the new rows pass every check."""
    return I.validate_integrity(star_synthetic(t), STAR)

