"""Constraint repair over lines and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave import schema as S
from relweave.functions.draws import Cell
from relweave.operators import constraints as C
from relweave.operators.allocation import allocate_unique, integers
from relweave.suite.base import SEED, base36_sql, between_sql, draw_sql, letters_sql, pick_sql, query

LINES = S.Table(
    "lines",
    (
        S.Column("row", "bigint", nullable=False),
        S.Column("qty", "integer", nullable=False),
        S.Column("price", "float", nullable=False),
        S.Column("flag", "varchar", nullable=False, max_length=8),
        S.Column("fee", "decimal", nullable=False, precision=8, scale=0),
        S.Column("open", "boolean", nullable=False),
        S.Column("state", "enum", nullable=False, enum_values=("on", "off", "hold")),
    ),
)
_LINES_SQL = (
    "(SELECT event_id AS row, CASE WHEN user_id % 3 <> 0 THEN user_id::INT END AS qty, CASE WHEN value > 5 THEN value END AS price, "
    "nullif(event_type, 'click') AS flag, NULL::VARCHAR AS fee, CASE WHEN user_id % 2 = 0 THEN true END AS open, NULL::VARCHAR AS state FROM events)"
)


def _lines(t):
    return t.events.selectExpr(
        "event_id AS row", "if(user_id % 3 <> 0, int(user_id), NULL) AS qty",
        "if(value > 5, value, NULL) AS price", "nullif(event_type, 'click') AS flag",
        "cast(NULL AS decimal(8,0)) AS fee", "if(user_id % 2 = 0, true, NULL) AS open",
        "string(NULL) AS state",
    )


def _d(column: str, part: int = 0) -> str:
    return draw_sql("lines", column, "row", part)


@query(
    "con_not_null",
    f"SELECT row, coalesce(qty, ({_d('qty:notnull')} % 2147483648)::INT) AS qty, "
    f"coalesce(price, {between_sql('lines', 'price:notnull', 'row', 0, 1000000)} / 100.0::DOUBLE) AS price, "
    f"coalesce(flag, {letters_sql(_d('flag:notnull'), 8)}) AS flag, ({_d('fee:notnull')} % 100000000)::VARCHAR AS fee, "
    f"coalesce(open, {_d('open:notnull')} % 2 = 1) AS open, {pick_sql(('on', 'off', 'hold'), 'lines', 'state:notnull', 'row')} AS state FROM {_LINES_SQL}",
)
def con_not_null(t):
    fixed = C.repair_not_null(_lines(t), LINES, seed=SEED, row_id="row")
    return fixed.withColumn("fee", F.col("fee").cast("string"))


ITEMS = S.Table(
    "items",
    (
        S.Column("row", "bigint"),
        S.Column("l_quantity", "float", check="l_quantity >= 5 AND l_quantity <= 20"),
        S.Column("l_linenumber", "integer", check="l_linenumber BETWEEN 2 AND 4"),
        S.Column("l_returnflag", "varchar", check="l_returnflag IN ('A', 'N')"),
        S.Column("l_extendedprice", "float", check="l_extendedprice > 50000"),
        S.Column("l_partkey", "bigint", check="l_partkey < 100"),
    ),
)
_ROW = "l_orderkey * 100 + l_linenumber"


def _items(t):
    return t.lineitem.selectExpr(
        f"{_ROW} AS row", "l_quantity", "l_linenumber", "l_returnflag", "l_extendedprice", "l_partkey"
    )


_ITEMS_SQL = f"(SELECT {_ROW} AS row, l_quantity, l_linenumber, l_returnflag, l_extendedprice, l_partkey FROM lineitem)"


@query(
    "con_check_range",
    f"SELECT row, CASE WHEN l_quantity < 5 OR l_quantity > 20 THEN {between_sql('items', 'l_quantity:check', 'row', 500, 2000)} / 100.0::DOUBLE ELSE l_quantity END AS l_quantity, "
    f"(CASE WHEN l_linenumber < 2 OR l_linenumber > 4 THEN {between_sql('items', 'l_linenumber:check', 'row', 2, 4)} ELSE l_linenumber END)::INT AS l_linenumber FROM {_ITEMS_SQL}",
)
def con_check_range(t):
    domains = {"l_quantity": C.Domain(5.0, 20.0), "l_linenumber": C.Domain(2.0, 4.0)}
    df = _items(t).select("row", "l_quantity", "l_linenumber")
    return C.repair_check(df, domains, ITEMS, seed=SEED, row_id="row")


@query(
    "con_check_in",
    f"SELECT row, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN {pick_sql(('A', 'N'), 'items', 'l_returnflag:check', 'row')} ELSE l_returnflag END AS l_returnflag FROM {_ITEMS_SQL}",
)
def con_check_in(t):
    df = _items(t).select("row", "l_returnflag")
    return C.repair_check(df, {"l_returnflag": C.Domain(allowed=("A", "N"))}, ITEMS, seed=SEED, row_id="row")


@query(
    "con_check_one_sided",
    f"SELECT row, CASE WHEN l_extendedprice <= 50000 THEN {between_sql('items', 'l_extendedprice:check', 'row', 5000001, 5100001)} / 100.0::DOUBLE ELSE l_extendedprice END AS l_extendedprice, "
    f"CASE WHEN l_partkey >= 100 THEN {between_sql('items', 'l_partkey:check', 'row', -901, 99)} ELSE l_partkey END AS l_partkey FROM {_ITEMS_SQL}",
)
def con_check_one_sided(t):
    domains = {
        "l_extendedprice": C.Domain(minimum=50000.0, minimum_open=True),
        "l_partkey": C.Domain(maximum=100.0, maximum_open=True),
    }
    df = _items(t).select("row", "l_extendedprice", "l_partkey")
    return C.repair_check(df, domains, ITEMS, seed=SEED, row_id="row")


_tests = {
    "l_quantity": "l_quantity < 5 OR l_quantity > 20",
    "l_linenumber": "l_linenumber < 2 OR l_linenumber > 4",
    "l_returnflag": "l_returnflag NOT IN ('A', 'N')",
    "l_extendedprice": "l_extendedprice <= 50000",
    "l_partkey": "l_partkey >= 100",
}


@query(
    "con_check_violations",
    " UNION ALL ".join(
        f"SELECT 'check' AS \"check\", 'items' AS \"table\", '{c}' AS \"column\", n = 0 AS passed, "
        f"CASE WHEN n = 0 THEN '' ELSE n::VARCHAR || ' CHECK violations' END AS details "
        f"FROM (SELECT count(*) FILTER ({test}) AS n FROM lineitem)"
        for c, test in _tests.items()
    ),
)
def con_check_violations(t):
    return C.check_violations(_items(t), C.table_domains(t.spark, ITEMS), "items")


_KEEP = "FIRST_ID = min(event_id) OVER (PARTITION BY event_type, user_id)".replace("FIRST_ID", "event_id")


@query("con_unique_keepers", f"SELECT event_id, event_type, user_id, NOT ({_KEEP}) AS repeated FROM events")
def con_unique_keepers(t):
    df = t.events.select("event_id", "event_type", "user_id")
    return C.mark_repeats(df, ["event_type", "user_id"], "event_id").withColumnRenamed("_repeat", "repeated")


@query(
    "con_unique_rounds",
    "SELECT count(*) AS rows, count(*) AS distinct_values, "
    "(SELECT count(*) FROM (SELECT DISTINCT l_partkey FROM lineitem)) AS kept_first FROM lineitem",
)
def con_unique_rounds(t):
    """Repair a column where nearly every value repeats: first rows stay, the others get free values of a domain of 2^31."""
    df = t.lineitem.selectExpr(
        "xxhash64(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS row",
        "l_partkey AS code",
    )

    fixed = allocate_unique(df, ["code"], "code", integers(0, 2**31 - 1), row_id="row")
    before = df.select("row", F.col("code").alias("was"))
    same = F.count_if(F.col("code") == F.col("was"))
    return fixed.join(before, "row").agg(
        F.count("*").alias("rows"), F.countDistinct("code").alias("distinct_values"), same.alias("kept_first")
    )


@query(
    "con_unique_composite",
    "SELECT count(*) AS rows, count(*) AS distinct_values, 0::BIGINT AS changed_keys FROM lineitem",
)
def con_unique_composite(t):
    """Composite key of a foreign key and a free column: only the free column may change."""
    df = t.lineitem.selectExpr(
        "xxhash64(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS row",
        "l_orderkey", "l_linenumber",
    )
    table = S.Table(
        "lineitem",
        (S.Column("row", "bigint"), S.Column("l_orderkey", "bigint"), S.Column("l_linenumber", "integer")),
        ("l_orderkey", "l_linenumber"),
        (S.ForeignKey(("l_orderkey",), "orders", ("o_orderkey",)),),
    )
    fixed = C.repair_unique_sets(df, table, seed=SEED, row_id="row")
    before = df.select("row", F.col("l_orderkey").alias("was"))
    return fixed.join(before, "row").agg(
        F.count("*").alias("rows"),
        F.countDistinct("l_orderkey", "l_linenumber").alias("distinct_values"),
        F.count_if(F.col("l_orderkey") != F.col("was")).alias("changed_keys"),
    )


_LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"


@query(
    "con_unique_tight",
    "WITH n AS (SELECT row_number() OVER (ORDER BY o_custkey, o_orderkey) AS r, o_orderkey, o_custkey FROM orders), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 AS kept FROM n) "
    "SELECT code, CASE WHEN kept THEN o_custkey::VARCHAR END AS kept_key FROM "
    "(SELECT unnest(range((SELECT count(*) FROM orders))) AS code) LEFT JOIN (SELECT * FROM k WHERE kept) ON o_custkey = code",
)
def con_unique_tight(t):
    """A domain with exactly as many values as rows: afterwards every value stands once, the first rows' own ones with them."""
    df = t.orders.selectExpr("o_orderkey AS row", "o_custkey AS code", "o_custkey AS was")
    fixed = allocate_unique(df, ["code"], "code", integers(0, t.orders.count() - 1), row_id="row")
    first = df.groupBy("was").agg(F.min("row").alias("row"))
    kept = first.select("row", F.col("was").alias("kept"))
    return fixed.join(kept, "row", "left").select("code", F.when(F.col("kept") == F.col("code"), F.col("kept").cast("string")).alias("kept_key"))


@query(
    "con_unique_free_values",
    "WITH u AS (SELECT o_orderkey AS row, o_custkey AS code, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1 AS extra FROM orders), "
    "f AS (SELECT code, row_number() OVER (ORDER BY code) AS n FROM (SELECT unnest(range(2 * (SELECT count(*) FROM orders))) AS code) "
    "WHERE code NOT IN (SELECT o_custkey FROM orders)) "
    "SELECT code FROM u WHERE NOT extra UNION ALL SELECT code FROM f WHERE n <= (SELECT count(*) FROM u WHERE extra)",
)
def con_unique_free_values(t):
    """Rows in excess take the smallest free values of the domain."""
    df = t.orders.selectExpr("o_orderkey AS row", "o_custkey AS code")
    return allocate_unique(df, ["code"], "code", integers(0, 2 * t.orders.count() - 1), row_id="row").select("code")


@query(
    "con_unique_tight_groups",
    "WITH g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS own FROM lineitem GROUP BY 1) "
    "SELECT l_orderkey, n AS rows, n AS distinct_numbers, own AS kept FROM g",
)
def con_unique_tight_groups(t):
    """Line numbers made unique inside their order, in a domain no larger than the largest order."""
    df = t.lineitem.selectExpr(f"xxhash64({_LINE}) AS row", "l_orderkey", "l_linenumber")
    most = t.lineitem.groupBy("l_orderkey").count().agg(F.greatest(F.max("count"), F.lit(7))).first()[0] or 7
    fixed = allocate_unique(df, ["l_orderkey", "l_linenumber"], "l_linenumber", integers(1, most, "int"), row_id="row")
    was = df.select("row", F.col("l_linenumber").alias("was"))
    first = df.groupBy("l_orderkey", "l_linenumber").agg(F.min("row").alias("row")).select("row", F.lit(1).alias("first"))
    return fixed.join(was, "row").join(first, "row", "left").groupBy("l_orderkey").agg(
        F.count("*").alias("rows"), F.countDistinct("l_linenumber").alias("distinct_numbers"),
        F.count_if((F.col("was") == F.col("l_linenumber")) & F.col("first").isNotNull()).alias("kept"),
    )


_suffix = f"('_' || {base36_sql('o_orderkey')})"


@query(
    "con_unique_by_construction",
    f"SELECT o_orderkey, substr(o_orderpriority, 1, 10 - length({_suffix})) || {_suffix} AS label, "
    f"((o_orderkey::HUGEINT * 1000003 + 333333) % 1000000)::BIGINT + 5 AS code FROM orders",
)
def con_unique_by_construction(t):
    row = F.col("o_orderkey")
    return t.orders.select(
        "o_orderkey", C.unique_text(F.col("o_orderpriority"), row, 10).alias("label"),
        C.unique_int(row, 1_000_000, 5).alias("code"),
    )


@query(
    "con_enforce",
    f"SELECT count(*) AS rows, count(*) AS distinct_flags, 0::BIGINT AS nulls, 0::BIGINT AS outside FROM events",
)
def con_enforce(t):
    """All repairs together on events: complete, inside its CHECKs, and unique."""
    table = S.Table(
        "events",
        (
            S.Column("row", "bigint", nullable=False),
            S.Column("qty", "integer", nullable=False, check="qty BETWEEN 1 AND 40"),
            S.Column("price", "float", nullable=False, check="price >= 10"),
            S.Column("flag", "varchar", nullable=False, unique=True, max_length=12),
        ),
    )
    df = _lines(t).select("row", "qty", "price", "flag")
    fixed = C.enforce_constraints(df, table, seed=SEED, row_id="row")
    outside = (F.col("qty") < 1) | (F.col("qty") > 40) | (F.col("price") < 10)
    nulls = F.col("qty").isNull() | F.col("price").isNull() | F.col("flag").isNull()
    return fixed.agg(
        F.count("*").alias("rows"), F.countDistinct("flag").alias("distinct_flags"),
        F.count_if(nulls).alias("nulls"), F.count_if(outside).alias("outside"),
    )
