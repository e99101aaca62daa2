"""Dense positions, foreign keys, self references, junction pairs, upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.operators import keys as K
from relweave.operators.positions import dense_index
from relweave.operators.upsert import upsert_apply
from relweave.suite.base import SEED, draw_sql, query, unit_sql


def index_sql(source: str, key: str, columns: str) -> str:
    """Position by (md5 prefix of the key, key)."""
    return (
        f"SELECT {columns}, row_number() OVER (ORDER BY substr(md5({key}::VARCHAR), 1, 4), {key}) - 1 AS pos FROM {source}"
    )


@query("key_dense_index", index_sql("customer", "c_custkey", "c_custkey, c_name"))
def key_dense_index(t):
    return dense_index(t.customer.select("c_custkey", "c_name"), ["c_custkey"])


_copies = (
    "SELECT l_returnflag, l_linenumber, "
    "row_number() OVER (ORDER BY substr(md5(l_returnflag || chr(31) || l_linenumber::VARCHAR), 1, 4), l_returnflag, l_linenumber) - 1 AS pos "
    "FROM lineitem"
)


@query("key_dense_index_copies", _copies)
def key_dense_index_copies(t):
    df = t.lineitem.select("l_returnflag", "l_linenumber")
    return dense_index(df, df.columns, unique=False)


def _ix(child: str, row: str, tag: str, parent: str) -> str:
    return f"{draw_sql(child, tag, row)} % (SELECT count(*) FROM {parent})"


_cust = index_sql("customer", "c_custkey", "c_custkey")


@query(
    "key_fk_single",
    f"SELECT o.o_orderkey, p.c_custkey AS buyer FROM orders o JOIN ({_cust}) p ON p.pos = {_ix('orders', 'o.o_orderkey', 'fk:buyer', 'customer')}",
)
def key_fk_single(t):
    child = t.orders.select("o_orderkey", F.lit(None).cast("bigint").alias("buyer"))
    return K.fill_fk(
        child, t.customer, ["buyer"], ["c_custkey"], seed=SEED, table="orders", row_id="o_orderkey"
    )


@query(
    "key_fk_dense",
    f"SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, {draw_sql('lineitem', 'fk:part_ref', 'l.l_orderkey * 10 + l.l_linenumber')} "
    "% (SELECT count(*) FROM part) AS part_ref FROM lineitem l",
)
def key_fk_dense(t):
    child = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.lit(None).cast("bigint").alias("part_ref"),
        F.expr("l_orderkey * 10 + l_linenumber").alias("_row"),
    )
    return K.fill_fk(
        child, t.part, ["part_ref"], ["p_partkey"], seed=SEED, table="lineitem", row_id="_row",
        dense=(0, t.part.count()),
    ).drop("_row")


_comp = (
    "SELECT conv_id, turn, row_number() OVER (ORDER BY substr(md5(conv_id::VARCHAR || chr(31) || turn::VARCHAR), 1, 4), conv_id, turn) - 1 AS pos "
    "FROM conversations"
)


@query(
    "key_fk_composite",
    f"SELECT e.event_id, p.conv_id AS c, p.turn AS n FROM events e JOIN ({_comp}) p ON p.pos = {_ix('events', 'e.event_id', 'fk:c,n', 'conversations')}",
)
def key_fk_composite(t):
    none = F.lit(None).cast("bigint")
    child = t.events.select("event_id", none.alias("c"), none.alias("n"))
    return K.fill_fk(
        child, t.conversations, ["c", "n"], ["conv_id", "turn"], seed=SEED, table="events", row_id="event_id"
    )


_supp = index_sql("supplier", "s_suppkey", "s_suppkey")


@query(
    "key_fk_multi",
    f"SELECT o.o_orderkey, p.c_custkey AS buyer, s.s_suppkey AS seller FROM orders o "
    f"JOIN ({_cust}) p ON p.pos = {_ix('orders', 'o.o_orderkey', 'fk:buyer', 'customer')} "
    f"JOIN ({_supp}) s ON s.pos = {_ix('orders', 'o.o_orderkey', 'fk:seller', 'supplier')}",
)
def key_fk_multi(t):
    none = F.lit(None).cast("bigint")
    return K.fill_foreign_keys(
        t.orders.select("o_orderkey", none.alias("buyer"), none.alias("seller")),
        [(["buyer"], t.customer, ["c_custkey"]), (["seller"], t.supplier, ["s_suppkey"])],
        seed=SEED, table="orders", row_id="o_orderkey",
    )


@query(
    "key_fk_empty_parent",
    "SELECT o_orderkey, NULL::VARCHAR AS buyer FROM orders",
)
def key_fk_empty_parent(t):
    child = t.orders.select("o_orderkey", F.lit(None).cast("bigint").alias("buyer"))
    return K.fill_fk(
        child, t.customer.where("c_custkey < 0"), ["buyer"], ["c_custkey"], seed=SEED,
        table="orders", row_id="o_orderkey",
    ).withColumn("buyer", F.col("buyer").cast("string"))


_roots = "greatest((SELECT count(*) FROM orders) // 5, 1)"


@query(
    "key_self_ref",
    f"SELECT o_orderkey, CASE WHEN o_orderkey >= {_roots} THEN ({draw_sql('orders', 'fk:previous', 'o_orderkey')} % o_orderkey)::VARCHAR END AS previous FROM orders",
)
def key_self_ref(t):
    child = t.orders.select("o_orderkey", F.lit(None).cast("bigint").alias("previous"))
    size = t.orders.agg(F.count("*")).scalar()
    return K.self_reference(
        child, ["previous"], ["o_orderkey"], seed=SEED, table="orders", position="o_orderkey",
        size=size, dense_first=0,
    ).withColumn("previous", F.col("previous").cast("string"))


@query(
    "key_self_ref_join",
    f"WITH c AS ({index_sql('customer', 'c_custkey', 'c_custkey, c_name')}) "
    f"SELECT c.c_custkey, c.c_name, p.c_name AS referrer FROM c LEFT JOIN c p ON p.pos = "
    f"CASE WHEN c.pos >= greatest((SELECT count(*) FROM customer) // 5, 1) THEN {draw_sql('customer', 'fk:referrer', 'c.pos')} % c.pos END",
)
def key_self_ref_join(t):
    numbered = dense_index(t.customer.select("c_custkey", "c_name"), ["c_custkey"])
    df = numbered.withColumn("referrer", F.lit(None).cast("string"))
    return K.self_reference(
        df, ["referrer"], ["c_name"], seed=SEED, table="customer", position="pos",
        size=t.customer.agg(F.count("*")).scalar(),
    ).drop("pos")


@query(
    "key_deferred",
    f"SELECT n.c_custkey, (CASE WHEN n.first_order IS NOT NULL THEN n.first_order WHEN {unit_sql('customer', 'fk:first_order:null', 'n.c_custkey')} >= 0.3::DOUBLE "
    f"THEN p.o_orderkey END)::VARCHAR AS first_order FROM (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey END AS first_order FROM customer) n "
    f"JOIN ({index_sql('orders', 'o_orderkey', 'o_orderkey')}) p ON p.pos = {_ix('customer', 'n.c_custkey', 'fk:first_order', 'orders')}",
)
def key_deferred(t):
    child = t.customer.select(
        "c_custkey", F.expr("if(c_mktsegment = 'BUILDING', c_custkey, NULL)").alias("first_order")
    )
    return K.fill_deferred(
        child, t.orders, ["first_order"], ["o_orderkey"], seed=SEED, table="customer",
        row_id="c_custkey", null_rate=0.3,
    ).withColumn("first_order", F.col("first_order").cast("string"))


@query("key_autoincrement", "SELECT o_orderkey, o_custkey, o_orderkey + 1 AS id FROM orders")
def key_autoincrement(t):
    df = t.orders.select("o_orderkey", "o_custkey", F.lit(None).cast("bigint").alias("id"))
    return K.autoincrement(df, ["id"], F.col("o_orderkey"))


_P, _S = "(SELECT count(*) FROM part)", "(SELECT count(*) FROM supplier)"


def _pairs_sql(row: str, source: str) -> str:
    """Two rounds of the network over (position % parts, position // parts)."""
    steps = f"SELECT {row} AS r, {row} % {_P} AS a, {row} // {_P} AS b FROM {source}"
    for k in range(2):
        steps = f"SELECT r, (a + {draw_sql('orders', f'pair{k}:0', 'b')}) % {_P} AS a, b FROM ({steps})"
        steps = f"SELECT r, a, (b + {draw_sql('orders', f'pair{k}:1', 'a')}) % {_S} AS b FROM ({steps})"
    return steps


_part = index_sql("part", "p_partkey", "p_partkey")


@query(
    "key_junction",
    f"SELECT j.r AS o_orderkey, p.p_partkey AS part_id, s.s_suppkey AS supp_id FROM ({_pairs_sql('o_orderkey', 'orders')}) j "
    f"JOIN ({_part}) p ON p.pos = j.a JOIN ({_supp}) s ON s.pos = j.b",
)
def key_junction(t):
    none = F.lit(None).cast("bigint")
    df = t.orders.select("o_orderkey", none.alias("part_id"), none.alias("supp_id"))
    return K.fill_junction(
        df,
        [(t.part, ["part_id"], ["p_partkey"]), (t.supplier, ["supp_id"], ["s_suppkey"])],
        position="o_orderkey", n_rows=t.orders.count(), seed=SEED, table="orders",
    )


@query(
    "key_junction_shares",
    f"WITH j AS MATERIALIZED ({_pairs_sql('o_orderkey', 'orders')}) "
    f"SELECT 'part' AS parent, p_partkey AS key, count(a) AS pairs FROM ({_part}) LEFT JOIN j ON a = pos GROUP BY 2 "
    f"UNION ALL SELECT 'supplier', s_suppkey, count(b) FROM ({_supp}) LEFT JOIN j ON b = pos GROUP BY 2",
)
def key_junction_shares(t):
    """How many pairs each parent got, parents without a pair included."""
    pairs = key_junction(t)
    out = []
    for name, parent, key, column in (("part", t.part, "p_partkey", "part_id"), ("supplier", t.supplier, "s_suppkey", "supp_id")):
        counts = pairs.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("pairs"))
        every = parent.select(F.col(key).alias("key")).join(counts, "key", "left")
        out.append(every.select(F.lit(name).alias("parent"), "key", F.coalesce("pairs", F.lit(0)).alias("pairs")))
    return out[0].unionByName(out[1])


_slots = "(SELECT sum(5 + c_custkey % 20)::BIGINT FROM customer)"
_multiplier = (
    f"(SELECT min(x) FROM range(floor({_slots} * 0.6180339887498949::DOUBLE)::BIGINT, floor({_slots} * 0.6180339887498949::DOUBLE)::BIGINT + 1000) r(x) "
    f"WHERE gcd(x, {_slots}) = 1)"
)


@query(
    "key_fk_capacity",
    "WITH p AS (SELECT c_custkey, 5 + c_custkey % 20 AS cap, sum(5 + c_custkey % 20) OVER w - (5 + c_custkey % 20) AS first FROM customer "
    "WINDOW w AS (ORDER BY substr(md5(c_custkey::VARCHAR), 1, 4), c_custkey)), "
    f"n AS (SELECT {_slots} AS total, {_multiplier} AS a), "
    "o AS (SELECT o_orderkey, ((o_orderkey::HUGEINT * a + total // 3) % total)::BIGINT AS slot FROM orders, n) "
    "SELECT o_orderkey, c_custkey AS buyer FROM o JOIN p ON slot >= first AND slot < first + cap",
)
def key_fk_capacity(t):
    """Buyers drawn without replacement: a customer gets 5 to 24 orders at most."""
    child = t.orders.select("o_orderkey", F.lit(None).cast("bigint").alias("buyer"))
    return K.fill_within_capacity(
        child, t.customer, ["buyer"], ["c_custkey"], 5 + F.col("c_custkey") % 20, position="o_orderkey", n_rows=t.orders.count(),
    )


@query(
    "key_fk_unique",
    "SELECT count(*) AS rows, count(*) AS distinct_keys, 0::BIGINT AS orphans FROM customer",
)
def key_fk_unique(t):
    """One to one: every customer row gets an order of its own."""
    child = t.customer.select("c_custkey", F.lit(None).cast("bigint").alias("order"))
    made = K.fill_within_capacity(child, t.orders, ["order"], ["o_orderkey"], 1, position="c_custkey", n_rows=t.customer.count())
    orders = t.orders.select(F.col("o_orderkey").alias("order"), F.lit(True).alias("there"))
    return made.join(orders, "order", "left").agg(
        F.count("*").alias("rows"), F.countDistinct("order").alias("distinct_keys"), F.count_if(F.col("there").isNull()).alias("orphans")
    )


@query(
    "snk_upsert_apply",
    "WITH src AS (SELECT c_custkey + 700 AS c_custkey, c_name, NULL::VARCHAR AS c_mktsegment FROM customer) "
    "SELECT coalesce(s.c_custkey, o.c_custkey) AS c_custkey, CASE WHEN s.c_custkey IS NOT NULL THEN s.c_name ELSE o.c_name END AS c_name, "
    "CASE WHEN s.c_custkey IS NOT NULL THEN s.c_mktsegment ELSE o.c_mktsegment END AS c_mktsegment "
    "FROM customer o FULL JOIN src s ON s.c_custkey = o.c_custkey",
)
def snk_upsert_apply(t):
    target = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    source = target.select(
        (F.col("c_custkey") + 700).alias("c_custkey"), "c_name",
        F.lit(None).cast("string").alias("c_mktsegment"),
    )
    return upsert_apply(target, source, ["c_custkey"])
