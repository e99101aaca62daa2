"""Partition independence, skew, and the shape of the plans."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from relweave import schema as S
from relweave.functions.draws import Cell
from relweave.functions.generators import REGISTRY, build
from relweave.operators import constraints as C
from relweave.operators import detection as D
from relweave.operators import integrity as I
from relweave.operators import keys as K
from relweave.operators import positions as P
from relweave.plans.generate import GeneratorMapping, generate_table
from relweave.sinks.statements import render_statements
from relweave.suite.base import QUERIES, STAR, star_tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_partitioning_does_not_change_results(tables, parts):
    orders, customer = tables.orders.repartition(parts), tables.customer.repartition(parts, "c_name")
    child = orders.select("o_orderkey", F.lit(None).cast("bigint").alias("buyer"))
    args = {"seed": 7, "table": "orders", "row_id": "o_orderkey"}
    same = tables.orders.select("o_orderkey", F.lit(None).cast("bigint").alias("buyer"))
    assert rows(K.fill_fk(child, customer, ["buyer"], ["c_custkey"], **args)) == rows(
        K.fill_fk(same, tables.customer, ["buyer"], ["c_custkey"], **args)
    )
    flags = tables.lineitem.select("l_returnflag", "l_linestatus")
    assert rows(D.subsample(flags.repartition(parts), 100)) == rows(D.subsample(flags, 100))
    df = tables.supplier.select("s_suppkey", "s_name")
    assert rows(render_statements(df.repartition(parts), "s", "mysql", batch_rows=3)) == rows(
        render_statements(df, "s", "mysql", batch_rows=3)
    )


def test_adding_a_column_leaves_the_others(spark):
    def made(*names):
        table = S.Table("t", tuple(S.Column(n, "varchar") for n in names))
        maps = {n: GeneratorMapping("email") for n in names}
        return generate_table(spark, table, maps, 50, seed=1).select("_row", "a")

    assert rows(made("a")) == rows(made("z", "a", "b"))


def test_all_generators_run_and_are_pure(spark):
    row = F.col("id")
    columns = [build(n, Cell(1, "t", n, row)).cast("string").alias(n) for n in sorted(REGISTRY)]
    frames = [spark.range(0, 64, 1, parts).select("id", *columns) for parts in (1, 7)]
    assert rows(frames[0]) == rows(frames[1])
    assert frames[0].where(" AND ".join(f"`{n}` IS NOT NULL" for n in REGISTRY)).count() == 64


def test_luhn(spark):
    for (card,) in spark.range(200).select(build("credit_card", Cell(1, "t", "c", F.col("id")))).collect():
        digits = [int(d) for d in card][::-1]
        total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits))
        assert len(card) == 16 and total % 10 == 0


def test_dense_index_of_copies_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(P, "COPIES_PER_CHUNK", 10)
    df = spark.range(900).selectExpr("if(id < 300, 0, id % 50) AS k")
    pairs = rows(P.dense_index(df, ["k"], unique=False))
    assert sorted(p for _, p in pairs) == list(range(900))
    places = {}
    for k, p in pairs:
        places.setdefault(k, []).append(p)
    assert all(max(p) - min(p) + 1 == len(p) for p in places.values())


def test_spread_copies_keeps_every_copy(spark, monkeypatch):
    monkeypatch.setattr(P, "COPIES_PER_CHUNK", 7)
    df = spark.createDataFrame([("a", 1), ("b", 7), ("c", 8), ("d", 50)], "k string, _copies long")
    out = P.spread_copies(df).groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("_copy").alias("d"), F.max("_copy").alias("m"))
    assert rows(out) == [("a", 1, 1, 0), ("b", 7, 7, 6), ("c", 8, 8, 7), ("d", 50, 50, 49)]


@pytest.mark.parametrize("target", [4, 64])
def test_dense_codes_against_sorting(spark, target):
    words = sorted({f"{'common' * 3}{i * 7919 % 5003}" for i in range(700)} | {"", "é", "a"}, key=lambda w: w.encode())
    df = spark.createDataFrame([("c", w) for w in words] + [("d", w) for w in words[:10]], "g string, v string")
    found = {(r["g"], r["v"]): r["code"] for r in P.dense_codes(df, ["g"], "v", target=target).collect()}
    assert all(found[("c", w)] == i for i, w in enumerate(words))
    assert all(found[("d", w)] == i for i, w in enumerate(words[:10]))


def test_subsample_weighs_copies(spark):
    df = spark.range(3000).selectExpr("if(id < 1000, 'hot', string(id)) AS v")
    taken = D.subsample(df, 600)
    assert taken.count() == 600
    assert 120 < taken.where("v = 'hot'").count() < 280


def test_junction_pairs_never_repeat(spark):
    out = K.junction_codes(spark.range(600), "id", [30, 20], 600)
    assert out.select("ix0", "ix1").distinct().count() == 600
    low, high = out.agg(F.min("ix0"), F.max("ix0")).first()
    assert (low, high) == (0, 29)
    with pytest.raises(ValueError):
        K.junction_codes(spark.range(601), "id", [30, 20], 601)


def test_self_reference_is_acyclic(spark):
    df = spark.range(100).select("id", F.lit(None).cast("bigint").alias("parent"))
    found = K.self_reference(df, ["parent"], ["id"], seed=1, table="t", position="id", size=100, dense_first=0).collect()
    assert [r["parent"] is None for r in found] == [i < 20 for i in range(100)]
    assert all(r["parent"] < r["id"] for r in found if r["parent"] is not None)


def data_exchanges_to_one_partition(text: str) -> list[str]:
    """Exchanges to one partition that carry more than aggregated rows or a bounded table."""
    bad = []
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = lines[i + 1] if i + 1 < len(lines) else ""
            if not re.search(r"HashAggregate|LocalLimit|Project \[_bucket|TakeOrdered", below):
                bad.append(below)
    return bad


@pytest.mark.parametrize(
    "name",
    ["int_report", "key_dense_index", "key_fk_single", "key_fk_composite", "con_check_range", "fid_report",
     "det_subsample_copies", "snk_insert_mysql", "cat_map_columns", "cat_fingerprint", "cat_infer", "pipe_star_integrity"],
)
def test_plans_stay_distributed(spark, name):
    text = plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert not data_exchanges_to_one_partition(text)
    for forbidden in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF"):
        assert forbidden not in text


def test_generation_is_one_narrow_stage(spark):
    table = S.Table("t", (S.Column("email", "varchar"), S.Column("price", "decimal")))
    df = generate_table(spark, table, {"email": GeneratorMapping("email"), "price": GeneratorMapping("price")}, 100, seed=1)
    assert "Exchange" not in plan(df)
    assert "ssn" not in plan(df) and plan(df.select("_row")).count("md5") == 0


def test_dense_parent_needs_no_join(spark):
    child = spark.range(10).select("id", F.lit(None).cast("bigint").alias("p"))
    df = K.fill_fk(child, None, ["p"], ["id"], seed=1, table="t", row_id="id", dense=(1, 5))
    assert "Join" not in plan(df) and df.where("p BETWEEN 1 AND 5").count() == 10


def test_foreign_keys_are_checked_without_a_join(tables):
    text = plan(I.validate_integrity(star_tables(tables), STAR))
    assert "Join" not in text


def test_only_needed_columns_are_read(tables):
    text = plan(I.pk_uniqueness(tables.lineitem, "lineitem", ["l_orderkey", "l_linenumber"]))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in text


def test_repeats_are_found_through_the_row_id(tables):
    df = tables.events.select("event_id", "event_type")
    text = plan(C.mark_repeats(df, ["event_type"], "event_id"))
    joins = [line for line in text.splitlines() if "Join" in line]
    assert joins and all("event_type" not in line.split("Join", 1)[1].split("LeftOuter")[0] for line in joins)
