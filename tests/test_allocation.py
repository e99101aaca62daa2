"""Free values, draws without replacement, spread pairs, existing parents, folds fitted side by side."""

from __future__ import annotations

import datetime
import math
import random
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from relweave import schema as S
from relweave.operators import allocation as A
from relweave.operators import constraints as C
from relweave.operators import detection as D
from relweave.operators import integrity as I
from relweave.operators import keys as K
from relweave.plans.generate import generate_database


def allocated(rows, first, last):
    """Brute force: the first row of a key stays, the others of a group take its smallest free values, in any order."""
    out, seen = {}, set()
    groups = {}
    for i, g, v in sorted(rows):
        if v is None or g is None:
            continue
        if (g, v) in seen:
            groups.setdefault(g, []).append(i)
        else:
            seen.add((g, v))
            out[i] = v
    free = {}
    for g, extra in groups.items():
        used = {v for h, v in seen if h == g}
        free[g] = sorted([v for v in range(first, last + 1) if v not in used][: len(extra)])
    return out, {g: sorted(extra) for g, extra in groups.items()}, free


@pytest.mark.parametrize("range_rows,groups", [(20_000, 1), (7, 1), (7, 4), (3, 30)])
def test_free_values_against_brute_force(spark, monkeypatch, range_rows, groups):
    monkeypatch.setattr(A, "RANGE_ROWS", range_rows)  # small ranges make every group hot
    pick = random.Random(range_rows + groups)
    rows = [(i, None if pick.random() < 0.03 else pick.randrange(groups) ** 2 % groups, None if pick.random() < 0.05 else pick.choice([5, 5, 5, pick.randrange(-3, 240)])) for i in range(200)]
    rows += [(1000 + i, 0, -50) for i in range(4)]  # outside of the domain
    df = spark.createDataFrame(rows, "row bigint, g int, v int").repartition(5)
    columns = ["v"] if groups == 1 else ["g", "v"]
    if groups == 1:
        rows = [(i, 0, v) for i, _, v in rows]
    kept, extra, free = allocated(rows, 0, 230)
    got = {r["row"]: r for r in A.allocate_unique(df, columns, "v", A.integers(0, 230, "int"), row_id="row").collect()}
    assert all(got[i]["v"] == v for i, v in kept.items())
    for g, ids in extra.items():
        assert sorted(got[i]["v"] for i in ids) == free[g]
    assert all(got[i]["v"] is None for i, _, v in rows if v is None)


def test_a_domain_is_used_up_exactly(spark):
    df = spark.range(50).select(F.col("id").alias("row"), (F.col("id") % 3).alias("v"))
    fixed = A.allocate_unique(df, ["v"], "v", A.integers(0, 49), row_id="row")
    assert sorted(r["v"] for r in fixed.collect()) == list(range(50))
    with pytest.raises(A.DomainExhausted) as short:
        A.allocate_unique(df, ["v"], "v", A.integers(0, 46), row_id="row")
    assert short.value.missing == 3
    table = S.Table("t", (S.Column("row", "bigint"), S.Column("v", "integer", unique=True, check="v >= 0 AND v <= 46")))
    with pytest.raises(C.ConstraintError) as error:
        C.repair_unique_sets(df.select("row", F.col("v").cast("int")), table, seed=1, row_id="row", domains=C.table_domains(spark, table))
    assert (error.value.table, error.value.column) == ("t", "v")


def test_tables_without_repeats_are_returned_as_they_are(spark):
    df = spark.range(5).select(F.col("id").alias("row"), F.col("id").alias("v"))
    assert A.allocate_unique(df, ["v"], "v", A.integers(0, 4), row_id="row") is df
    assert A.allocate_unique(df.limit(0), ["v"], "v", A.integers(0, 4), row_id="row").count() == 0


CODECS = [
    (S.Column("c", "integer"), C.Domain(-5, 5), [-5, 0, 5], [6, -6]),
    (S.Column("c", "decimal", precision=8, scale=2), C.Domain(0.5, 2.0), [Decimal("0.50"), Decimal("1.25"), Decimal("2.00")], [Decimal("2.01")]),
    (S.Column("c", "float"), C.Domain(0, 1), [0.0, 0.07, 1.0], [0.071, 1.5]),
    (S.Column("c", "varchar", max_length=3), None, ["aaa", "abz", "zzz"], ["AAA", "aa", "aaaa", "é"]),
    (S.Column("c", "enum", enum_values=("x", "y")), None, ["x", "y"], ["z"]),
    (S.Column("c", "varchar"), C.Domain(allowed=("p", "q")), ["p", "q"], [""]),
    (S.Column("c", "boolean"), None, [True, False], []),
    (S.Column("c", "date"), None, [datetime.date(1970, 1, 1), datetime.date(2024, 2, 29)], [datetime.date(1969, 12, 31)]),
]


@pytest.mark.parametrize("column,domain,inside,outside", CODECS)
def test_codecs_read_back_what_they_write(spark, column, domain, inside, outside):
    codec = A.codec_of(column, domain)
    df = spark.createDataFrame([(v,) for v in [*inside, *outside, None]], S.T.StructType([S.T.StructField("v", column.spark_type)]))
    rows = df.select("v", codec.encode(F.col("v")).alias("k")).withColumn("back", codec.decode(F.col("k"))).collect()
    for r in rows:
        if r["v"] in inside and r["v"] is not None:
            assert r["back"] == r["v"] and codec.first <= r["k"] <= codec.last
        else:
            assert r["k"] is None
    assert len({r["k"] for r in rows if r["k"] is not None}) == len(inside)


@pytest.mark.parametrize("kind", ["smallint", "decimal", "float", "varchar", "date", "timestamp", "uuid", "json"])
def test_every_type_becomes_unique(spark, kind):
    table = S.Table("t", (S.Column("row", "bigint"), S.Column("c", kind, unique=True, max_length=9 if kind == "varchar" else None)))
    first = C.fallback_value(table.column("c"), C.Cell(1, "t", "c", F.lit(0))).cast(table.column("c").spark_type)
    df = spark.range(300).select(F.col("id").alias("row"), first.alias("c"))
    fixed = C.repair_unique_sets(df, table, seed=3, row_id="row")
    assert fixed.select("c").distinct().count() == 300 and fixed.schema["c"].dataType == table.column("c").spark_type


# --- keys ------------------------------------------------------------------------------
@pytest.mark.parametrize("sizes", [[30, 20], [7, 1], [1, 1], [5, 6, 7], [13]])
def test_codes_are_a_permutation(spark, sizes):
    total = math.prod(sizes)
    made = K.junction_codes(spark.range(total), "id", sizes, total, seed=1).drop("id")
    rows = {tuple(r) for r in made.collect()}
    assert len(rows) == total and all(0 <= v < n for r in rows for v, n in zip(r, sizes, strict=True))


def test_parents_get_about_the_same_share(spark):
    made = K.junction_codes(spark.range(40_000), "id", [400, 900], 40_000, seed=1)
    for column, n in (("ix0", 400), ("ix1", 900)):
        counts = [r["count"] for r in made.groupBy(column).count().collect()]
        mean = 40_000 / n
        assert len(counts) == n and max(abs(c - mean) for c in counts) < 6 * mean**0.5
    few = K.junction_codes(spark.range(5000), "id", [10**9, 10**9], 5000, seed=1)  # 10^18 pairs
    assert few.select("ix0").distinct().count() > 4990 and few.select("ix1").distinct().count() > 4990
    low, high = few.agg(F.min("ix0"), F.max("ix0")).first()
    assert low < 10**7 and high > 99 * 10**7


def test_capacities_are_kept(spark):
    parent = spark.createDataFrame([(f"p{i}", i % 5 if i else None) for i in range(60)] + [(None, 9)], "k string, cap int")
    total = sum(i % 5 for i in range(1, 60))
    child = spark.range(total).select(F.col("id").alias("row"), F.lit(None).cast("string").alias("p"))
    made = K.fill_within_capacity(child, parent, ["p"], ["k"], F.col("cap"), position="row", n_rows=total)
    assert Counter(r["p"] for r in made.collect()) == {f"p{i}": i % 5 for i in range(1, 60) if i % 5}
    few = K.fill_within_capacity(child.limit(20), parent, ["p"], ["k"], 1, position="row", n_rows=total - total + 20)
    assert few.select("p").distinct().count() == 20
    with pytest.raises(ValueError):
        K.fill_within_capacity(child, parent, ["p"], ["k"], F.col("cap"), position="row", n_rows=total + 1)


def link(column: str, table: str, ref: str) -> S.ForeignKey:
    return S.ForeignKey((column,), table, (ref,))


def test_unique_foreign_keys_hold_by_construction(spark):
    key = S.Column("id", "bigint", nullable=False, primary_key=True, autoincrement=True)
    db = S.Database((
        S.Table("a", (key,), ("id",)), S.Table("b", (key,), ("id",)),
        S.Table("one", (key, S.Column("a_id", "bigint", nullable=False, unique=True)), ("id",), (link("a_id", "a", "id"),)),
        S.Table("pair", (key, S.Column("a_id", "bigint"), S.Column("b_id", "bigint"), S.Column("c_id", "bigint")), ("id",),
                (link("a_id", "a", "id"), link("b_id", "b", "id"), link("c_id", "b", "id")), (S.Index(("a_id", "b_id"), True),)),
    ))
    made = generate_database(spark, db, {"a": 40, "b": 10, "one": 40, "pair": 390})
    assert all(r["passed"] for r in I.validate_integrity(made.tables, db).collect())
    for rows in ({"a": 40, "one": 41}, {"a": 4, "b": 5, "one": 1, "pair": 21}):
        with pytest.raises(C.ConstraintError):
            generate_database(spark, db, {"b": 10, "pair": 1} | rows)


def test_existing_rows_stay_and_get_what_they_lack(spark):
    users = S.Table("users", (
        S.Column("code", "varchar", nullable=False, primary_key=True), S.Column("name", "varchar"),
        S.Column("email", "varchar", nullable=False, unique=True, max_length=30), S.Column("age", "integer", nullable=False, check="age BETWEEN 30 AND 40"),
        S.Column("boss", "varchar"), S.Column("last_order", "bigint"),
    ), ("code",), (link("boss", "users", "code"), link("last_order", "orders", "id")))
    orders = S.Table("orders", (
        S.Column("id", "bigint", nullable=False, primary_key=True, autoincrement=True), S.Column("user_code", "varchar", nullable=False),
    ), ("id",), (link("user_code", "users", "code"),))
    db = S.Database((users, orders))
    given = spark.createDataFrame([(f"u{i}", f"name {i}") for i in range(25)], "code string, name string").repartition(3)
    made = generate_database(spark, db, {"orders": 300}, existing={"users": given})
    assert made.rows == {"users": 25, "orders": 300}
    assert all(r["passed"] for r in I.validate_integrity(made.tables, db).collect())
    rows = made.tables["users"].collect()
    assert {(r["code"], r["name"]) for r in rows} == {(f"u{i}", f"name {i}") for i in range(25)}
    assert all(30 <= r["age"] <= 40 and r["last_order"] is not None for r in rows) and sum(r["boss"] is None for r in rows) == 5
    assert {r["user_code"] for r in made.tables["orders"].collect()} == {f"u{i}" for i in range(25)}
    whole = made.tables["users"]
    again = generate_database(spark, db, {"orders": 10}, existing={"users": whole}).tables["users"]
    assert again is whole
    with pytest.raises(ValueError):
        generate_database(spark, db, 5, existing={"users": given.drop("code")})


# --- detection ----------------------------------------------------------------------------
def test_folds_equal_fits_one_by_one(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=300) > 0.3).astype(float)
    fold = np.arange(300) % D.FOLDS
    rows = [(float(y[i]), int(fold[i]), 1.0, *map(float, x[i])) for i in range(300)]
    made = D.fit_folds(spark.createDataFrame(rows, "label double, fold int, x0 double, x1 double, x2 double, x3 double"), 4)
    design = np.c_[np.ones(300), x]
    for f in range(D.FOLDS):
        part, w = fold != f, np.zeros(4)
        for _ in range(20000):  # plain gradient descent on the same loss
            p = 1 / (1 + np.exp(-design[part] @ w))
            w -= 0.01 * (design[part].T @ (p - y[part]) + w * [0, 1, 1, 1])
        assert np.abs(w - made[f]).max() < 1e-6


def test_separable_rows_do_not_overflow(spark):
    rows = [(float(i % 2), i // 2 % D.FOLDS, 1.0, 1e4 * (i % 2) + i % 7) for i in range(100)]
    made = D.fit_folds(spark.createDataFrame(rows, "label double, fold int, x0 double, x1 double"), 2)
    assert np.isfinite(made).all()


def test_correlations_need_no_generated_rows(spark):
    from relweave.operators.fidelity import correlations

    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 1.0, 5.0), (3.0, 0.5, None), (None, 9.0, 5.0)], "a double, b double, c double")
    made = correlations(df, ["a", "b", "c"])
    got = {(r["i"], r["j"]): round(r["r"], 6) for r in made.collect()}
    assert got == {(0, 0): 1.0, (0, 1): round(np.corrcoef([1, 2, 3], [2, 1, 0.5])[0, 1], 6), (0, 2): 0.0, (1, 1): 1.0, (1, 2): 0.0, (2, 2): 0.0}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and plan.index("Generate") < plan.index("Aggregate")  # above the aggregate, over its one row
