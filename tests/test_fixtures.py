"""Literal cases for every check, repair and metric."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from relweave import schema as S
from relweave.functions.draws import Cell
from relweave.operators import catalog as K
from relweave.operators import constraints as C
from relweave.operators import detection as D
from relweave.operators import fidelity as Q
from relweave.operators import integrity as I

USERS = S.Table("users", (S.Column("id", "integer", nullable=False, primary_key=True),
                          S.Column("email", "varchar", nullable=False, unique=True)), ("id",))
ORDERS = S.Table("orders", (S.Column("id", "integer", nullable=False, primary_key=True),
                            S.Column("user_id", "integer", nullable=False)), ("id",),
                 (S.ForeignKey(("user_id",), "users", ("id",)),))
DB = S.Database((USERS, ORDERS))


def report(spark, users, orders, db=DB):
    data = {
        "users": spark.createDataFrame(users, "id int, email string"),
        "orders": spark.createDataFrame(orders, "id int, user_id int"),
    }
    rows = I.validate_integrity(data, db).collect()
    return {(r["check"], r["table"], r["column"]): (r["passed"], r["details"]) for r in rows}


def test_clean_tables_pass(spark):
    found = report(spark, [(1, "a"), (2, "b")], [(1, 1), (2, 1)])
    assert all(ok for ok, _ in found.values())
    assert len(found) == 8


def test_orphan(spark):
    found = report(spark, [(1, "a")], [(1, 999)])
    assert found[("fk_satisfaction", "orders", "user_id")] == (False, "1 orphaned FK values")


def test_null_fk_is_no_orphan(spark):
    found = report(spark, [(1, "a")], [(1, None)])
    assert found[("fk_satisfaction", "orders", "user_id")] == (True, "")
    assert found[("not_null", "orders", "user_id")] == (False, "1 NULL values")


def test_null_counts_in_primary_key_but_not_in_unique(spark):
    found = report(spark, [(None, None), (None, None)], [(1, 1)])
    assert found[("pk_uniqueness", "users", "id")] == (False, "1 duplicate PK values")
    assert found[("unique", "users", "email")] == (True, "")


def test_empty_parent_or_table_gives_no_row(spark):
    found = report(spark, [], [(1, 1)])
    assert not any(table == "users" for _, table, _ in found)
    assert not any(check == "fk_satisfaction" for check, _, _ in found)


def test_mixed_key_types_and_composites(spark):
    table = S.Table(
        "pairs", (S.Column("a", "varchar"), S.Column("b", "integer")), ("a", "b"),
        indexes=(S.Index(("b", "a"), True),),
    )
    df = spark.createDataFrame([("x", 1), ("x", 1), ("x", None), ("x", None)], "a string, b int")
    found = {r["check"]: r["details"] for r in I.validate_integrity({"pairs": df}, S.Database((table,))).collect()}
    assert found["pk_uniqueness"] == "2 duplicate PK values"
    assert found["unique"] == "1 duplicate tuples"


def test_foreign_key_between_different_types(spark):
    child = spark.createDataFrame([("1",), ("3",)], "ref string")
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    db = S.Database((S.Table("p", (S.Column("id", "integer"),)),
                     S.Table("c", (S.Column("ref", "varchar"),), foreign_keys=(S.ForeignKey(("ref",), "p", ("id",)),))))
    found = I.validate_integrity({"c": child, "p": parent}, db).where("check = 'fk_satisfaction'").collect()
    assert [r["details"] for r in found] == ["1 orphaned FK values"]


# --- repair -------------------------------------------------------------------------
def redraw(column, space):
    return lambda attempt: {column: Cell(1, "t", f"{column}:unique{attempt}", F.col("row")).below(space)}


def test_unique_repair_keeps_first(spark):
    df = spark.createDataFrame(list(enumerate(["alice", "alice", "bob", "bob", "carol", None, None])), "row long, name string")
    table = S.Table("t", (S.Column("row", "bigint"), S.Column("name", "varchar", unique=True)))
    rows = {r["row"]: r["name"] for r in C.repair_unique_sets(df, table, seed=1, row_id="row").collect()}
    named = [v for v in rows.values() if v is not None]
    assert len(set(named)) == 5 and len(named) == 5
    assert (rows[0], rows[2], rows[4]) == ("alice", "bob", "carol")


def test_unique_repair_needs_several_rounds(spark):
    df = spark.range(40).select(F.col("id").alias("row"), F.lit(0).cast("bigint").alias("v"))
    fixed = C.repair_unique(df, ["v"], redraw("v", 400), row_id="row", table="t")
    assert fixed.select("v").distinct().count() == 40


def test_unique_repair_gives_up(spark):
    df = spark.range(5).select(F.col("id").alias("row"), F.lit(0).cast("bigint").alias("v"))
    with pytest.raises(C.ConstraintError) as error:
        C.repair_unique(df, ["v"], redraw("v", 2), row_id="row", table="t")
    assert (error.value.table, error.value.column, error.value.attempts) == ("t", "v", 10)


def test_check_range(spark):
    table = S.Table("items", (S.Column("row", "bigint"), S.Column("price", "float", check="price >= 0 AND price <= 1000")))
    df = spark.createDataFrame([(0, -5.0), (1, 50.0), (2, 9999.0), (3, None)], "row long, price double")
    domains = C.table_domains(spark, table)
    rows = {r["row"]: r["price"] for r in C.repair_check(df, domains, table, seed=1, row_id="row").collect()}
    assert rows[1] == 50.0 and rows[3] is None
    assert all(0 <= rows[k] <= 1000 for k in (0, 2))


def test_one_sided_check_is_repaired_inside(spark):
    table = S.Table("p", (S.Column("row", "bigint"), S.Column("age", "integer", check="age >= 18")))
    df = spark.range(200).select(F.col("id").alias("row"), F.lit(5).alias("age"))
    fixed = C.repair_check(df, C.table_domains(spark, table), table, seed=1, row_id="row")
    low, high = fixed.agg(F.min("age"), F.max("age")).first()
    assert 18 <= low and high <= 18 + C.DEFAULT_SPAN
    assert fixed.schema["age"].dataType.typeName() == "integer"


def test_unique_text_cuts_the_base(spark):
    rows = spark.range(2000).select(C.unique_text(F.lit("averylongname"), F.col("id"), 6).alias("u")).collect()
    assert len({r["u"] for r in rows}) == 2000 and max(len(r["u"]) for r in rows) <= 6


def test_unique_int_is_a_permutation(spark):
    values = [r[0] for r in spark.range(1000).select(C.unique_int(F.col("id"), 1000, 7)).collect()]
    assert sorted(values) == list(range(7, 1007))


# --- fidelity ------------------------------------------------------------------------
METRICS = S.Table("m", (S.Column("x", "float"), S.Column("y", "integer"), S.Column("c", "varchar")))


def scores(spark, real, made):
    make = lambda rows: spark.createDataFrame(rows, "x double, y int, c string")
    rows = Q.table_fidelity(make(real), make(made), METRICS).collect()
    return {(r["metric"], r["column"]): r["score"] for r in rows}


def test_identical_tables(spark):
    rows = [(float(i), i % 7, "ab"[i % 2]) for i in range(50)]
    found = scores(spark, rows, rows)
    assert min(found.values()) >= 0.99
    assert ("correlation_similarity", "x, y") in found


def brute_ks(a, b):
    points = sorted(set(a) | set(b))
    share = lambda values, p: sum(v <= p for v in values) / len(values)
    return 1 - max(abs(share(a, p) - share(b, p)) for p in points)


@pytest.mark.parametrize("buckets", [2, 16, 1024])
def test_ks_against_brute_force_with_a_hot_value(spark, buckets):
    rng = random.Random(3)
    real = [round(rng.gauss(0, 5), 1) for _ in range(400)] + [1.5] * 250
    made = [round(rng.gauss(1, 4), 1) for _ in range(300)] + [-0.0] * 5 + [0.0] * 4
    frames = [spark.createDataFrame([(v,) for v in values], "x double") for values in (real, made)]
    counts = Q.value_counts(*frames, {"x": "numeric"})
    ks = Q.ks_scores(counts, buckets).first()["ks"]
    assert ks == pytest.approx(brute_ks(real, made), abs=1e-12)


def test_disjoint_ks_is_low(spark):
    found = scores(spark, [(float(i), i, "a") for i in range(1, 6)], [(100.0 * i, i, "b") for i in range(1, 6)])
    assert found[("ks_complement", "x")] < 0.5
    assert found[("tv_complement", "c")] == 0.0


def test_columns_without_values_are_left_out(spark):
    found = scores(spark, [(1.0, None, None), (2.0, None, None)], [(1.0, 3, "a"), (2.5, 4, "b")])
    assert set(found) == {("ks_complement", "x"), ("cardinality_similarity", "x")}


def test_constant_column_correlates_with_nothing(spark):
    rows = [(float(i), 1, "a") for i in range(10)]
    assert scores(spark, rows, rows)[("correlation_similarity", "x, y")] == 1.0


def test_long_texts_differ_after_any_prefix(spark):
    head = "x" * 5000
    found = scores(spark, [(1.0, 1, head + "a")], [(1.0, 1, head + "b")])
    assert found[("tv_complement", "c")] == 0.0


# --- detection -----------------------------------------------------------------------
def test_separable_rows_are_detected(spark):
    table = S.Table("users", (S.Column("id", "integer"), S.Column("age", "integer"), S.Column("salary", "float"), S.Column("city", "varchar")))
    rng = random.Random(1)
    make = lambda ages, pay, city: spark.createDataFrame(
        [(i, rng.choice(ages), pay + rng.random() * 1000, city) for i in range(60)], "id int, age int, salary double, city string"
    )
    real, far = make(range(18, 30), 30000, "NYC"), make(range(50, 80), 100000, "LA")
    db = S.Database((table,))
    assert D.validate_detection({"users": far}, {"users": real}, db).first()["accuracy"] > 0.9
    near = make(range(18, 30), 30000, "NYC")
    assert abs(D.validate_detection({"users": near}, {"users": real}, db).first()["accuracy"] - 0.5) < 0.2
    few = D.validate_detection({"users": near.limit(5)}, {"users": real}, db)
    assert few.count() == 0
    assert D.detection_verdict(few).first()["overall_score"] == 0.5


# --- catalog -------------------------------------------------------------------------
def test_pii_names(spark):
    names = {"ssn": True, "dob": True, "Credit_Card": True, "phone_number": True, "email": True, "salary": True,
             "tax_id": True, "headphone_count": False, "created_at": False, "order_total": False, "status": False,
             "id": False, "name": False, "user_ssn": False}
    df = spark.createDataFrame([(n,) for n in names], "column string")
    assert {r["column"]: r["is_pii"] for r in K.flag_pii_columns(df).collect()} == names


def test_name_rules(spark):
    columns = [("email", "varchar"), ("firstName", "varchar"), ("emailAddress", "varchar"), ("zzz", "uuid"), ("kind_of", "enum")]
    table = S.Table("t", tuple(S.Column(n, k, enum_values=("a",) if k == "enum" else None) for n, k in columns))
    rows = {r["column"]: r for r in K.map_columns(S.catalog_frame(spark, S.Database((table,)))).collect()}
    assert (rows["email"]["generator"], rows["email"]["confidence"]) == ("email", 0.95)
    assert (rows["firstName"]["generator"], rows["firstName"]["confidence"]) == ("first_name", 0.95)
    assert rows["emailAddress"]["generator"] == "email"
    assert rows["emailAddress"]["confidence"] == pytest.approx(0.855)
    assert (rows["zzz"]["generator"], rows["zzz"]["confidence"]) == ("uuid4", 0.5)
    assert rows["kind_of"]["params"] == {"enum_values": '["a"]'}


def test_fingerprint_ignores_order_and_comments(spark):
    a = S.Table("a", (S.Column("x", "integer", comment="one"), S.Column("y", "enum", enum_values=("p", "q"))))
    b = S.Table("b", (S.Column("z", "text"),))
    a2 = S.Table("a", (S.Column("y", "enum", enum_values=("q", "p")), S.Column("x", "integer")))
    c = S.Table("b", (S.Column("z", "varchar"),))
    frame = S.catalog_frame(
        spark, S.Database((a, b), name="one"), S.Database((b, a2), name="two"), S.Database((a, c), name="three")
    )
    found = {r["db"]: r["fingerprint"] for r in K.schema_fingerprint(frame).collect()}
    assert found["one"] == found["two"] != found["three"]
