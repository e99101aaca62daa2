"""Integrity of keys whose two sides differ in type, and one scan per table."""

from __future__ import annotations

from relweave import schema as S
from relweave.operators.integrity import validate_integrity


def _schema(parent_type: str, child_type: str) -> S.Database:
    parents = S.Table("parents", (S.Column("p", parent_type, nullable=False, primary_key=True),), ("p",))
    children = S.Table(
        "children",
        (S.Column("id", "bigint", nullable=False, primary_key=True), S.Column("p", child_type), S.Column("day", "date", nullable=False, unique=True)),
        ("id",), (S.ForeignKey(("p",), "parents", ("p",)),),
    )
    return S.Database((parents, children))


def _report(spark, parent_cast: str, child_cast: str) -> dict:
    parents = spark.range(1, 6).selectExpr(f"cast(id AS {parent_cast}) AS p")
    children = spark.range(8).selectExpr(
        "id", f"cast(if(id = 7, NULL, id % 6) AS {child_cast}) AS p", "if(id = 3, NULL, date_add(date'2020-01-01', int(id div 2))) AS day"
    )
    rows = validate_integrity({"parents": parents, "children": children}, _schema("bigint", "bigint")).collect()
    return {(r["check"], r["table"], r["column"]): r["details"] for r in rows}


def test_foreign_keys_compare_in_their_common_type(spark):
    for parent, child in [
        ("bigint", "int"), ("decimal(10,2)", "decimal(12,4)"), ("int", "double"), ("double", "decimal(10,2)"), ("string", "int"),
    ]:
        got = _report(spark, parent, child)
        assert got[("fk_satisfaction", "children", "p")] == "2 orphaned FK values", (parent, child)
        assert got[("pk_uniqueness", "parents", "p")] == ""
        assert got[("pk_uniqueness", "children", "id")] == ""
        assert got[("unique", "children", "day")] == "3 duplicate values"
        assert got[("not_null", "children", "day")] == "1 NULL values"
        assert got[("not_null", "children", "id")] == ""
        assert got[("not_null", "parents", "p")] == ""
        assert len(got) == 7


def test_dates_and_timestamps(spark):
    days = spark.range(3).selectExpr("date_add(date'2020-01-01', int(id)) AS p")
    rows = spark.range(4).selectExpr("id", "timestamp(date_add(date'2020-01-01', int(id))) AS p", "date_add(date'2020-01-01', int(id)) AS day")
    got = validate_integrity({"parents": days, "children": rows}, _schema("date", "timestamp")).where("NOT passed").collect()
    assert [(r["check"], r["details"]) for r in got] == [("fk_satisfaction", "1 orphaned FK values")]


def test_empty_tables_and_parents_are_skipped(spark):
    parents = spark.range(0).selectExpr("id AS p")
    children = spark.range(2).selectExpr("id", "id AS p", "date_add(date'2020-01-01', int(id)) AS day")
    got = validate_integrity({"parents": parents, "children": children}, _schema("bigint", "bigint")).collect()
    assert {r["check"] for r in got} == {"pk_uniqueness", "unique", "not_null"}
    assert {r["table"] for r in got} == {"children"} and all(r["passed"] for r in got)


def test_each_table_is_read_once(spark, tmp_path):
    spark.range(5).selectExpr("id AS p").write.parquet(str(tmp_path / "p"))
    spark.range(5).selectExpr("id", "id AS p", "date_add(date'2020-01-01', int(id)) AS day").write.parquet(str(tmp_path / "c"))
    tables = {"parents": spark.read.parquet(str(tmp_path / "p")), "children": spark.read.parquet(str(tmp_path / "c"))}
    plan = validate_integrity(tables, _schema("bigint", "bigint"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2
