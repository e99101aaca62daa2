"""Rows of a task in generated databases."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave import schema as S
from relweave.operators import integrity as I
from relweave.operators import positions
from relweave.plans.generate import generate_database

KEY = {"nullable": False, "primary_key": True}
DB = S.Database((
    S.Table("users", (S.Column("id", "bigint", **KEY),), ("id",)),
    S.Table("tags", (S.Column("label", "varchar", **KEY),), ("label",)),
    S.Table("marks", (S.Column("user_id", "bigint", **KEY), S.Column("tag", "varchar", **KEY)), ("user_id", "tag"),
            (S.ForeignKey(("user_id",), "users", ("id",)), S.ForeignKey(("tag",), "tags", ("label",)))),
    S.Table("visits", (S.Column("id", "bigint", autoincrement=True, **KEY), S.Column("user_id", "bigint", nullable=False), S.Column("tag", "varchar")), ("id",),
            (S.ForeignKey(("user_id",), "users", ("id",)), S.ForeignKey(("tag",), "tags", ("label",)))),
), name="visits")


def _made(spark):
    return {
        "users": spark.range(900).select((F.col("id") * 7).alias("id")), "tags": spark.range(600).select(F.concat(F.lit("t"), F.col("id")).alias("label")),
    }


def test_a_task_has_a_bounded_number_of_rows_whatever_the_table(spark, monkeypatch):
    counts, existing = {"marks": 6000, "visits": 8000}, _made(spark)
    whole = generate_database(spark, DB, counts, existing=existing).tables
    monkeypatch.setattr(positions, "TASK_ROWS", 250)
    spread = generate_database(spark, DB, counts, existing=existing).tables
    for name in counts:
        tasks = spread[name].groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0]
        assert tasks <= 3 * 250, name
        assert whole[name].exceptAll(spread[name]).count() == 0 and spread[name].count() == counts[name]
    assert all(r["passed"] for r in I.validate_integrity(spread, DB).collect())


def test_an_empty_parent_leaves_the_child_where_it_is(spark, monkeypatch):
    monkeypatch.setattr(positions, "TASK_ROWS", 10)
    existing = {**_made(spark), "tags": spark.createDataFrame([], "label string")}
    rows = generate_database(spark, S.Database(DB.tables[:2] + DB.tables[3:], name="v"), {"visits": 300}, existing=existing).tables["visits"].collect()
    assert len(rows) == 300 and all(r["tag"] is None and r["user_id"] is not None for r in rows)
