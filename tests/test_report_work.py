"""Work per row and per key in generated databases and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave import schema as S
from relweave.functions.draws import hex_draw, letters
from relweave.operators import integrity as I

KEY = {"nullable": False, "primary_key": True}


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_letters_draw_once(spark):
    drawn = spark.range(50).select("id", letters(hex_draw(1, "t", "c", F.col("id")), 4).alias("text"), F.conv(F.substring(hex_draw(1, "t", "c", F.col("id")), 1, 15), 16, 26).alias("low"))
    assert _plan(drawn.select("text")).count("md5(") == 1
    places = "0123456789ABCDEFGHIJKLMNOP"
    for r in drawn.collect():
        assert r["text"] == "".join(chr(97 + places.index(c)) for c in r["low"][-4:].rjust(4, "0"))


def test_report_rows_are_made_from_sums_not_from_every_key(spark):
    db = S.Database((S.Table("t", (S.Column("a", "bigint", **KEY), S.Column("b", "varchar", nullable=False), S.Column("c", "varchar", nullable=False)), ("a",)),), name="d")
    df = spark.createDataFrame([(1, None, "x"), (1, None, None), (2, "y", None), (3, "z", "x")], "a bigint, b string, c string")
    report = I.validate_integrity({"t": df}, db)
    plan = _plan(report)
    assert plan.index("Aggregate [number") < plan.index("Generate inline") < plan.index("nulls")
    got = {(r["check"], r["column"]): (r["passed"], r["details"]) for r in report.collect()}
    assert got == {
        ("pk_uniqueness", "a"): (False, "1 duplicate PK values"), ("not_null", "a"): (True, ""),
        ("not_null", "b"): (False, "2 NULL values"), ("not_null", "c"): (False, "2 NULL values"),
    }
