"""Upserts that leave files alone, positions in split buckets, text of numbers and times."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from relweave.functions import literals as L
from relweave.operators import file_table, positions
from relweave.operators.upsert import upsert_apply
from relweave.session import scratch_path


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def table(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    path = scratch_path(spark, "t")
    file_table.write_files(df, path, ["k"], files=10)
    return df, path


def test_only_touched_files_are_rewritten(spark, table):
    df, path = table
    before = {r["file"] for r in file_table.manifest(spark, path).collect()}
    source = spark.createDataFrame([(205, "new"), (210, None), (5000, "more")], "k long, v string")
    done = file_table.upsert_files(spark, path, source, ["k"], files=1)
    assert len(done.replaced) == 1 and before - set(done.kept) == set(done.replaced) and set(done.kept) < before
    assert rows_of(file_table.read_files(spark, path)) == rows_of(upsert_apply(df, source, ["k"]))
    assert rows_of(file_table.read_files(spark, path, 0)) == rows_of(df)  # the old version is whole


def test_new_keys_touch_no_file(spark, table):
    df, path = table
    source = spark.createDataFrame([(-5, "a"), (10_000, "b")], "k long, v string")
    done = file_table.upsert_files(spark, path, source, ["k"], files=1)
    assert done.replaced == [] and file_table.read_files(spark, path).count() == 1002
    done = file_table.upsert_files(spark, path, source.limit(0), ["k"], files=1)
    assert done.replaced == [] and done.version == 2 and file_table.read_files(spark, path).count() == 1002


def test_keys_of_two_columns_and_texts(spark):
    df = spark.createDataFrame([(f"g{i % 7}", i, "old") for i in range(300)], "g string, n int, v string")
    path = scratch_path(spark, "t")
    file_table.write_files(df, path, ["g", "n"], files=8)
    source = spark.createDataFrame([("g3", 10, "new"), ("g3", 11, "added"), (None, 1, "no key")], "g string, n int, v string")
    done = file_table.upsert_files(spark, path, source, ["g", "n"], files=1)
    assert 1 <= len(done.replaced) <= 2
    assert rows_of(file_table.read_files(spark, path)) == rows_of(upsert_apply(df, source, ["g", "n"]))


def test_two_jobs_do_not_publish_one_version(spark, table):
    _, path = table
    listed = file_table.manifest(spark, path)
    file_table._publish(spark, path, 1, listed)
    with pytest.raises(RuntimeError):
        file_table._publish(spark, path, 1, listed)
    with pytest.raises(FileNotFoundError):
        file_table.manifest(spark, path + "-none")


@pytest.mark.parametrize("bucket_rows", [1_000_000, 5])
def test_buckets_split_with_the_number_of_rows(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(positions, "BUCKET_ROWS", bucket_rows)
    df = spark.range(4000).select((F.col("id") * 7).alias("k"))
    placed = positions.dense_index(df, ["k"], prefix_length=1)
    assert sorted(r["pos"] for r in placed.collect()) == list(range(4000))
    keyed = positions.split_buckets(df, ["k"], df, 1)
    largest = keyed.groupBy("_bucket", "_sub").count().agg(F.max("count")).first()[0]
    assert largest < 20 if bucket_rows == 5 else largest > 150
    copies = df.select((F.col("k") % 50).alias("k"))
    assert sorted(r["pos"] for r in positions.dense_index(copies, ["k"], unique=False, prefix_length=1).collect()) == list(range(4000))


def test_times_keep_six_digits(spark):
    at = [datetime.datetime(2024, 5, 6, 7, 8, 9), datetime.datetime(2024, 5, 6, 7, 8, 9, 120000), datetime.datetime(1, 1, 1), datetime.datetime(9999, 12, 31, 23, 59, 59, 1), None]
    for kind in ("timestamp_ntz", "timestamp"):
        df = spark.createDataFrame([(k, a) for k, a in enumerate(at)], f"k int, t {kind}")
        got = {r["k"]: r["s"] for r in df.select("k", L.time_text(F.col("t"), df.schema["t"].dataType, "T").alias("s")).collect()}
        assert got == {0: "2024-05-06T07:08:09", 1: "2024-05-06T07:08:09.120000", 2: "0001-01-01T00:00:00", 3: "9999-12-31T23:59:59.000001", 4: None}


def test_numbers_have_their_shortest_text(spark):
    values = [0.1, 1 / 3, 123456789012345.0, 1234567890123456.0, 1e16, 1e-4, 0.00012345, 1e-5, 1.7976931348623157e308, -0.5, 100.0]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", L.double_text(F.col("v")).alias("s"))
    assert all(r["s"] == repr(r["v"]) for r in df.collect())
