"""Files, JDBC and reference data."""

from __future__ import annotations

import datetime as dt
import decimal
import json
import re

import pytest
from pyspark.sql import functions as F

from relweave import schema as S
from relweave.functions import literals as L
from relweave.sinks import files, jdbc
from relweave.sinks.statements import render_statements
from relweave.sources.audit import audit_summary, read_audit_log
from relweave.sources.reference import read_reference_csv, read_reference_set

USERS = S.Table("users", (S.Column("id", "integer", nullable=False, primary_key=True, autoincrement=True),
                          S.Column("name", "varchar", nullable=False), S.Column("score", "float")), ("id",))
DB = S.Database((USERS,))


@pytest.fixture
def users(spark):
    return spark.createDataFrame(
        [(1, 'O\'Hara, "Al"', 1.5), (2, "two\nlines", float("nan")), (3, " padded ", None), (4, "", 1e7 + 0.5)],
        "id int, name string, score double",
    )


def lines(path) -> list[str]:
    return [line for part in sorted(path.glob("part-*")) for line in part.read_text().split("\n")]


def test_csv(spark, users, tmp_path):
    (path,) = files.write_csv({"users": users.coalesce(1)}, ["nothing", "users"], str(tmp_path))
    assert path.endswith("/002_users.csv")
    text = "\n".join(lines(tmp_path / "002_users.csv"))
    assert text.startswith('id,name,score\n1,"O\'Hara, ""Al""",1.5\n')
    assert "10000000.5" in text and "NaN" not in text
    back = read_reference_csv(spark, path, USERS).orderBy("id").collect()
    assert [r["name"] for r in back] == ['O\'Hara, "Al"', "two\nlines", " padded ", ""]
    assert [r["score"] for r in back] == [1.5, None, None, 1e7 + 0.5]


def test_empty_tables(spark, users, tmp_path):
    empty = users.where("id < 0")
    assert files.write_csv({"users": empty}, ["users"], str(tmp_path / "a")) == []
    (path,) = files.write_parquet({"users": empty}, ["users"], str(tmp_path / "b"), DB)
    assert spark.read.parquet(path).columns == ["id", "name", "score"]


def test_table_names_cannot_leave_the_folder(users, tmp_path):
    (path,) = files.write_jsonl({"../evil": users}, ["../evil"], str(tmp_path))
    assert path == f"{tmp_path}/001____evil.jsonl"


def test_jsonl_and_json(spark, users, tmp_path):
    (path,) = files.write_jsonl({"users": users}, ["users"], str(tmp_path))
    rows = [json.loads(line) for line in lines(tmp_path / "001_users.jsonl") if line]
    assert {r["id"]: r["score"] for r in rows} == {1: 1.5, 2: None, 3: None, 4: 1e7 + 0.5}
    assert list(rows[0]) == ["id", "name", "score"]
    docs = [json.loads(r["document"]) for r in files.json_documents(users, 3).collect()]
    assert sorted(map(len, docs)) == [1, 3]


def test_sql_files_are_scripts(spark, tmp_path):
    df = spark.range(25).select(F.col("id").cast("int").alias("id"), F.lit("x").alias("name"), F.lit(None).cast("double").alias("score"))
    files.write_sql({"users": df}, ["users"], str(tmp_path), "mysql", DB, upsert=True, batch_rows=10)
    text = "\n".join(lines(tmp_path / "001_users.sql"))
    assert re.search(r"^-- Table: users \(25 rows\)\n\nBEGIN;", text)
    assert text.rstrip().endswith("COMMIT;")
    assert text.count("ON DUPLICATE KEY UPDATE `name` = VALUES(`name`), `score` = VALUES(`score`);") == 3


def test_literals_of_every_type(spark):
    df = spark.createDataFrame(
        [(True, 1.5, decimal.Decimal("2.50"), dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5, 60), b"\x01\xff", "it's \\", [1, 2], None)],
        "b boolean, d double, m decimal(5,2), day date, ts timestamp_ntz, raw binary, s string, arr array<int>, nothing int",
    )

    def shown(dialect):
        row = df.select(*[L.sql_literal(F.col(c), df.schema[c].dataType, L.DIALECTS[dialect]).alias(c) for c in df.columns]).first()
        return list(row)

    assert shown("postgresql") == ["TRUE", "1.5", "2.50", "'2024-01-02'", "'2024-01-02 03:04:05.000060'", "'\\x01ff'::bytea", "'it''s \\'", "'[1,2]'", "NULL"]
    assert shown("mysql")[0] == "1" and shown("mysql")[5:7] == ["X'01ff'", "'it\\'s \\\\'"]
    assert shown("mssql")[5] == "0x01ff"
    bulk = df.select(L.bulk_line(df, L.COPY_TEXT)).first()[0]
    assert bulk == "t\t1.5\t2.50\t2024-01-02\t2024-01-02 03:04:05.000060\t\\\\x01ff\tit's \\\\\t[1,2]\t\\N"


def test_identifiers_are_escaped(spark):
    df = spark.createDataFrame([(1,)], 'id int').withColumnRenamed("id", 'we"ird')
    text = render_statements(df, "t", "postgresql").first()["statement"]
    assert '("we""ird")' in text
    with pytest.raises(ValueError):
        render_statements(df, "t", "oracle")


def test_jdbc_in_process(spark, users):
    url = "jdbc:derby:memory:relweave;create=true"
    orders = spark.createDataFrame([(10, 1), (11, 2)], "id int, user_id int")
    clean = users.where("id <> 4")
    result = jdbc.write_jdbc({"users": clean, "orders": orders}, ["users", "orders"], url, mode="overwrite").first()
    assert (result["tables_inserted"], result["total_rows"]) == (2, 5)
    back = spark.read.format("jdbc").options(url=url, dbtable="users").load().orderBy("id").collect()
    assert [(r[0], r[2]) for r in back] == [(1, 1.5), (2, None), (3, None)]
    assert jdbc.batch_size("jdbc:sqlserver://x", 7) == 300
    with pytest.raises(ValueError):
        jdbc.write_jdbc({"bad name": users}, ["bad name"], url)
    assert jdbc.sequence_values({"users": users}, DB).first()["value"] == 4


def test_reference_set(spark, users, tmp_path):
    users.coalesce(1).write.parquet(str(tmp_path / "users.parquet"))
    assert set(read_reference_set(spark, str(tmp_path), DB)) == {"users"}
    assert set(read_reference_set(spark, str(tmp_path / "users.parquet"), DB)) == {"users"}
    with pytest.raises(FileNotFoundError):
        read_reference_set(spark, str(tmp_path / "elsewhere"), DB)


def test_audit_log(spark, tmp_path):
    good = {"timestamp": "2024-01-0{}", "provider": "p", "model": "m", "tokens_sent": 3}
    text = [json.dumps({**good, "timestamp": f"2024-01-0{k}"}) for k in range(1, 6)]
    text += ["{broken", "[]", json.dumps({**good, "extra": 1}), json.dumps({"provider": "p"}), json.dumps({**good, "tokens_sent": "x"})]
    (tmp_path / "audit.log").write_text("\n".join(text) + "\n")
    path = str(tmp_path / "audit.log")
    assert read_audit_log(spark, path).count() == 5
    assert [r["timestamp"] for r in read_audit_log(spark, path, 2).collect()] == ["2024-01-04", "2024-01-05"]
    total = audit_summary(read_audit_log(spark, path)).first()
    assert (total["calls"], total["tokens_sent"]) == (5, 15)
