"""Inclusion dependencies by value and minimal unique column sets on small tables."""

from __future__ import annotations

import random
from decimal import Decimal
from itertools import combinations

import pytest

from relweave.operators.catalog import fk_candidates
from relweave.operators.discovery import composite_foreign_keys, inclusion_dependencies, unique_column_sets


@pytest.fixture(scope="module")
def shop(spark):
    users = spark.createDataFrame([(i, f"u{i}", None if i % 4 else i // 2) for i in range(20)], "id int, name string, boss bigint")
    orders = spark.createDataFrame([(100 + i, Decimal(i % 7), "u3" if i % 2 else None, 0.0) for i in range(40)], "no bigint, buyer decimal(12,2), rep string, fee double")
    nothing = spark.createDataFrame([], "a int, b string")
    return {"users": users, "orders": orders, "nothing": nothing}


def test_keys_of_other_names_and_types_are_found(shop):
    found = {(r["child"], r["column"], r["parent"], r["ref_column"]): r["child_rows"] for r in fk_candidates(shop).collect()}
    assert found == {
        ("users", "boss", "users", "id"): 5, ("orders", "buyer", "users", "id"): 40, ("orders", "rep", "users", "name"): 20,
        ("users", "boss", "users", "id"): 5,
    }


def test_inclusions_against_brute_force(spark):
    pick = random.Random(3)
    columns = {f"c{i}": [pick.choice([None, *range(pick.choice((2, 3, 9)))]) for _ in range(12)] for i in range(70)}
    names = list(columns)
    parts = {}
    for k in range(0, 70, 10):  # more columns than one word of bits holds
        some = names[k: k + 10]
        parts[f"t{k}"] = spark.createDataFrame(list(zip(*[columns[c] for c in some])), ", ".join(f"{c} int" for c in some))
    values = {c: {v for v in x if v is not None} for c, x in columns.items()}
    want = {(a, b) for a in names for b in names if a != b and values[a] and values[a] <= values[b]}
    rows = inclusion_dependencies(parts).collect()
    assert {(r["column"], r["ref_column"]) for r in rows} == want and len(rows) == len(want)
    for r in rows[:200]:
        own = [v for v in columns[r["column"]] if v is not None]
        ref = [v for v in columns[r["ref_column"]] if v is not None]
        assert (r["child_rows"], r["child_values"], r["parent_unique"]) == (len(own), len(set(own)), len(ref) == len(set(ref)))
        assert abs(r["coverage"] - len(set(own)) / len(set(ref))) < 1e-12


def brute_sets(rows, names, width):
    found = []
    for w in range(1, width + 1):
        for some in combinations(range(len(names)), w):
            if not any(set(f) <= set(some) for f in found) and rows and len({tuple(r[k] for k in some) for r in rows}) == len(rows):
                found.append(some)
    return {tuple(names[k] for k in f) for f in found}


@pytest.mark.parametrize("sample_rows", [10, 1_000_000])
def test_unique_sets_against_brute_force(spark, sample_rows):
    pick, names = random.Random(9), ["a", "b", "c", "d"]
    tables, rows = {}, {}
    for k in range(5):
        rows[f"t{k}"] = list({tuple(pick.choice([None, *range(3 + k)]) for _ in names) for _ in range(14 + 6 * k)})
        tables[f"t{k}"] = spark.createDataFrame(rows[f"t{k}"], "a int, b int, c int, d int").repartition(3)
    got = {}
    for r in unique_column_sets(tables, max_width=3, sample_rows=sample_rows).collect():
        got.setdefault(r["table"], set()).add(tuple(r["columns"]))
        own = [names.index(c) for c in r["columns"]]
        assert r["nullable"] == any(x[i] is None for x in rows[r["table"]] for i in own) and r["rows"] == len(rows[r["table"]])
    assert {t: got.get(t, set()) for t in tables} == {t: brute_sets(rows[t], names, 3) for t in tables}


def test_unique_sets_of_odd_tables(spark):
    tables = {
        "empty": spark.createDataFrame([], "a int, b int"),
        "equal": spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "a int, b string"),
        "zeros": spark.createDataFrame([(0.0, 1), (-0.0, 1), (0.0, 2)], "a double, b int"),
        "nested": spark.createDataFrame([([1], {"k": 1}), ([2], {"k": 1})], "a array<int>, b map<string, int>"),
        "nulls": spark.createDataFrame([(None, "a"), ("a", None), (None, None)], "a string, b string"),
    }
    got = {(r["table"], tuple(r["columns"]), r["pk_candidate"]) for r in unique_column_sets(tables).collect()}
    assert got == {("nested", ("a",), True), ("nulls", ("a", "b"), False)}


@pytest.mark.parametrize("sample_rows", [5, 1_000_000])
def test_composite_keys_of_other_names(spark, sample_rows):
    parent = spark.createDataFrame([(g, n) for g in range(6) for n in range(g + 2)], "grp int, num bigint")
    child = spark.createDataFrame([(i, i % 6, Decimal(i % 2), None if i % 5 else 1) for i in range(30)], "id int, team bigint, place decimal(5,1), extra int")
    tables = {"parent": parent, "child": child}
    keys = unique_column_sets({"parent": parent})
    found = {(r["child"], tuple(r["columns"]), r["parent"], tuple(r["ref_columns"]), r["child_rows"]) for r in composite_foreign_keys(tables, keys, sample_rows=sample_rows).collect()}
    assert ("child", ("team", "place"), "parent", ("grp", "num"), 30) in found and ("child", ("team", "extra"), "parent", ("grp", "num"), 6) in found
    assert all("id" not in f[1] for f in found) and ("child", ("place", "team"), "parent", ("grp", "num"), 30) not in found


def test_tuples_are_compared_by_value_not_by_joined_text(spark):
    parent = spark.createDataFrame([("a,b", "c"), ("a", "x"), ("q", "b,c")], "p string, q string")
    child = spark.createDataFrame([("a", "b,c")], "x string, y string")
    keys = spark.createDataFrame([("parent", ["p", "q"])], "table string, columns array<string>")
    assert composite_foreign_keys({"parent": parent, "child": child}, keys).count() == 0
