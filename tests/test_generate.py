"""Generated databases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from relweave import schema as S
from relweave.functions import words
from relweave.operators import integrity as I
from relweave.operators.coherence import derive_columns, detect_geo_columns
from relweave.plans.generate import generate_database
from relweave.plans.spec import ColumnSpec, TableSpec
from relweave.suite.plans import shop


@pytest.fixture(scope="module")
def made(spark):
    rows = {"users": 60, "categories": 12, "products": 40, "tags": 9, "product_tags": 300, "order_lines": 150}
    return generate_database(spark, shop(), rows, seed=5)


def test_order_and_counts(made):
    assert made.order.index("categories") < made.order.index("products") < made.order.index("order_lines")
    assert made.total_rows == 571
    assert {n: df.count() for n, df in made.tables.items()} == made.rows


def test_every_check_passes(made):
    failed = [r for r in I.validate_integrity(made.tables, shop()).collect() if not r["passed"]]
    assert failed == []


def test_values_follow_their_checks(made):
    users, products = made.tables["users"], made.tables["products"]
    assert users.where("age BETWEEN 21 AND 65").count() == 60
    assert products.where("price BETWEEN 5 AND 900 AND status IN ('draft', 'active')").count() == 40
    assert users.where("length(email) > 60 OR favourite_id IS NULL").count() == 0


def test_places_are_coherent(made):
    found = {tuple(r) for r in made.tables["users"].select("city", "state", "zip_code").collect()}
    assert found <= set(words.PLACES)


def test_column_types_are_those_declared(made):
    for table in shop().tables:
        assert [f.dataType for f in made.tables[table.name].schema] == [c.spark_type for c in table.columns]


def test_seed_decides(spark):
    db = S.Database((S.Table("t", (S.Column("email", "varchar"),)),))
    pick = lambda seed: [r[0] for r in generate_database(spark, db, 20, seed=seed).tables["t"].orderBy("email").collect()]
    assert pick(1) == pick(1) != pick(2)


def test_excluded_parent_leaves_null(spark):
    parent = S.Table("p", (S.Column("id", "bigint", primary_key=True, autoincrement=True),), ("id",))
    child = S.Table("c", (S.Column("p_id", "bigint"),), foreign_keys=(S.ForeignKey(("p_id",), "p", ("id",)),))
    made = generate_database(spark, S.Database((parent, child)), 5, exclude=["p"])
    assert made.order == ["c"] and made.tables["c"].where("p_id IS NULL").count() == 5


def test_cycle_is_closed_in_a_second_pass(spark):
    def side(name, other):
        return S.Table(name, (S.Column("id", "bigint", nullable=False, primary_key=True, autoincrement=True), S.Column("ref", "bigint")),
                       ("id",), (S.ForeignKey(("ref",), other, ("id",)),))

    db = S.Database((side("a", "b"), side("b", "a")))
    order, deferred = S.table_order(db)
    assert order == ["a", "b"] and [t for t, _ in deferred] == ["a"]
    made = generate_database(spark, db, 8)
    assert all(df.where("ref BETWEEN 1 AND 8").count() == 8 for df in made.tables.values())


def test_unbreakable_cycle(spark):
    def side(name, other):
        return S.Table(name, (S.Column("id", "bigint"), S.Column("ref", "bigint", nullable=False)), foreign_keys=(S.ForeignKey(("ref",), other, ("id",)),))

    with pytest.raises(ValueError):
        S.table_order(S.Database((side("a", "b"), side("b", "a"))))


def test_specs_replace_rules(spark):
    table = S.Table("t", (S.Column("v", "float"), S.Column("k", "varchar")))
    spec = TableSpec("t", {"v": ColumnSpec("numpy.normal", distribution="normal", min_value=0, max_value=10),
                           "k": ColumnSpec("builtin.role", nullable_rate=0.5)})
    df = generate_database(spark, S.Database((table,)), 400, specs={"t": spec}).tables["t"]
    low, high, mean = df.agg(F.min("v"), F.max("v"), F.avg("v")).first()
    assert 0 <= low and high <= 10 and 4.5 < mean < 5.5
    assert 140 < df.where("k IS NULL").count() < 260


def test_unknown_provider_raises(spark):
    table = S.Table("t", (S.Column("v", "varchar"),))
    with pytest.raises(ValueError):
        generate_database(spark, S.Database((table,)), 3, specs={"t": TableSpec("t", {"v": ColumnSpec("no.such")})})


def test_geo_columns_need_two():
    assert detect_geo_columns(["City", "id"]) == {}
    assert detect_geo_columns(["City", "zipcode"]) == {"city": "City", "zip": "zipcode"}


def test_circular_derivation(spark):
    with pytest.raises(ValueError):
        derive_columns(spark.range(1), [("a", "b", ["b"]), ("b", "a", ["a"])])


def test_self_reference_to_a_text_key(spark):
    table = S.Table(
        "staff",
        (S.Column("email", "varchar", nullable=False, primary_key=True, max_length=50), S.Column("boss", "varchar")),
        ("email",), (S.ForeignKey(("boss",), "staff", ("email",)),),
    )
    db = S.Database((table,))
    made = generate_database(spark, db, 50)
    assert all(r["passed"] for r in I.validate_integrity(made.tables, db).collect())
    assert made.tables["staff"].where("boss IS NULL").count() == 10


def test_joins_move_keys_only(spark):
    """The join for a key that is not dense carries no generated column."""
    parent = S.Table("p", (S.Column("code", "varchar", nullable=False, primary_key=True),), ("code",))
    child = S.Table("c", (S.Column("code", "varchar"), S.Column("email", "varchar"), S.Column("bio", "text")),
                    foreign_keys=(S.ForeignKey(("code",), "p", ("code",)),))
    df = generate_database(spark, S.Database((parent, child)), 20).tables["c"]
    text = df._jdf.queryExecution().optimizedPlan().toString()
    below = text[text.index("Join"):]
    assert "42:c:email" not in below and "42:c:bio" not in below and "42:c:email" in text


def test_composite_key_with_a_drawn_part(spark):
    table = S.Table("t", (S.Column("a", "boolean", nullable=False), S.Column("b", "float", nullable=False), S.Column("c", "enum", enum_values=("x", "y"))),
                    ("a", "b"), indexes=(S.Index(("b", "c"), True),))
    made = generate_database(spark, S.Database((table,)), 300)
    assert made.tables["t"].select("a", "b").distinct().count() == 300
    assert made.tables["t"].select("b", "c").distinct().count() == 300
