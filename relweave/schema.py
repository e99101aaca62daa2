"""Schema objects held on the driver, their Spark types, and the catalog table.

The objects describe constraints Spark does not carry itself.  Anything that has
to look at many schemas at once works on the catalog DataFrame instead, which has
one row per column (see :func:`catalog_frame`).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

INTEGERS = ("integer", "bigint", "smallint")
NUMERIC = (*INTEGERS, "float", "decimal")
CATEGORICAL = ("varchar", "text", "enum", "boolean")
TEMPORAL = ("date", "datetime", "timestamp", "time")

_SPARK_TYPES = {
    "integer": T.IntegerType(),
    "bigint": T.LongType(),
    "smallint": T.ShortType(),
    "float": T.DoubleType(),
    "boolean": T.BooleanType(),
    "varchar": T.StringType(),
    "text": T.StringType(),
    "date": T.DateType(),
    "datetime": T.TimestampNTZType(),
    "timestamp": T.TimestampType(),
    "time": T.StringType(),  # HH:mm:ss
    "uuid": T.StringType(),
    "json": T.StringType(),
    "binary": T.BinaryType(),
    "enum": T.StringType(),
    "array": T.ArrayType(T.IntegerType()),
    "unknown": T.StringType(),
}
COLUMN_TYPES = (*_SPARK_TYPES, "decimal")


@dataclass(frozen=True)
class Column:
    name: str
    data_type: str
    nullable: bool = True
    primary_key: bool = False
    unique: bool = False
    autoincrement: bool = False
    default: str | None = None
    max_length: int | None = None
    precision: int | None = None
    scale: int | None = None
    enum_values: tuple[str, ...] | None = None
    check: str | None = None
    comment: str | None = None

    def __post_init__(self) -> None:
        if self.data_type not in COLUMN_TYPES:
            raise ValueError(f"unknown column type {self.data_type!r}")

    @property
    def spark_type(self) -> T.DataType:
        if self.data_type == "decimal":
            return T.DecimalType(
                10 if self.precision is None else self.precision,
                2 if self.scale is None else self.scale,
            )
        return _SPARK_TYPES[self.data_type]


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    ref_table: str
    ref_columns: tuple[str, ...]
    name: str | None = None
    on_delete: str | None = None
    on_update: str | None = None
    deferrable: bool = False
    initially: str | None = None


@dataclass(frozen=True)
class Index:
    columns: tuple[str, ...]
    unique: bool = False
    name: str | None = None


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    indexes: tuple[Index, ...] = ()
    comment: str | None = None

    def column(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)

    @property
    def fk_columns(self) -> frozenset[str]:
        return frozenset(c for fk in self.foreign_keys for c in fk.columns)

    @property
    def auto_columns(self) -> tuple[str, ...]:
        return tuple(c.name for c in self.columns if c.primary_key and c.autoincrement)

    @property
    def is_junction(self) -> bool:
        """All primary-key columns are foreign-key columns of two or more parents."""
        return (
            bool(self.primary_key)
            and len(self.foreign_keys) >= 2
            and set(self.primary_key) <= self.fk_columns
        )

    @property
    def unique_sets(self) -> list[tuple[str, ...]]:
        """Column sets declared unique besides the primary key, in declaration order."""
        return [(c.name,) for c in self.columns if c.unique] + [
            tuple(ix.columns) for ix in self.indexes if ix.unique and len(ix.columns) > 1
        ]

    @property
    def spark_schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark_type) for c in self.columns])


@dataclass(frozen=True)
class Database:
    tables: tuple[Table, ...]
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    name: str = "db"

    def table(self, name: str) -> Table:
        return next(t for t in self.tables if t.name == name)


def table_order(db: Database) -> tuple[list[str], list[tuple[str, ForeignKey]]]:
    """Parents before children, plus the foreign keys left for a second pass.

    A cycle is opened at the first table (by name) whose blocking foreign keys are
    all nullable; those keys are returned as deferred.
    """
    names = {t.name for t in db.tables}
    waiting = {
        t.name: [fk for fk in t.foreign_keys if fk.ref_table in names - {t.name}]
        for t in db.tables
    }
    order: list[str] = []
    deferred: list[tuple[str, ForeignKey]] = []
    while waiting:
        ready = sorted(n for n, fks in waiting.items() if all(f.ref_table in order for f in fks))
        if not ready:
            for name in sorted(waiting):
                blocking = [fk for fk in waiting[name] if fk.ref_table not in order]
                table = db.table(name)
                if all(table.column(c).nullable for fk in blocking for c in fk.columns):
                    deferred += [(name, fk) for fk in blocking]
                    ready = [name]
                    break
            else:
                raise ValueError(f"no nullable foreign key opens the cycle among {sorted(waiting)}")
        order += ready
        for name in ready:
            del waiting[name]
    return order, deferred


CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("db", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("column", T.StringType()),
        T.StructField("data_type", T.StringType()),
        T.StructField("nullable", T.BooleanType()),
        T.StructField("is_pk", T.BooleanType()),
        T.StructField("is_unique", T.BooleanType()),
        T.StructField("autoincrement", T.BooleanType()),
        T.StructField("default", T.StringType()),
        T.StructField("max_length", T.IntegerType()),
        T.StructField("precision", T.IntegerType()),
        T.StructField("scale", T.IntegerType()),
        T.StructField("enum_values", T.ArrayType(T.StringType())),
        T.StructField("check_expr", T.StringType()),
        T.StructField("comment", T.StringType()),
    ]
)


def catalog_frame(spark: SparkSession, *databases: Database) -> DataFrame:
    """The catalog table of some schemas: one row per column."""
    rows = [
        (
            db.name, t.name, i, c.name, c.data_type, c.nullable, c.primary_key, c.unique,
            c.autoincrement, c.default, c.max_length, c.precision, c.scale,
            list(c.enum_values) if c.enum_values else None, c.check, c.comment,
        )
        for db in databases
        for t in db.tables
        for i, c in enumerate(t.columns)
    ]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def data_type_of(spark_type: T.DataType) -> str:
    """The normalized type name of a Spark type."""
    if isinstance(spark_type, T.DecimalType):
        return "decimal"
    if isinstance(spark_type, (T.StructType, T.MapType)):
        return "json"
    return {
        T.IntegerType: "integer", T.LongType: "bigint", T.ShortType: "smallint",
        T.ByteType: "smallint", T.FloatType: "float", T.DoubleType: "float",
        T.BooleanType: "boolean", T.StringType: "text", T.DateType: "date",
        T.TimestampNTZType: "datetime", T.TimestampType: "timestamp",
        T.BinaryType: "binary", T.ArrayType: "array",
    }.get(type(spark_type), "unknown")
