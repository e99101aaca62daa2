"""Values as text: SQL literals, CSV fields, JSON values, COPY and LOAD DATA fields."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
NESTED = (T.ArrayType, T.StructType, T.MapType)
TIMESTAMPS = (T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class Dialect:
    """Fixed values of one SQL dialect."""

    open_quote: str
    close_quote: str
    true: str
    false: str
    backslash: bool
    upsert: str
    excluded: str
    binary_prefix: str
    binary_suffix: str
    begin: str
    commit: str


DIALECTS = {
    "postgresql": Dialect('"', '"', "TRUE", "FALSE", False, "on_conflict", "EXCLUDED", "'\\x", "'::bytea", "BEGIN;", "COMMIT;"),
    "mysql": Dialect("`", "`", "1", "0", True, "on_duplicate_key", "", "X'", "'", "BEGIN;", "COMMIT;"),
    "sqlite": Dialect('"', '"', "1", "0", False, "on_conflict", "excluded", "X'", "'", "BEGIN;", "COMMIT;"),
    "mssql": Dialect("[", "]", "1", "0", False, "merge", "src", "0x", "", "BEGIN TRANSACTION;", "COMMIT TRANSACTION;"),
}


def dialect_named(name: str) -> Dialect:
    if name not in DIALECTS:
        raise ValueError(f"unknown dialect {name!r}; known are {', '.join(DIALECTS)}")
    return DIALECTS[name]


def quote_identifier(name: str, dialect: Dialect) -> str:
    return dialect.open_quote + name.replace(dialect.close_quote, dialect.close_quote * 2) + dialect.close_quote


# --- shared pieces ------------------------------------------------------------
def finite(value: Column, dtype: T.DataType) -> Column:
    """NaN and infinities become NULL, -0.0 becomes 0.0."""
    if not isinstance(dtype, FLOATING):
        return value
    double = value.cast("double") + F.lit(0.0)
    return F.when(F.abs(double) < F.lit(float("inf")), double)


def double_text(value: Column) -> Column:
    """Shortest digits of a double; plain notation from 1e-4 up to 1e16, else ``1e+16`` style."""
    short = value.cast("string")
    # 15 digits and a point at most, without an exponent: shortest and plain already
    plain = (F.length(short) <= 16) & ~F.contains(short, F.lit("E"))
    return F.when(plain, short).otherwise(_long_double_text(value, short))


def _long_double_text(value: Column, short: Column) -> Column:
    # some JVMs print 16 or 17 digits where fewer identify the number
    digits = F.length(F.regexp_replace(short, r"[-.]|E.*", ""))
    rounded = [F.upper(F.format_string(f"%.{n}e", value)) for n in (14, 15)]
    fits = [r.try_cast("double") == value for r in rounded]
    short = (
        F.when(digits < 16, short).when(fits[0], rounded[0]).when(fits[1], rounded[1]).otherwise(short)
    )
    size = F.abs(value)
    plain = F.regexp_replace(short.try_cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    mantissa = F.regexp_replace(F.substring_index(short, "E", 1), r"\.?0*$", "")
    power = F.substring_index(short, "E", -1).try_cast("int")
    shown = F.abs(power).cast("string")
    shown = F.when(F.length(shown) < 2, F.lpad(shown, 2, "0")).otherwise(shown)
    sign = F.when(power < 0, "-").otherwise("+")
    return (
        F.when(~F.contains(short, F.lit("E")), short)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(F.concat(mantissa, F.lit("e"), sign, shown))
    )


def number_text(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.FloatType):
        return double_text(finite(value.cast("string").cast("double"), T.DoubleType()))
    if isinstance(dtype, T.DoubleType):
        return double_text(finite(value, dtype))
    return value.cast("string")


def time_text(value: Column, dtype: T.DataType, separator: str = " ") -> Column:
    """ISO text; a fraction of six digits only where there is one."""
    if isinstance(dtype, T.DateType):
        return value.cast("string")
    pattern = f"yyyy-MM-dd'{separator}'HH:mm:ss.SSSSSS"
    text = value.cast("string")  # a fraction without its last zeros
    if separator != " ":
        text = F.replace(text, F.lit(" "), F.lit(separator))
    whole = F.length(text) == 19
    broken = F.length(text).between(21, 26) & (F.substring(text, 20, 1) == ".")
    full = F.regexp_replace(F.date_format(value, pattern), r"\.000000$", "")  # years beyond four digits
    return F.when(whole, text).when(broken, F.rpad(text, 26, "0")).otherwise(full)


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, (*INTEGRAL, *FLOATING, T.DecimalType))


def hex_text(value: Column) -> Column:
    return F.lower(F.hex(value))


# --- SQL ----------------------------------------------------------------------
def sql_literal(value: Column, dtype: T.DataType, dialect: Dialect) -> Column:
    """A SQL literal; NULL, NaN and infinities give ``NULL``."""
    if isinstance(dtype, T.BooleanType):
        text = F.when(value, dialect.true).otherwise(dialect.false)
        return F.when(value.isNull(), "NULL").otherwise(text)
    if is_number(dtype):
        text = number_text(value, dtype)
    elif isinstance(dtype, T.BinaryType):
        text = F.concat(F.lit(dialect.binary_prefix), hex_text(value), F.lit(dialect.binary_suffix))
    else:
        if isinstance(dtype, (T.DateType, *TIMESTAMPS)):
            text = time_text(value, dtype)
        elif isinstance(dtype, NESTED):
            text = F.to_json(value)
        else:
            text = value.cast("string")
        if dialect.backslash:
            text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
        else:
            text = F.replace(text, F.lit("'"), F.lit("''"))
        text = F.concat(F.lit("'"), text, F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))


def sql_tuple(df: DataFrame, columns: Sequence[str], dialect: Dialect) -> Column:
    cells = [sql_literal(F.col(c), df.schema[c].dataType, dialect) for c in columns]
    return F.concat(F.lit("("), F.concat_ws(", ", *cells), F.lit(")"))


# --- CSV ----------------------------------------------------------------------
def csv_field(value: Column, dtype: T.DataType) -> Column:
    """The unquoted text of a field; nulls, NaN and infinities are empty."""
    if isinstance(dtype, T.BooleanType) or isinstance(dtype, T.StringType):
        text = value.cast("string")
    elif is_number(dtype):
        text = number_text(value, dtype)
    elif isinstance(dtype, (T.DateType, *TIMESTAMPS)):
        text = time_text(value, dtype)
    elif isinstance(dtype, T.BinaryType):
        text = hex_text(value)
    else:
        text = F.to_json(value)
    return F.coalesce(text, F.lit(""))


def csv_line(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """A record; fields with comma, quote or line break are quoted, quotes doubled."""
    fields = []
    for c in columns or df.columns:
        text = csv_field(F.col(c), df.schema[c].dataType)
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        fields.append(F.when(text.rlike('[,"\\r\\n]'), quoted).otherwise(text))
    return F.concat_ws(",", *fields)


# --- JSON ---------------------------------------------------------------------
def json_value(value: Column, dtype: T.DataType) -> Column:
    """What goes into a JSON object: ISO times, hex bytes, decimals as numbers, no NaN."""
    if isinstance(dtype, FLOATING):
        return finite(value, dtype)
    if isinstance(dtype, T.DecimalType):
        return value.cast("double")
    if isinstance(dtype, (T.DateType, *TIMESTAMPS)):
        return time_text(value, dtype, "T")
    if isinstance(dtype, T.BinaryType):
        return hex_text(value)
    return value


def json_struct(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    return F.struct(
        *[json_value(F.col(c), df.schema[c].dataType).alias(c) for c in columns or df.columns]
    )


def json_line(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    return F.to_json(json_struct(df, columns), {"ignoreNullFields": "false"})


# --- COPY and LOAD DATA -------------------------------------------------------
@dataclass(frozen=True)
class BulkFormat:
    true: str
    false: str
    binary_prefix: str


COPY_TEXT = BulkFormat("t", "f", "\\\\x")
LOAD_DATA_TEXT = BulkFormat("1", "0", "")


def bulk_field(value: Column, dtype: T.DataType, form: BulkFormat) -> Column:
    """A tab-separated field: ``\\N`` for nulls; backslash, tab and line breaks escaped."""
    if isinstance(dtype, T.BooleanType):
        text = F.when(value, form.true).when(~value, form.false)
    elif is_number(dtype):
        text = number_text(value, dtype)
    elif isinstance(dtype, (T.DateType, *TIMESTAMPS)):
        text = time_text(value, dtype)
    elif isinstance(dtype, T.BinaryType):
        text = F.concat(F.lit(form.binary_prefix), hex_text(value))
    else:
        text = F.to_json(value) if isinstance(dtype, NESTED) else value.cast("string")
        for plain, escaped in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            text = F.replace(text, F.lit(plain), F.lit(escaped))
    return F.coalesce(text, F.lit("\\N"))


def bulk_line(df: DataFrame, form: BulkFormat, columns: Sequence[str] | None = None) -> Column:
    return F.concat_ws(
        "\t", *[bulk_field(F.col(c), df.schema[c].dataType, form) for c in columns or df.columns]
    )
