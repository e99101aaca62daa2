"""SQL text for values and for reading many columns of a row as rows.

Wide checks build hundreds of expressions; as SQL text they reach the JVM in one call.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG_TEXT = 64


def name_sql(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def text_sql(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def array_sql(values: Sequence) -> str:
    """A literal array of texts, numbers or booleans."""
    cells = [
        str(v).lower() if isinstance(v, bool) else text_sql(v) if isinstance(v, str) else repr(v)
        for v in values
    ]
    return "array(" + ", ".join(cells) + ")"


def value_text(column: str, dtype: T.DataType) -> str:
    """Text equal exactly where the values are; long texts by the digest of the whole text."""
    return sql_value_text(name_sql(column), dtype)


def sql_value_text(value: str, dtype: T.DataType) -> str:
    """The same for any SQL expression of type ``dtype``."""
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        text = f"to_json({value})"
    elif isinstance(dtype, T.BinaryType):
        text = f"hex({value})"
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        return f"string({value} + 0.0D)"
    else:
        text = f"string({value})"
        if not isinstance(dtype, T.StringType):
            return text
    return f"if(length({text}) > {LONG_TEXT}, concat('#', sha2({text}, 256)), {text})"


def stack_rows(rows: Sequence[Sequence[str]], names: Sequence[str]) -> Column:
    """One output row per entry of ``rows``, all from one pass over the input."""
    cells = ", ".join(cell for row in rows for cell in row)
    return F.expr(f"stack({len(rows)}, {cells})").alias(*names)
