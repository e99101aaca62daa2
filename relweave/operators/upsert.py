"""The effect of an upsert on a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_apply(target: DataFrame, source: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Rows of the target, replaced by source rows of the same key, plus new source rows.

    Whole rows are replaced: a NULL in the source overwrites.  The key is unique on both
    sides, as the statement demands.
    """
    if not pk:
        return target.unionByName(source)
    rest = [c for c in target.columns if c not in pk]
    old = target.select(*pk, F.struct(*rest).alias("_old")) if rest else target.select(*pk)
    new = source.select(*pk, F.struct(*rest).alias("_new")) if rest else source.select(*pk)
    joined = old.join(new, list(pk), "full_outer")
    if not rest:
        return joined.select(*target.columns)
    row = F.coalesce("_new", "_old")
    return joined.select(*pk, *[row[c].alias(c) for c in rest]).select(*target.columns)
