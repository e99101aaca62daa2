"""Deterministic draws: pure expressions of (seed, table, column, row key).

No draw depends on partitioning, on row order or on the other columns, so a plan
can be recomputed after an executor loss, and pruning a column drops its work.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"
UNIT_SPAN = float(2**60)
LETTERS_PER_DRAW = 10  # 26^10 is far below 2^60, so each letter is close to uniform


def column_seed(seed: Column | int, table: Column | str, column: Column | str) -> Column:
    """First 8 bytes of SHA-256 of ``seed:table:column`` as an integer, mod 2^31."""
    parts = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in (seed, table, column)]
    digest = F.sha2(F.concat_ws(":", *parts), 256)
    # 2^31 divides 2^64, so only the low 4 of those 8 bytes matter
    low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("bigint")
    return (low % F.lit(2**31)).cast("bigint")


def hex_draw(seed: int, table: str, column: str, row_id: Column, part: Column | int = 0) -> Column:
    """32 hex digits for one cell; ``part`` numbers further digits of the same cell."""
    head = f"{seed}:{table}:{column}"
    if isinstance(part, Column):
        key = F.concat(F.lit(head + "#"), part.cast("string"), F.lit(":"), row_id.cast("string"))
    else:
        key = F.concat(F.lit(f"{head}#{part}:" if part else head + ":"), row_id.cast("string"))
    return F.md5(key.cast("binary"))


def draw(seed: int, table: str, column: str, row_id: Column, part: Column | int = 0) -> Column:
    """A 60-bit non-negative integer for one cell."""
    digits = F.substring(hex_draw(seed, table, column, row_id, part), 1, 15)
    return F.conv(digits, 16, 10).cast("bigint")


def unit(seed: int, table: str, column: str, row_id: Column, part: Column | int = 0) -> Column:
    """A double in [0, 1) for one cell."""
    return draw(seed, table, column, row_id, part).cast("double") / F.lit(UNIT_SPAN)


BASE26 = "0123456789ABCDEFGHIJKLMNOP"


def letters(digits: Column, count: int = LETTERS_PER_DRAW) -> Column:
    """``count`` lowercase letters: the low base-26 digits of the draw in a cell's hex digits."""
    low = F.substring(F.conv(F.substring(digits, 1, 15), 16, 26), -count, count)  # F.right would draw twice, once for a NULL test
    return F.translate(F.lpad(low, count, "0"), BASE26, LETTERS)


@dataclass(frozen=True)
class Cell:
    """What a generator may look at: the cell's address and its parameters."""

    seed: int
    table: str
    column: str
    row_id: Column
    params: dict[str, Any] = field(default_factory=dict)

    def draw(self, part: Column | int = 0) -> Column:
        return draw(self.seed, self.table, self.column, self.row_id, part)

    def unit(self, part: Column | int = 0) -> Column:
        return unit(self.seed, self.table, self.column, self.row_id, part)

    def hex(self, part: Column | int = 0) -> Column:
        return hex_draw(self.seed, self.table, self.column, self.row_id, part)

    def below(self, n: int, part: Column | int = 0) -> Column:
        """An integer in [0, n)."""
        return self.draw(part) % F.lit(n).cast("bigint")

    def between(self, lo: int, hi: int, part: Column | int = 0) -> Column:
        """An integer in [lo, hi]."""
        return F.lit(lo).cast("bigint") + self.below(hi - lo + 1, part)
