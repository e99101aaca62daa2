"""Keyed hashing (HMAC-SHA256) as a native expression."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64
DIGEST_LENGTH = 12  # of catalog names; two of some 10^7 names would share so short a hash


def _pads(salt: bytes) -> tuple[bytes, bytes]:
    key = hashlib.sha256(salt).digest() if len(salt) > BLOCK else salt
    key = key.ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256(value: Column, salt: bytes) -> Column:
    """Hex HMAC of a text column; the key pads are literals."""
    inner_pad, outer_pad = _pads(salt)
    inner = F.sha2(F.concat(F.lit(inner_pad), value.cast("string").cast("binary")), 256)
    return F.sha2(F.concat(F.lit(outer_pad), F.unhex(inner)), 256)


def hashed_name(value: Column, prefix: str, salt: bytes, digits: int = DIGEST_LENGTH) -> Column:
    """``prefix`` and the first ``digits`` digits; NULL stays NULL."""
    digits = F.substring(hmac_sha256(value, salt), 1, digits)
    return F.when(value.isNotNull(), F.concat(F.lit(prefix), digits))
