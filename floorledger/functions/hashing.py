"""Stable text hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 32-bit FNV-1a offset and prime.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619


def fnv1a_value(c: Column) -> Column:
    """The 32-bit FNV-1a of a text's characters, as a bigint, folded in one expression."""
    mask, prime = F.lit(0xFFFFFFFF).cast("bigint"), F.lit(FNV_PRIME).cast("bigint")
    chars = F.filter(F.split(c, ""), lambda ch: ch != "")
    return F.aggregate(chars, F.lit(FNV_OFFSET).cast("bigint"), lambda h, ch: (h.bitwiseXOR(F.ascii(ch).cast("bigint")) * prime).bitwiseAND(mask))


def fnv1a(c: Column) -> Column:
    """The stored form "<length>:<hex>"."""
    return F.concat(F.length(c).cast("string"), F.lit(":"), F.lower(F.hex(fnv1a_value(c))))


def fingerprint(c: Column) -> Column:
    """A document's fingerprint for change detection only: its length and a 64-bit hash."""
    return F.concat_ws(":", F.length(c).cast("string"), F.hex(F.xxhash64(c)))


def lit_window(key: Column) -> Column:
    """A fixed 45 % of keys, the same ones every time."""
    return fnv1a_value(key) % 100 < 45
