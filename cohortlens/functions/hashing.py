"""Seeded, engine-independent randomness from md5.

``md5(concat(key, ':', seed))`` gives the same hex digest in Spark and in any
SQL engine, so samples, splits and quota assignments can be re-derived and
checked by plain SQL. Nothing depends on task layout or retries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hex digits = 52 bits: exact in a double.
_HEX_DIGITS = 13
_SCALE = float(16 ** _HEX_DIGITS)


def hash_key(key: Column | str, seed: int | str) -> Column:
    """md5 hex digest of ``key:seed``."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(k.cast("string"), F.lit(f":{seed}")))


def hash_order(key: Column | str, seed: int | str) -> Column:
    """A sort key (the hex digest): orders rows in a seeded random order."""
    return hash_key(key, seed)


def hash_uniform(key: Column | str, seed: int | str) -> Column:
    """Uniform in (0, 1) from the first 52 bits of the digest."""
    digits = F.substring(hash_key(key, seed), 1, _HEX_DIGITS)
    as_int = F.conv(digits, 16, 10).cast("double")
    return (as_int + F.lit(0.5)) / F.lit(_SCALE)
