"""Hash order: the only source of randomness in tidepool.

A row's random draw is ``md5(seed | key...)`` read as a 52-bit integer.  It is
stable under repartitioning and retries (no RNG state), identical on every
engine that has ``md5`` (so SQL oracles reproduce it), and uniform, so hash
buckets are balanced even when a key value is hot.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 52
HASH_SCALE = float(2 ** HASH_BITS)


def _key(seed, cols) -> Column:
    """``seed|col1|col2...``; ``seed`` may be a literal or a Column (one seed per run)."""
    head = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    parts = [head] + [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    return F.concat_ws("|", *parts)


def hash52(seed, *cols) -> Column:
    """First 13 hex digits of md5(seed|cols) as a non-negative long (< 2**52)."""
    return F.conv(F.substring(F.md5(_key(seed, cols)), 1, 13), 16, 10).cast("long")


def hash_bucket(h52: Column, bits: int) -> Column:
    """Top ``bits`` bits of a 52-bit hash: a balanced bucket id in [0, 2**bits)."""
    return F.shiftright(h52, HASH_BITS - bits)


def sql_hash52(seed, *cols: str) -> str:
    """DuckDB/ANSI text of :func:`hash52` for oracle queries."""
    parts = ", ".join([f"'{seed}'"] + [f"CAST({c} AS VARCHAR)" for c in cols])
    return f"CAST(('0x' || substr(md5(concat_ws('|', {parts})), 1, 13)) AS BIGINT)"
