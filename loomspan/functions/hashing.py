"""Stable hashes as Column expressions, equal on every machine and run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\x00"


def joined(*parts: Column | str) -> Column:
    """Parts with NUL between them; null parts count as empty."""
    cols = [F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.concat_ws(NUL, *cols)


def terminated(*parts: Column | str) -> Column:
    """Parts with NUL after each."""
    return F.concat(joined(*parts), F.lit(NUL))


def hash64(text: Column) -> Column:
    """First 8 bytes of SHA-256, big-endian and unsigned, as decimal(20,0)."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def unit_interval(text: Column) -> Column:
    """hash64 as a double in [0, 1)."""
    return hash64(text).cast("double") / F.lit(float(2**64))


def shard_of(text: Column, shards: int) -> Column:
    return F.pmod(hash64(text), F.lit(shards).cast("decimal(20,0)")).cast("int")
