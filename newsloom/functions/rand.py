"""Reproducible, partition-independent randomness.

Every unseeded draw of the original becomes a hash-uniform number in [0, 1):

    u = int(first 8 hex digits of md5("seed|salt|key1|key2...")) / 2**32

It depends only on the row's keys, so it is identical on any number of partitions, on task
retry and after executor loss, and DuckDB computes the very same value
(``('0x' || substr(md5(...), 1, 8))::BIGINT / 4294967296.0``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed, salt, *keys) -> Column:
    parts = [F.lit(str(seed)), F.lit(str(salt))] + [
        (F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    h = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8)
    return F.conv(h, 16, 10).cast("bigint").cast("double") / F.lit(4294967296.0)


def uniform_sql(seed, salt, *keys: str) -> str:
    """The DuckDB text of :func:`uniform` for oracle queries."""
    parts = " || '|' || ".join([f"'{seed}'", f"'{salt}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"(('0x' || substr(md5({parts}), 1, 8))::BIGINT / 4294967296.0)"
