"""Sinks (K1-K8).  Writers refuse to overwrite by default (K8: stop if the output exists)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_articles(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """K1 / K2 / K7: JSON lines, optionally one folder per dump/split; refuses an existing output (K8)."""
    w = df.write.mode(mode).option("compression", "none")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def write_sequences(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K3: sequences sharded by split and fold after one exchange on those two columns, which adaptive execution
    splits where a (split, fold) is large: a task sorts and writes about one advisory partition size."""
    (df.hint("rebalance", "split", "fold").write.mode(mode).partitionBy("split", "fold").parquet(path))


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", downcast: dict[str, str] | None = None) -> None:
    """K4 / K5 / K6: parquet, optional narrowing casts (e.g. scores to float); K8 by default."""
    if downcast:
        df = df.withColumns({c: F.col(c).cast(t) for c, t in downcast.items()})
    df.write.mode(mode).parquet(path)
