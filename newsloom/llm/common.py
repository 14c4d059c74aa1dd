"""Helpers of the llm operators: text columns as bytes, word splitting, hashes, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import checkpoint_dir, cut_lineage, drop_tables, qualified, ship_package, table_scope  # noqa: F401  (re-exported)

# bytes table: A-Z lower-cased, ASCII characters other than letters and digits become a space
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
              for c in range(256))


def alnum_words(data: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 text after lower-casing A-Z."""
    return data.translate(ALNUM).split()


def space_words(data: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text (``bytes.split`` splits at exactly these)."""
    return data.split()


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """(id long, data binary): the two columns an operator needs; null text -> empty; ``more``: columns to carry."""
    return df.select(F.col(id_col).cast("long").alias(id_col),
                     F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"), *more)


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (a null id counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pylist(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that intermediate arrays stay small."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with the package shipped to the Python workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (a bijection with good avalanche)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every window of k word hashes; fewer than k words: the whole sequence as one."""
    k = min(k, len(h))
    if not k:
        return h
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n])
    return out
