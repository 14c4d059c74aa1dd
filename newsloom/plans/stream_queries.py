"""Registered streaming queries: the corpus arrives as an ordered sequence of files; the stream's
result is read back as a table and checked against the batch answer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import fixed, text as T
from newsloom.plans import common as K
from newsloom.plans.corpus_queries import DEDUPE_RAW_SQL
from newsloom.session import checkpoint_dir
from newsloom.streaming import dedupe_stream as ST

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
N_FILES = 4


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _run(spark: SparkSession, sf: str) -> str:
    """Write documents as N ordered parts of files, stream them through ST1, return the store path."""
    root = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    docs = K.table(spark, sf, "documents").select(
        "doc_id", "source", T.content_key("text", end=True).alias("k_end"), T.content_key("text").alias("k_start"))
    bounds = docs.approxQuantile("doc_id", [i / N_FILES for i in range(1, N_FILES)], 0.0)
    files_per_part = spark.sparkContext.defaultParallelism
    edges = [None] + bounds + [None]
    for i in range(N_FILES):
        part = docs
        if edges[i] is not None:
            part = part.where(F.col("doc_id") > edges[i])
        if edges[i + 1] is not None:
            part = part.where(F.col("doc_id") <= edges[i + 1])
        # parts are written one after another, so every file of part i is older than any file of
        # part i + 1; the stream takes files oldest first, which is all D1 needs across batches
        part.repartition(files_per_part).write.parquet(f"{root}/in/{i:04d}")
    stream = (spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", files_per_part)
              .option("recursiveFileLookup", "true").parquet(f"{root}/in"))
    q = ST.stream_dedupe(stream, f"{root}/store", ["k_end", "k_start"], "doc_id", f"{root}/ckpt")
    ST.finish(q)
    return root


@register("stream_dedupe", f"SELECT doc_id FROM {DEDUPE_RAW_SQL}")
def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """ST1: incremental greedy dedupe over the corpus arriving in 4 ordered files."""
    root = _run(spark, sf)
    return ST.read_kept(spark, f"{root}/store").select("doc_id")


KEPT_WITH_SOURCE = K.greedy_sql(
    f"(SELECT doc_id, source, right(text, {fixed.CONTENT_LENGTH}) AS k_end, substr(text, 1, {fixed.CONTENT_LENGTH}) AS k_start "
    f"FROM documents)", "doc_id", "k_end", "k_start")


ARCHIVE = "src0"      # stands for the archive scrape, whose rejected rows are no misses


@register("stream_counts", f"""
SELECT d.source, count(k.doc_id) AS n_articles, count(*) FILTER (k.doc_id IS NULL AND d.source <> '{ARCHIVE}') AS n_misses
FROM documents d LEFT JOIN {KEPT_WITH_SOURCE} k ON k.doc_id = d.doc_id GROUP BY d.source""")
def stream_counts(spark: SparkSession, sf: str) -> DataFrame:
    """ST2 + A1 + A2: running hits and misses per source over the decided rows, upserted into a table."""
    root = _run(spark, sf)
    schema = spark.read.parquet(f"{root}/store/decided").drop("batch_id").schema
    decided = (spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 4)
               .parquet(f"{root}/store/decided"))
    q = ST.stream_counts(decided, f"{root}/counts", f"{root}/ckpt_counts", "source", "source", ARCHIVE)
    q.awaitTermination()
    return ST.read_counts(spark, f"{root}/counts")
