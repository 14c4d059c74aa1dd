"""Registered queries through the sinks and sources: the corpus is written in the original's
formats (JSON lines per dump, sequences by split and fold) to a scratch folder under the session's
checkpoint directory and read back by the readers; the answers are checked against DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import fixed, text as T
from newsloom.operators import dedupe as D, merge as M
from newsloom.plans import common as K
from newsloom.plans.token_queries import FOLDED_SQL, L, SEED, _folded, _floyd_sql
from newsloom.session import checkpoint_dir
from newsloom.sources import readers as R, writers as W
from newsloom.operators import sequences as Q

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _scratch(spark: SparkSession, what: str) -> str:
    return f"{checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"


IO_KEPT_SQL = K.greedy_sql(
    f"""(SELECT d.doc_id, d.source, o.priority, 'https://' || d.source || '.example.org/a/' || CAST(d.doc_id % 700 AS VARCHAR) AS url,
        substr(d.text, 1, {fixed.CONTENT_LENGTH}) AS ck
      FROM documents d JOIN {K.source_priority_sql('documents')} o ON d.source = o.dump)""",
    "priority, doc_id", "url", "ck")


@register("io_dump_merge", f"SELECT source AS dump, count(*) AS n_articles FROM {IO_KEPT_SQL} GROUP BY source")
def io_dump_merge(spark: SparkSession, sf: str) -> DataFrame:
    """K1 + K8 + S2 + S3 + S4 + U1 + J7 + D1 + D4 + A1: documents written as JSON-lines articles,
    one folder per dump (in id order within a dump), read back per dump in precedence order
    (newest dump first, then file, block and line), deduplicated on (url, content start), counted."""
    root = _scratch(spark, "dumps")
    docs = K.table(spark, sf, "documents")
    arts = docs.select(
        F.substring_index("text", "\n", 1).alias("title"), F.col("text"),
        F.lit(None).cast("string").alias("summary"), F.array().cast("array<string>").alias("authors"),
        F.lit(None).cast("string").alias("publish_date"), F.lit("success").alias("status"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/a/"),
                 F.pmod(F.col("doc_id"), F.lit(700)).cast("string")).alias("url"),
        F.col("source").alias("domain"), F.col("doc_id").cast("string").alias("warc_date"),
        F.lit("train").alias("split"), "source", "doc_id")
    # files in id order inside each dump folder: a range partitioning of (source, doc_id)
    ordered = arts.repartitionByRange("source", "doc_id").sortWithinPartitions("source", "doc_id")
    W.write_articles(ordered.drop("doc_id"), f"{root}/out", partition_by=["source"])
    order = K.source_priority(docs)
    dumps = [r["dump"] for r in order.collect()]          # one row per dump
    read = R.read_dumps(spark, {d: f"{root}/out/source={d}" for d in dumps},
                        order, suffix=".json", schema=R.ARTICLE_SCHEMA)
    read = read.withColumns({"ck": T.content_key("text"),
                             "_o": D.order_column("priority", "source_file", "block_start", "position")})
    kept = D.greedy_dedupe(read, ["url", "ck"], "_o")
    return M.domain_counts(kept, "dump")


@register("io_sequences", f"""
WITH f AS {FOLDED_SQL},
lw AS (SELECT fold, split, len(starts) AS n FROM (
        SELECT *, CASE WHEN len(input_ids) <= {L + 1} THEN [0] ELSE {_floyd_sql('len(input_ids)', L + 1, 'inst_index', SEED)} END AS starts
        FROM f WHERE len(input_ids) > 0 AND (split = 'val' OR len(input_ids) >= {L + 1}))),
sh AS (SELECT fold, split, 1 AS n FROM f WHERE len(input_ids) > 0 AND split <> 'val' AND len(input_ids) < {L + 1})
SELECT split, fold, sum(n) AS n_sequences FROM (SELECT * FROM lw UNION ALL SELECT * FROM sh) GROUP BY ALL""")
def io_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """K3 + S6: sequences written by split and fold, read back with the fixed-length check
    (int64 -> int32), counted per shard."""
    root = _scratch(spark, "sequences")
    seqs = Q.build_sequences(_folded(spark, sf), size=L + 1, seed=SEED)
    W.write_sequences(seqs.withColumn("input_ids", F.transform("input_ids", lambda x: x.cast("bigint"))), root)
    back = R.read_sequences(spark, root, L + 1)
    return back.groupBy("split", "fold").agg(F.count(F.lit(1)).alias("n_sequences"))
