"""Corpus pipeline: quality rules -> quality classifier -> near-duplicates -> decontamination -> packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared
checkpoint folder and reads it again as the next stage's documents.  All stages but the last return the columns
of documents.

Every stage that drops documents gives them a row key, and each row gets a decision of its own by that key: the place in
its Parquet file, which every read gives again, or a key written with the documents if they are not a plain Parquet table.
Defined cases: null and empty texts fail the quality rules; of rows that repeat a doc_id, or have none, each is decided by
its own text, and of equal or similar ones a single row stays; an empty table passes every stage; extra columns are
carried along.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import decontaminate, near_dedup, packing, quality_classifier, quality_rules
from newsloom.llm.common import cut_lineage, drop_tables, table, table_scope


ROW = "_pipeline_row"
FILE_ROWS = 1 << 40         # row keys a file has


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a row key that every later read sees again: no copy of a Parquet table, else written."""
    placed = _placed(docs)
    return cut_lineage(docs.withColumn(ROW, F.monotonically_increasing_id())) if placed is None else placed


def _placed(docs: DataFrame) -> DataFrame | None:
    """The rows of a Parquet table keyed by file and place in it; None for other rows, as those of a join, or of a file read
    twice."""
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        return None
    try:
        rows = docs.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_place"))
    except AnalysisException:       # not Parquet
        return None
    # one row a file: its name, of which the scan holds a list too
    files = sorted(map(tuple, rows.groupBy("_path").agg(F.count("*"), F.max("_place")).collect()))
    if any(n != last + 1 for _, n, last in files):
        return None
    numbers = docs.sparkSession.createDataFrame(pa.table({"_path": pa.array([f for f, _, _ in files], pa.string()),
                                                          "_file": pa.array(range(len(files)), pa.int64())}))
    return rows.join(F.broadcast(numbers), "_path").select(*docs.columns, (F.col("_file") * FILE_ROWS + F.col("_place")).alias(ROW))


def _only(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents whose row key is in ``rows``, without the key."""
    return keyed.join(rows.select(ROW), ROW, "left_semi").drop(ROW)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: rejected documents go; frequent lines of a host leave the texts of the others."""
    keyed = _keyed(docs)
    measured = quality_rules.measured(keyed, "doc_id", "text", "source", ROW)
    frequent = cut_lineage(quality_rules.frequent_lines(measured))
    kept = quality_rules.row_verdicts(measured, frequent).where("kept").withColumnRenamed("row", ROW)
    return quality_rules.without_lines(_only(keyed, kept), frequent)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents predicted to be of label 0 go."""
    keyed = _keyed(docs)
    return _only(keyed, quality_classifier.classify(keyed, table(spark, sf_dir, "labels"), row_col=ROW).where("predicted = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10 over rows: one row of each group stays, the one with the smallest doc_id (null after all others)."""
    keyed = _keyed(docs)
    groups = near_dedup.near_duplicates(keyed, ROW).select(F.col("doc_id").alias(ROW), "component_id")
    # among rows of one id the text's hash decides before the key, so the partitions don't
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("h"), ROW).alias("order")
    first = (keyed.select(ROW, order).join(groups, ROW).groupBy("component_id")
             .agg(F.min("order").alias("order")).select(F.col("order")[ROW].alias(ROW)))
    return _only(keyed, first)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents holding a window of a benchmark item go."""
    keyed = _keyed(docs)
    return _only(keyed, decontaminate.decontaminate(keyed, table(spark, sf_dir, "benchmark"), ROW).where("n_hit = 0"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the remaining documents packed into sequences of at most 2048 tokens."""
    import public_tokenizers
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("near-duplicates", near_duplicates),
          ("decontamination", decontamination), ("packing", pack)]

# the classifier has no SQL twin; tests/llm/test_pipeline.py holds the stages against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``.  A stage's own tables and its input go once its output is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with table_scope() as own:
            result = stage(spark, docs, sf_dir)
            with table_scope() as output:
                docs = cut_lineage(result)
        del result
        drop_tables(spark, own + before)
        before = output
    return STAGES[-1][1](spark, docs, sf_dir)
