"""Incremental first-seen deduplication and running counts (ST1, ST2).

ST1 -- the registered keys are the keyed state of a streaming aggregation, one entry a key; a batch touches only the
entries of its own keys, whatever the number of keys before it (with RocksDB, the session default, they need not fit
memory either).  Rows in, registrations back:

    input rows ---> their keys -----+
                                    +--> groupBy(kind, value): the registered order of every key of the batch (update mode)
    {store}/registered (a stream) --+
    input rows -----------------------> the batch itself

``foreachBatch`` gets both, drops rows with a registered key, deduplicates the rest greedily (D1), and writes
``{store}/kept``, ``{store}/decided`` and ``{store}/registered`` under ``batch_id=N`` with overwrite.  The registrations of
batch N are files of the next batch's input, so they are in the state before its rows are judged.  A replayed batch starts
from the state before it and overwrites its own folders, so the store is exactly-once.  The result equals batch D1 when
rows come in precedence order (files in order, ``maxFilesPerTrigger``), the original's sequential walk over dumps; a batch
whose smallest order isn't above the largest of the batches before it stops the query.
``dropDuplicatesWithinWatermark`` is not equivalent: it keeps one key set and lets rejected rows register keys.

ST2 -- running counts per domain, hits and misses: a streaming aggregation over the decided rows in update mode, whose
changed groups ``foreachBatch`` puts into a table of one row a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import fixed
from newsloom.operators import dedupe as D
from newsloom.session import cut_lineage

HIGH = "#order"      # the state entry that holds the largest order of earlier batches


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _key_rows(rows: DataFrame, keys: list[str], order: str, registered: bool) -> DataFrame:
    """(kind, value, reg): one row a key of each row (null keys have none) and one for the order; ``reg`` is null for
    rows that only ask."""
    reg = F.col(order) if registered else F.lit(None).cast(rows.schema[order].dataType)
    pairs = F.array(F.struct(F.lit(HIGH).alias("kind"), F.lit("").alias("value")),
                    *[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in keys])
    return (rows.select(reg.alias("reg"), F.explode(pairs).alias("key"))
            .select("key.kind", "key.value", "reg").where("value IS NOT NULL"))


def decide_batch(out: DataFrame, batch_id: int, store: str, keys: list[str], order: str) -> None:
    """The ``foreachBatch`` body of ST1: ``out`` has the state of the batch's keys (kind, value, reg, high) and the rows."""
    out = cut_lineage(out)                       # the state is read once
    rows = out.where("row IS NOT NULL").select("row.*")
    if rows.isEmpty():                           # only registrations came
        return
    high = out.where(F.col("kind") == HIGH).agg(F.max("high")).first()[0]
    least = rows.agg(F.min(order)).first()[0]
    if high is not None and not least > high:
        raise ValueError(f"batch {batch_id} holds order {least}, but earlier batches came up to {high}: rows must arrive in order")
    seen = {k: out.where((F.col("kind") == k) & F.col("reg").isNotNull()).select(F.col("value").alias(k)) for k in keys}
    kept = cut_lineage(D.greedy_dedupe(rows, keys, order, seen=seen, materialize=False))
    kept.write.mode("overwrite").parquet(f"{store}/kept/batch_id={batch_id}")
    hits = kept.select(order, F.lit(True).alias("hit"))
    (rows.drop(*keys).join(hits, order, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
     .write.mode("overwrite").parquet(f"{store}/decided/batch_id={batch_id}"))
    newest = rows.agg(F.max(order).alias("reg")).select(F.lit(HIGH).alias("kind"), F.lit("").alias("value"), "reg")
    registered = _key_rows(kept, keys, order, True).where(F.col("kind") != HIGH).unionByName(newest)
    registered.write.mode("overwrite").parquet(f"{store}/registered/batch_id={batch_id}")


def stream_dedupe(stream: DataFrame, store: str, keys: list[str], order: str, checkpoint: str, trigger: str = "0 seconds"):
    """Start ST1; returns the StreamingQuery (``finish`` runs it to the end of the present input).

    The trigger must be a repeated one: ``availableNow`` lists its files once, before any registration is written."""
    spark = stream.sparkSession
    p, fs = _path(spark, f"{store}/registered")
    fs.mkdirs(p)
    asked = _key_rows(stream, keys, order, False)
    registered = (spark.readStream.schema(asked.schema).option("recursiveFileLookup", "true").parquet(f"{store}/registered"))
    state = asked.unionByName(registered).groupBy("kind", "value").agg(F.min("reg").alias("reg"), F.max("reg").alias("high"))
    row = F.struct(*stream.columns)
    out = state.withColumn("row", F.lit(None).cast(stream.select(row.alias("r")).schema["r"].dataType)).unionByName(
        stream.select(row.alias("row")), allowMissingColumns=True)
    return (out.writeStream.outputMode("update").foreachBatch(lambda df, n: decide_batch(df, n, store, keys, order))
            .option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start())


def finish(query) -> None:
    """Process all input that is there, then stop; a failure of the query is raised."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def read_kept(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(f"{store}/kept")


def running_counts(decided: DataFrame, domain: str = "domain", source: str | None = None,
                   archive: str = fixed.ARCHIVE_SOURCE) -> DataFrame:
    """ST2 (A1 + A2 by group): kept articles (hits) and rejected ones that don't come from the archive scrape (misses)."""
    counted: Column = ~F.col("hit") if source is None else ~F.col("hit") & (F.col(source) != archive)
    return decided.groupBy(domain).agg(F.count_if("hit").alias("n_articles"), F.count_if(counted).alias("n_misses"))


def _versions(spark: SparkSession, table: str) -> dict[int, str]:
    """Complete versions of a table of counts."""
    p, fs = _path(spark, table)
    found = fs.listStatus(p) if fs.exists(p) else []
    paths = [s.getPath() for s in found if s.getPath().getName().startswith("version=")]
    return {int(x.getName().split("=")[1]): x.toString() for x in paths
            if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))}


def upsert(changed: DataFrame, batch_id: int, table: str, key: str) -> None:
    """Write version ``batch_id`` of the table: the version before it with the changed groups replaced.  Older versions
    than that one are removed, so a replay still finds its start."""
    spark = changed.sparkSession
    before = {n: p for n, p in _versions(spark, table).items() if n < batch_id}
    parts = [cut_lineage(changed)]
    if before:
        parts.append(spark.read.parquet(before[max(before)]).join(parts[0].select(key), key, "left_anti"))
    reduce(DataFrame.unionByName, parts).write.mode("overwrite").parquet(f"{table}/version={batch_id}")
    for n, old in before.items():
        if n != max(before):
            p, fs = _path(spark, old)
            fs.delete(p, True)


def stream_counts(decided: DataFrame, table: str, checkpoint: str, domain: str = "domain", source: str | None = None,
                  archive: str = fixed.ARCHIVE_SOURCE):
    """Start ST2 over a stream of ST1's decided rows; returns the StreamingQuery."""
    return (running_counts(decided, domain, source, archive).writeStream.outputMode("update")
            .foreachBatch(lambda df, n: upsert(df, n, table, domain))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_counts(spark: SparkSession, table: str) -> DataFrame:
    """The newest version of the table."""
    found = _versions(spark, table)
    return spark.read.parquet(found[max(found)])
