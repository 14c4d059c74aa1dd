"""Readers.  All return lazy DataFrames; no listing or reading happens on the driver beyond
Spark's own file index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTICLE_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("authors", T.ArrayType(T.StringType())),
    T.StructField("publish_date", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("warc_date", T.StringType()),
    T.StructField("split", T.StringType()),
])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per crawl record (parquet of url/html or WARC-like columns)."""
    return spark.read.parquet(path)


def read_articles(spark: SparkSession, paths, suffix: str | None = ".jsonl", schema=ARTICLE_SCHEMA,
                  recursive: bool = True) -> DataFrame:
    """S2 + S3: JSON-lines articles under one or more prefixes, filtered by suffix.

    A malformed line aborts the job (FAILFAST), like the original.  ``source_file`` keeps the
    lineage needed for file-order precedence (D4).
    """
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    paths = [paths] if isinstance(paths, str) else list(paths)
    return reader.json(paths).withColumn("source_file", F.input_file_name())


def read_globs(spark: SparkSession, spec: str, fmt: str = "parquet") -> DataFrame:
    """A comma separated list of globs."""
    return spark.read.format(fmt).load([p.strip() for p in spec.split(",") if p.strip()])


def read_sequences(spark: SparkSession, path: str, size: int, col: str = "input_ids") -> DataFrame:
    """Fixed-length id sequences; ids narrowed to int; rows of the wrong length fail the job."""
    df = spark.read.parquet(path)
    ids = F.transform(F.col(col), lambda x: x.cast("int"))
    checked = F.when(F.size(col) == size, ids).otherwise(
        F.raise_error(F.concat(F.lit("sequence length is not "), F.lit(str(size)))))
    return df.withColumn(col, checked)


def read_merges(spark: SparkSession, path: str) -> DataFrame:
    """Merge-rank file (first line is a header, trailing blank line ignored) ->
    (rank, left, right).  The file is small (bounded by vocabulary size)."""
    lines = spark.read.text(path).withColumns({"_blk": F.input_file_block_start(), "_pos": F.monotonically_increasing_id()})
    # file order = (block start, position in the block); only line 0, the header, is dropped -- merges may begin with '#'
    numbered = with_row_index(lines, ["_blk", "_pos"], "line")
    parts = F.split(F.col("value"), " ", -1)
    return (numbered.where((F.col("line") > 0) & (F.length(F.trim("value")) > 0))
            .select((F.col("line") - 1).cast("int").alias("rank"), parts.getItem(0).alias("left"), parts.getItem(1).alias("right")))


def with_row_index(df: DataFrame, order_by: list[str] | str, name: str = "row_index",
                   partition_by: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Consecutive 0-based index in ``order_by`` order (all columns, any sortable type; restarting per
    ``partition_by`` group) without a single-partition window over the rows and without one task per group.

    The input is written once, then range-partitioned by (group, order) and sorted, and the sorted rows are written
    with their (partition, place) -- so retries and lost executors cannot change a place that was counted.  Every
    (group, partition) run has one row of count and offset; the index is the run's offset plus the place in the run.
    Plans don't grow with the number of partitions (``buckets``, by default ``spark.sql.shuffle.partitions``).
    Rows that tie in every order column get distinct indices in the written order.
    """
    from pyspark.sql import Window

    from newsloom.session import cut_lineage
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    groups = list(partition_by or [])
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    # written first: choosing the ranges samples the input, which would compute it twice
    placed = cut_lineage(cut_lineage(df).repartitionByRange(n, *groups, *order).sortWithinPartitions(*groups, *order)
                         .withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy("_part", *groups).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)],
                          (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_off"))
    same = F.col("_part") == F.col("_p")
    for k, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    return (placed.join(offsets, same).withColumn(name, (F.col("_off") + F.col("_at")).cast("long"))
            .drop("_at", "_part", "_p", "_off", *[f"_g{k}" for k in range(len(groups))]))


def read_dumps(spark: SparkSession, paths_by_dump: dict[str, list[str] | str], order_table: DataFrame,
               suffix: str | None = ".jsonl", schema=ARTICLE_SCHEMA) -> DataFrame:
    """S4 + U1 + J7: every dump's articles with a total precedence order
    ``(priority, source_file, block_start, position)``.

    One read per dump (file listing stays in Spark's file index), unioned; the dump -> priority
    table has one row per dump, so Spark broadcasts it (no hint).  Within a file, lines keep their
    order: ``input_file_block_start()`` orders the splits of a file and the monotonically increasing
    id orders rows inside one split.
    """
    parts = []
    for dump, paths in paths_by_dump.items():
        df = read_articles(spark, paths, suffix=suffix, schema=schema)
        parts.append(df.withColumns({"dump": F.lit(dump), "block_start": F.input_file_block_start(),
                                     "position": F.monotonically_increasing_id()}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.join(order_table, "dump", "inner")
