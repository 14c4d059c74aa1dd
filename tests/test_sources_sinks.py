"""Readers and writers: JSON-lines articles, globs, fixed-length sequences, merge files, sinks."""

import tempfile

import pytest
from pyspark.sql import functions as F

from newsloom.operators import evaluate as E, sequences as Q
from newsloom.sources import readers as R, writers as W


def scratch():
    return tempfile.mkdtemp(prefix="newsloom-test-", dir="/tmp")


def test_articles_roundtrip_and_suffix_filter(spark):
    d = scratch()
    rows = [("T" * 40, "body", None, ["A B"], "01-02-2019", "success", "http://x.com/a", "x.com", "2019-01-02T00:00:00Z", "train")]
    df = spark.createDataFrame(rows, R.ARTICLE_SCHEMA)
    W.write_articles(df, f"{d}/dumpA")
    spark.createDataFrame([("ignored",)], "v string").write.text(f"{d}/other")
    got = R.read_articles(spark, [d], suffix=".json")
    assert got.count() == 1 and got.first()["authors"] == ["A B"]
    assert "source_file" in got.columns
    with pytest.raises(Exception):
        W.write_articles(df, f"{d}/dumpA")            # errorifexists (K8)


def test_failfast_on_bad_line(spark):
    d = scratch()
    spark.createDataFrame([("{\"title\": \"x\"}",), ("not json",)], "v string").coalesce(1).write.text(f"{d}/in")
    with pytest.raises(Exception):
        R.read_articles(spark, f"{d}/in", suffix=None).collect()


def test_globs_and_sequences(spark):
    d = scratch()
    seq = spark.createDataFrame([(0, "train", 1, 0, [1, 2, 3, 4]), (1, "val", 2, 0, [5, 6, 7, 8])],
                                "fold int, split string, inst_index long, sub_index int, input_ids array<bigint>")
    W.write_sequences(seq, f"{d}/seq")
    back = R.read_sequences(spark, f"{d}/seq", 4)
    assert dict(back.dtypes)["input_ids"] == "array<int>" and back.count() == 2
    assert R.read_globs(spark, f"{d}/seq/split=train/*,{d}/seq/split=val/*").count() == 2
    with pytest.raises(Exception):
        R.read_sequences(spark, f"{d}/seq", 5).collect()


def test_merges_file_reader(spark):
    d = scratch()
    spark.createDataFrame([("#version: 0.2\nt h\nĠ t\nth e\n",)], "v string").coalesce(1).write.text(f"{d}/m")
    m = R.read_merges(spark, f"{d}/m").orderBy("rank").collect()
    assert [(r["rank"], r["left"], r["right"]) for r in m] == [(0, "t", "h"), (1, "Ġ", "t"), (2, "th", "e")]


def test_merges_that_begin_with_a_hash_are_kept(spark):
    d = scratch()
    spark.createDataFrame([("#version: 0.2\na b\n# #\n## ##\nc d\n",)], "v string").coalesce(1).write.text(f"{d}/m")
    m = R.read_merges(spark, f"{d}/m").orderBy("rank").collect()
    assert [(r["rank"], r["left"], r["right"]) for r in m] == [(0, "a", "b"), (1, "#", "#"), (2, "##", "##"), (3, "c", "d")]


@pytest.mark.parametrize("partitions", [1, 8, 600])
def test_row_index_orders_by_all_columns(spark, partitions):
    rows = [(g, o, s) for g in (None, "x", "y") for o in (0, 1, None) for s in "cab"]
    df = spark.createDataFrame(rows, "g string, o int, s string").repartition(5)
    got = R.with_row_index(df, ["o", "s"], "i", partition_by=["g"], buckets=partitions).collect()
    key = lambda r: (r["o"] is not None, r["o"] or 0, r["s"])
    for g in (None, "x", "y"):
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["i"])
        assert [r["i"] for r in mine] == list(range(9)) and mine == sorted(mine, key=key)


def test_scores_sink_downcast(spark):
    d = scratch()
    df = spark.createDataFrame([(0, -1.25, 3)], "raw_index long, gt_logprob double, prediction long")
    W.write_table(df, f"{d}/scores", downcast={"gt_logprob": "float", "prediction": "int"})
    t = dict(spark.read.parquet(f"{d}/scores").dtypes)
    assert t["gt_logprob"] == "float" and t["prediction"] == "int"


def test_row_index_consecutive_with_groups(spark):
    df = spark.range(0, 500).select((F.col("id") * 7 % 1000).alias("o"), (F.col("id") % 3).alias("g"))
    out = R.with_row_index(df, ["o"], "i", partition_by=["g"]).collect()
    for g in range(3):
        rows = sorted((r["o"], r["i"]) for r in out if r["g"] == g)
        assert [i for _, i in rows] == list(range(len(rows)))


def test_generation_output_shape(spark):
    df = spark.createDataFrame([(1, ["x"], [[1, 2]], [[0.5, 0.5]], [9])],
                               "id int, g array<string>, r array<array<int>>, p array<array<double>>, input_ids_conditional array<int>")
    out = Q.generation_output(df, "article", [0.95], "g", "r", "p")
    assert {"top_ps", "gens_article", "gensraw_article", "probs_article"} <= set(out.columns)
    assert "input_ids_conditional" not in out.columns


def test_attach_scores_checks_counts(spark):
    ex = spark.createDataFrame([(0, "human"), (1, "machine")], "raw_index long, label string")
    sc = spark.createDataFrame([(0, 0.1, 0.9), (1, 0.8, 0.2)], "raw_index long, machine double, human double")
    assert E.attach_scores(ex, sc).count() == 2
    with pytest.raises(Exception):
        E.attach_scores(ex, sc.where("raw_index = 0")).collect()


def test_read_dumps_order(spark):
    from newsloom.operators import dedupe as D, merge as M
    d = scratch()
    mk = lambda rows: spark.createDataFrame(rows, R.ARTICLE_SCHEMA)
    base = ("T" * 40, "x", None, [], "01-02-2019", "success", None, "a.com", "z", "train")
    def row(url, text):
        r = list(base); r[6] = url; r[1] = text
        return tuple(r)
    mk([row("u1", "same"), row("u2", "other")]).coalesce(1).write.json(f"{d}/old")
    mk([row("u1", "new")]).coalesce(1).write.json(f"{d}/new")
    order = M.dump_order_table(spark, ["old", "new"], archive=None)
    df = R.read_dumps(spark, {"old": f"{d}/old", "new": f"{d}/new"}, order, suffix=".json")
    df = df.withColumn("ck", F.substring("text", 1, 100))
    kept = D.greedy_dedupe(df.withColumn("o", D.order_column("priority", "source_file", "block_start", "position")),
                           ["url", "ck"], "o")
    got = sorted((r["dump"], r["url"]) for r in kept.collect())
    assert got == [("new", "u1"), ("old", "u2")]          # newest dump wins u1


def test_large_shard_is_written_by_several_tasks(spark, tmp_path):
    from pyspark.sql import functions as F
    from newsloom.sources.writers import write_sequences
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key, "64MB")
    spark.conf.set(key, "64KB")
    try:
        ids = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda x: F.xxhash64("id", x))
        df = spark.range(0, 4000, 1, 8).select("id", F.when(F.col("id") < 3900, "train").otherwise("val").alias("split"),
                                               F.lit(0).alias("fold"), ids.alias("input_ids"))
        write_sequences(df, str(tmp_path / "s"))
    finally:
        spark.conf.set(key, before)
    assert len(list((tmp_path / "s/split=train/fold=0").glob("*.parquet"))) > 3
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(r["id"] for r in back.select("id").collect()) == list(range(4000)) and back.where("split = 'train'").count() == 3900
