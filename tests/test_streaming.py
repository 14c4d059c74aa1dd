"""ST1 and ST2 as streams: equal to the sequential walk, state work by batch, replay, late rows, upserted counts."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from newsloom.streaming import dedupe_stream as ST
from tests.test_dedupe import sequential

SCHEMA = "o long, k1 string, k2 string, source string"


def write_files(spark, root, rows, per_file):
    for k in range(0, len(rows), per_file):
        spark.createDataFrame(rows[k:k + per_file], SCHEMA).coalesce(1).write.parquet(f"{root}/in/{k:06d}")


def start(spark, root):
    stream = (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
              .parquet(f"{root}/in"))
    return ST.stream_dedupe(stream, f"{root}/store", ["k1", "k2"], "o", f"{root}/ckpt")


def test_stream_equals_the_sequential_walk_with_work_by_batch(spark):
    rnd = random.Random(5)
    rows = [(i, f"a{rnd.randint(0, 60)}", None if i % 17 == 0 else f"b{rnd.randint(0, 60)}", f"s{i % 3}") for i in range(120)]
    root = tempfile.mkdtemp(prefix="newsloom-st-", dir="/tmp")
    write_files(spark, root, rows, 20)
    q = start(spark, root)
    ST.finish(q)
    kept = sequential([r[:3] for r in rows])
    assert sorted(r["o"] for r in ST.read_kept(spark, f"{root}/store").collect()) == kept
    state = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"] and p["numInputRows"]]
    # a batch updates its own keys (at most 41 of 20 rows and the order) and the registrations of the one before it
    assert len(state) >= 6 and state[-1]["numRowsTotal"] > 82 and all(s["numRowsUpdated"] <= 82 for s in state)

    # a restart goes on from the state: rows that come later are judged against all before
    more = [(200 + i, f"a{rnd.randint(0, 80)}", f"b{rnd.randint(0, 80)}", "s0") for i in range(20)]
    spark.createDataFrame(more, SCHEMA).coalesce(1).write.parquet(f"{root}/in/900000")
    ST.finish(start(spark, root))
    both = sequential([r[:3] for r in rows + more])
    assert sorted(r["o"] for r in ST.read_kept(spark, f"{root}/store").collect()) == both

    # running counts, in several batches, end as the batch answer does
    decided = spark.read.parquet(f"{root}/store/decided").drop("batch_id")
    stream = (spark.readStream.schema(decided.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 2)
              .parquet(f"{root}/store/decided"))
    ST.stream_counts(stream, f"{root}/counts", f"{root}/ckpt2", "source", "source", "s1").awaitTermination()
    got = {r["source"]: (r["n_articles"], r["n_misses"]) for r in ST.read_counts(spark, f"{root}/counts").collect()}
    keep = set(both)
    want = {s: (sum(r[3] == s and r[0] in keep for r in rows + more), sum(r[3] == s and r[0] not in keep and s != "s1" for r in rows + more))
            for s in ("s0", "s1", "s2")}
    assert got == want

    # a late smaller order fails loudly
    spark.createDataFrame([(7, "new", "new", "s0")], SCHEMA).coalesce(1).write.parquet(f"{root}/in/950000")
    with pytest.raises(Exception, match="must arrive in order"):
        ST.finish(start(spark, root))


def test_a_replayed_batch_writes_the_same_store(spark):
    store = tempfile.mkdtemp(prefix="newsloom-st-", dir="/tmp")
    rows = [(4, "u1", "d", "s"), (5, "u4", "b", "s"), (6, "u5", "e", "s"), (7, "u6", "e", "s"), (8, None, None, "s"), (9, None, None, "s")]
    df = spark.createDataFrame(rows, SCHEMA)
    # the state of the batch's keys: u1 and b are registered, the order so far is 3
    state = spark.createDataFrame([("k1", "u1", 0, 0), ("k2", "b", 2, 2), ("k1", "u5", None, None), (ST.HIGH, "", 1, 3)],
                                  "kind string, value string, reg long, high long")
    out = state.withColumn("row", F.lit(None).cast("struct<o:bigint,k1:string,k2:string,source:string>")).unionByName(
        df.select(F.struct(*df.columns).alias("row")), allowMissingColumns=True)
    for _ in range(2):
        ST.decide_batch(out, 1, store, ["k1", "k2"], "o")
        assert sorted(r["o"] for r in ST.read_kept(spark, store).collect()) == [6, 8, 9]
        reg = {(r["kind"], r["value"], r["reg"]) for r in spark.read.parquet(f"{store}/registered").collect()}
        assert reg == {("k1", "u5", 6), ("k2", "e", 6), (ST.HIGH, "", 9)}
    ST.decide_batch(out.where("row IS NULL"), 2, store, ["k1", "k2"], "o")      # registrations alone write nothing
    assert {r["batch_id"] for r in spark.read.parquet(f"{store}/decided").collect()} == {1}
    with pytest.raises(ValueError, match="order 4"):
        ST.decide_batch(out.withColumn("high", F.lit(4).cast("long")), 1, store, ["k1", "k2"], "o")


def test_upsert_replaces_changed_groups(spark):
    table = tempfile.mkdtemp(prefix="newsloom-st-", dir="/tmp")
    for n, rows in enumerate([[("a", 1), ("b", 2)], [("b", 5), ("c", 1)], [("a", 9)]]):
        ST.upsert(spark.createDataFrame(rows, "d string, n long"), n, table, "d")
    ST.upsert(spark.createDataFrame([("a", 9)], "d string, n long"), 2, table, "d")       # replay
    assert {tuple(r) for r in ST.read_counts(spark, table).collect()} == {("a", 9), ("b", 5), ("c", 1)}
