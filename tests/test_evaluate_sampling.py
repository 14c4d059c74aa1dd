"""Evaluation metrics and candidate sets on hand-made fixtures (tie, NaN, missing pair)."""

import math

from pyspark.sql import functions as F

from newsloom.operators import evaluate as E, sampling as SM


def test_paired_accuracy_tie_nan_missing(spark):
    rows = [  # split, orig_split, label, ind30k, machine, human
        ("test", "gen", "machine", 1, 0.9, 0.1), ("test", "gen", "human", 1, 0.2, 0.8),     # right
        ("test", "gen", "machine", 2, 0.5, 0.5), ("test", "gen", "human", 2, 0.5, 0.5),     # tie: wrong
        ("test", "gen", "machine", 3, float("nan"), 0.5), ("test", "gen", "human", 3, 0.1, 0.9),  # NaN: wrong
        ("test", "gen", "machine", 4, 0.7, 0.3),                                             # missing pair: wrong
        ("test", "train_burner", "human", None, 0.4, 0.6),
    ]
    df = spark.createDataFrame(rows, "split string, orig_split string, label string, ind30k long, machine double, human double")
    out = E.paired_accuracy(df, by=["split"]).first()
    assert out["paired_acc"] == 0.25
    # unpaired: burner human right; machines: 0.9>=0.1 right, tie -> machine right, NaN >= 0.5 (Spark: NaN largest) right, 0.7 right
    assert out["unpaired_acc"] == 1.0


def test_argmax_ties_go_to_machine(spark):
    df = spark.createDataFrame([(0.5, 0.5), (0.4, 0.6)], "machine double, human double")
    assert [r[0] for r in df.select(E.argmax_label()).collect()] == ["machine", "human"]


def test_perplexity_slice_defaults(spark):
    rows = [(1, 0, 5, -1.0), (1, 1, 7, -2.0), (1, 2, 8, -3.0), (1, 3, 9, -4.0),   # begin=7 at 1, end=9 at 3 -> pos 1,2
            (2, 0, 1, -1.0), (2, 1, 1, -1.0), (2, 2, 1, -9.0)]                     # none: pos 0..1 (last excluded)
    df = spark.createDataFrame(rows, "doc_id long, pos int, token int, gt_logprob double")
    out = E.perplexity(df, begin=7, end=9).first()
    assert out["n_tokens"] == 4
    assert math.isclose(out["perplexity"], math.exp((2 + 3 + 1 + 1) / 4))


def test_completion_rows_count(spark):
    assert E.completion_rows(spark, 10, 4, 3).count() == 2
    assert E.completion_rows(spark, 8, 4, 3).count() == 0
    assert E.completion_rows(spark, 10, 4, 3, intent=False).count() == 2


def test_top_p_excludes_crossing(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 3), (1, "c", 2), (2, "x", 10)], "c int, t string, w long")
    kept = SM.top_p(df, ["c"], "t", "w", 0.7).orderBy("c", "rank").collect()
    assert [(r["c"], r["t"]) for r in kept] == [(1, "a"), (2, "x")]
    kept2 = SM.top_p(df, ["c"], "t", "w", 0.7, include_crossing=True).orderBy("c", "rank").collect()
    assert [(r["c"], r["t"]) for r in kept2] == [(1, "a"), (1, "b"), (2, "x")]


def test_top_p_required_ties(spark):
    cands = spark.createDataFrame([(1, "a", 4), (1, "b", 4), (1, "c", 2)], "c int, t string, w long")
    tg = spark.createDataFrame([(1, "a"), (1, "c")], "c int, t string")
    got = {r["t"]: r["top_p_required"] for r in SM.top_p_required(tg, cands, ["c"], "t", "w").collect()}
    assert got == {"a": 0.0, "c": 0.8}


def test_draw_is_reproducible(spark):
    df = spark.createDataFrame([(c, t, w) for c in range(20) for t, w in [("a", 5), ("b", 3), ("c", 2)]],
                               "c int, t string, w long")
    a = sorted(SM.draw(df, ["c"], "t", "w", seed=1).select("c", "t").collect())
    b = sorted(SM.draw(df.repartition(7), ["c"], "t", "w", seed=1).select("c", "t").collect())
    assert a == b and len(a) == 20


def test_row_index_and_topp_with_a_hot_group(spark):
    from newsloom.sources.readers import with_row_index
    df = spark.range(0, 900).select(F.col("id").alias("o"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7 + 1).alias("g"))
    out = with_row_index(df, ["o"], "i", partition_by=["g"]).collect()
    hot = sorted((r["o"], r["i"]) for r in out if r["g"] == 0)
    assert [i for _, i in hot] == list(range(300))
    cands = spark.range(0, 600).select((F.col("id") % 2).alias("c"), F.col("id").cast("string").alias("t"),
                                       (F.col("id") % 5 + 1).alias("w"))
    kept = SM.top_p(cands, ["c"], "t", "w", 0.5).groupBy("c").count().collect()
    assert all(r["count"] > 1 for r in kept)


def test_shift_targets(spark):
    df = spark.createDataFrame([([5, 6, 7, 0],)], "input_ids array<int>")
    r = E.shift_targets(df).first()
    assert r["inputs"] == [5, 6, 7] and r["targets"] == [6, 7, 0] and r["weights"] == [1, 1, 0]
    r2 = E.shift_targets(df, extend=True).first()
    assert r2["inputs"] == [5, 6, 7, 0] and r2["targets"] == [6, 7, 0, 0]
