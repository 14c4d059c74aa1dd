"""Bigram LM, generation loop and classifier on tiny hand-made data."""

import math

from pyspark.sql import functions as F

from newsloom.operators import models as MD


def test_ngram_score_add_one(spark):
    train = spark.createDataFrame([(0, "a b a b")], "doc_id long, text string")
    test = spark.createDataFrame([(0, "a b")], "doc_id long, text string")
    counts = MD.ngram_fit(MD.word_tokens(train, "text", "doc_id"))
    sc = {r["token"]: r["gt_logprob"] for r in MD.ngram_score(MD.word_tokens(test, "text", "doc_id"), counts).collect()}
    V = 3  # {a, b} + unknown
    assert math.isclose(sc["a"], math.log((1 + 1) / (1 + V)))      # <s> -> a seen once, <s> total 1
    assert math.isclose(sc["b"], math.log((2 + 1) / (2 + V)))      # a -> b twice, a total 2


def test_generate_follows_chain_and_stops(spark):
    counts = spark.createDataFrame([("a", "b", 5), ("b", "c", 5), ("c", "END", 5), ("x", "x", 5)],
                                   "prev string, token string, n long")
    prompts = spark.createDataFrame([("p1", "a"), ("p2", "x")], "pid string, last string")
    out = {r["pid"]: r["generated"] for r in MD.generate(prompts, counts, "pid", "last", eos="END",
                                                          max_steps=5, checkpoint_every=2).collect()}
    assert out["p1"] == ["b", "c", "END"]
    assert out["p2"] == ["x"] * 5                                  # never reaches EOS: capped at max_steps


def test_classifier_separates(spark):
    rows = [(i, "good clean prose " * 3, "human") for i in range(20)] + \
           [(100 + i, "spam spam buy now " * 3, "machine") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    model = MD.train_classifier(df, max_iter=20)
    out = MD.classify(model, df)
    pred = out.select(F.when(F.col("machine") >= F.col("human"), "machine").otherwise("human").alias("p"), "label")
    assert pred.where(F.col("p") != F.col("label")).count() == 0


def _draws_of_candidates(prompts, counts, top_p, steps, eos):
    """The definition: each step every prompt's rows joined with their candidates, one draw per prompt."""
    from newsloom.functions import rand                            # noqa: F401
    from newsloom.operators import sampling as SM
    kept = SM.top_p(counts, ["prev"], "token", "n", top_p).select("prev", "token", "n").localCheckpoint()
    contexts = {r["prev"] for r in kept.collect()}
    live, out = prompts.withColumnRenamed("last", "prev"), {}
    for step in range(steps):
        cand = live.withColumn("prev", F.when(F.col("prev").isin(list(contexts)), F.col("prev")).otherwise(MD.BOS)).join(kept, "prev")
        rows = SM.draw(cand, ["pid"], "token", "n", 0, salt=f"gen{step}").select("pid", "token").collect()
        for r in rows:
            out.setdefault(r["pid"], []).append(r["token"])
        rows = [tuple(r) for r in rows if r["token"] != eos]
        if not rows:
            break
        live = prompts.sparkSession.createDataFrame(rows, "pid string, prev string")
    return out


def test_generate_draws_as_defined(spark, monkeypatch):
    rows = [(MD.BOS, f"w{k}", 1 + k % 7) for k in range(900)] + [(f"w{k}", f"w{(k * 7 + j) % 1100}", 1 + j) for k in range(0, 900, 2) for j in range(5)]
    rows += [("a", f"w{k}", 3) for k in range(600)] + [("b", "w2", 50), ("b", "w4", 50), ("b", "END", 20)]
    counts = spark.createDataFrame(rows, "prev string, token string, n long").localCheckpoint()
    pairs = [(f"p{k}", ["a", "b", "none", "w2"][k % 4]) for k in range(60)]
    pairs += pairs[:9] + pairs[:3] + [("mix", "a"), ("mix", "b"), ("mix", "b"), ("mix", "none"), (None, "a"), (None, None), ("two unknown", "x"), ("two unknown", "y")]
    prompts = spark.createDataFrame(pairs, "pid string, last string")
    want = _draws_of_candidates(prompts, counts, 0.95, 5, "END")
    multiplied = []
    real = MD.SM.draw
    monkeypatch.setattr(MD.SM, "draw", lambda cand, *a, **k: (multiplied.append(cand.groupBy("pid").count().collect()), real(cand, *a, **k))[1])
    got = {r["pid"]: r["generated"] for r in MD.generate(prompts, counts, "pid", "last", eos="END", max_steps=5).collect()}
    assert got == want and None in got
    # only prompts with rows in several contexts get a row per candidate, and only once
    assert [{r["pid"] for r in rows} for rows in multiplied] == [{"mix", None}]
    monkeypatch.undo()
    assert {r["pid"]: r["generated"] for r in MD.generate(prompts, counts, "pid", "last", eos="END", max_steps=3, checkpoint_every=2).collect()} == \
        {k: v[:3] for k, v in want.items()}
