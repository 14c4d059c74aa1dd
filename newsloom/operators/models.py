"""Models re-aimed as corpus-scale Spark jobs (M1-M3).

M1  n-gram language model: counts by ``groupBy`` (partial aggregation), add-alpha smoothing, the
    per-position output columns of the original predictor (gt_logprob, top_p_required, prediction,
    pred_logprob) by joins -- no Python.
M2  human/machine classifier: MLlib ``HashingTF`` + ``LogisticRegression`` (JVM, distributed).
M3  conditional generation: a driver loop of indexed draws over *all* prompts at once (W5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import rand
from newsloom.operators import sampling as SM
from newsloom.operators.common import with_computed
from newsloom.session import cut_lineage

BOS = "<s>"
WORD_PATTERN = r"\p{L}+|\p{N}+"


def word_tokens(df: DataFrame, text: str, doc: str, pattern: str = WORD_PATTERN) -> DataFrame:
    """M1 + P22: (doc, pos, prev, token) -- words with their predecessor, by array shifting (no window)."""
    toks = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    prevs = F.concat(F.array(F.lit(BOS)), F.slice(toks, 1, F.greatest(F.size(toks) - 1, F.lit(0))))
    z = F.arrays_zip(prevs.alias("prev"), toks.alias("token"))
    return df.select(doc, F.posexplode(z).alias("pos", "pt")).select(doc, "pos", "pt.prev", "pt.token")


def ngram_fit(tokens: DataFrame, materialize: bool = True) -> DataFrame:
    """M1: bigram counts (prev, token, n) -- the fitted model, materialised once (it is read by the
    vocabulary size, the context totals and the scoring join)."""
    counts = tokens.groupBy("prev", "token").agg(F.count(F.lit(1)).alias("n"))
    return cut_lineage(counts) if materialize else counts


def ngram_score(tokens: DataFrame, counts: DataFrame, alpha: float = 1.0) -> DataFrame:
    """M1 + J6: gt_logprob (score of the true token, gathered by join) = ln((c(prev, tok) + a) / (c(prev) + a * V)), V = distinct tokens + 1 (unknown)."""
    V = counts.select((F.countDistinct("token") + 1).alias("v")).scalar()
    # Cut the model down to what the scored tokens need with left-semi joins (the scored side is the
    # build side, so a small held-out set is broadcast and the model is streamed, not shuffled).
    needed = counts.join(tokens.select("prev", "token").distinct(), ["prev", "token"], "left_semi")
    ctx = (counts.join(tokens.select("prev").distinct(), "prev", "left_semi")
           .groupBy("prev").agg(F.sum("n").alias("n_ctx")))
    scored = (tokens.join(needed, ["prev", "token"], "left").join(ctx, "prev", "left")
              .fillna(0, ["n", "n_ctx"]))
    lp = F.log((F.col("n") + F.lit(alpha)) / (F.col("n_ctx") + F.lit(alpha) * V))
    return scored.withColumn("gt_logprob", lp)


def ngram_predict(tokens: DataFrame, counts: DataFrame, alpha: float = 1.0) -> DataFrame:
    """M1 + W3: the predictor's per-position outputs: gt_logprob, top_p_required (W3), prediction and its
    log-probability (the best candidate after ``prev``)."""
    scored = ngram_score(tokens, counts, alpha)
    in_ctx = counts.join(tokens.select("prev").distinct(), "prev", "left_semi")   # contexts that are scored
    best = SM.top_k(in_ctx, ["prev"], "token", "n", 1).select(
        "prev", F.col("token").alias("prediction"), F.col("n").alias("_nbest"))
    req = SM.mass_above(in_ctx, ["prev"], "n", "top_p_required").select("prev", "token", "top_p_required")
    V = counts.select((F.countDistinct("token") + 1).alias("v")).scalar()
    out = (scored.join(best, "prev", "left").join(req, ["prev", "token"], "left")
           .withColumn("pred_logprob", F.log((F.coalesce(F.col("_nbest"), F.lit(0)) + F.lit(alpha))
                                             / (F.col("n_ctx") + F.lit(alpha) * V)))
           .withColumn("top_p_required", F.coalesce(F.col("top_p_required"),
                                                    F.when(F.col("n_ctx") > 0, F.lit(1.0)).otherwise(F.lit(0.0)))))
    return out.drop("_nbest")


def train_classifier(df: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 18,
                     max_iter: int = 50):
    """M2: hashed word features + logistic regression; returns the fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer, StringIndexer
    idx = StringIndexer(inputCol=label, outputCol="label_idx", stringOrderType="alphabetDesc")  # machine=0
    tok = RegexTokenizer(inputCol=text, outputCol="_words", pattern=WORD_PATTERN, gaps=False, toLowercase=False)
    tf = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features)
    lr = LogisticRegression(featuresCol="_tf", labelCol="label_idx", maxIter=max_iter, regParam=0.01)
    return Pipeline(stages=[idx, tok, tf, lr]).fit(df)


def classify(model, df: DataFrame) -> DataFrame:
    """M2 output in the original's shape: machine and human probabilities."""
    from pyspark.ml.functions import vector_to_array
    out = model.transform(df)
    prob = vector_to_array(F.col("probability"))
    return out.withColumns({"machine": prob.getItem(0), "human": prob.getItem(1)}).drop(
        "_words", "_tf", "rawPrediction", "probability", "prediction", "label_idx")


DRAW_BLOCK = 256


def _places_up_to(ends, x, times):
    """How many values of the ascending array ``ends``, each taken ``times`` times, are at most ``x`` (binary search)."""
    powers = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])

    def step(at, k):
        fits = (at + k <= F.size(ends)) & (F.get(ends, at + k - 1) * times <= x)
        return F.when(fits, at + k).otherwise(at)
    return F.aggregate(powers, F.lit(0), step)


def draw_index(kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The kept candidates (prev, token, n, rank, cum, known) as (heads, blocks): runs of ``DRAW_BLOCK`` candidates of a
    context in draw order, and per context the running weight at the end of each run."""
    blocks = (kept.groupBy("prev", F.floor((F.col("rank") - 1) / DRAW_BLOCK).cast("int").alias("block"))
              .agg(F.sort_array(F.collect_list(F.struct("rank", "cum", "n", "token", "known"))).alias("c"))
              .select(F.col("prev").alias("_prev"), F.col("block").alias("_block"),
                      *[F.col(f"c.{x}").alias(f"{x}s") for x in ("cum", "n", "token", "known")]))
    blocks = cut_lineage(blocks)
    heads = (blocks.groupBy("_prev").agg(F.sort_array(F.collect_list(F.struct("_block", F.element_at("cums", -1).alias("end")))).alias("e"))
             .select(F.col("_prev").alias("_head"), F.col("e.end").alias("_ends")))
    return cut_lineage(heads), blocks


def draw_indexed(live: DataFrame, heads: DataFrame, blocks: DataFrame, prompt_id: str, seed: int, salt: str) -> DataFrame:
    """W4 for live rows (prompt_id, prev, times): the draw of ``sampling.draw`` over the candidates of ``prev``, each
    ``times`` times, without a row per prompt and candidate: the run that the draw falls in is found in the context's
    head, the candidate in the run."""
    at = live.join(heads, live["prev"] == heads["_head"]).drop("_head")
    x = rand.uniform(seed, salt, prompt_id) * (F.element_at("_ends", -1) * F.col("times"))
    at = with_computed(at, {"_x": x})
    at = with_computed(at, {"_at": _places_up_to(F.col("_ends"), F.col("_x"), F.col("times"))}).drop("_ends")
    hit = at.join(blocks, (at["prev"] == blocks["_prev"]) & (at["_at"] == blocks["_block"]))
    hit = with_computed(hit, {"_k": _places_up_to(F.col("cums"), F.col("_x"), F.col("times"))})
    return hit.select(prompt_id, F.get("tokens", F.col("_k")).alias("token"), F.get("knowns", F.col("_k")).alias("known"))


def generate(prompts: DataFrame, counts: DataFrame, prompt_id: str, last: str, eos: str,
             top_p: float = 0.95, max_steps: int = 64, seed: int = 0, banned: list | None = None,
             checkpoint_every: int = 1) -> DataFrame:
    """Draw tokens for every prompt at once until each row has produced ``eos`` or
    ``max_steps`` tokens.  Each step looks the draws of the live rows up in an index of the nucleus-filtered bigram
    table (``draw_index``); finished rows leave the loop.  A word that is no context of the model
    backs off to the beginning-of-text context, so every prompt is continued.  Rows of one ``prompt_id`` draw one
    token from their joint candidates.  The drawn rows are written every ``checkpoint_every`` steps; steps between
    are computed again by each that follows."""
    kept = SM.top_p(counts, ["prev"], "token", "n", top_p, banned=banned).select("prev", "token", "n", "rank")
    up_to = Window.partitionBy("prev").orderBy(F.col("n").desc(), F.col("token").asc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = cut_lineage(kept.withColumn("cum", F.sum("n").over(up_to)))
    contexts = kept.select(F.col("prev").alias("_known")).distinct()
    heads, blocks = draw_index(kept.join(contexts, kept["token"] == contexts["_known"], "left")
                               .withColumn("known", F.col("_known").isNotNull()).drop("_known"))
    first = (prompts.select(prompt_id, F.col(last).alias("prev")).join(contexts, F.col("prev") == F.col("_known"), "left")
             .groupBy(prompt_id, F.coalesce("_known", F.lit(BOS)).alias("prev")).agg(F.count(F.lit(1)).alias("times")))
    first = cut_lineage(first.withColumn("_contexts", F.count(F.lit(1)).over(Window.partitionBy(prompt_id))))
    live = first.where("_contexts = 1").drop("_contexts")
    out_parts = []
    for step in range(max_steps):
        drawn = draw_indexed(live, heads, blocks, prompt_id, seed, f"gen{step}")
        if step == 0:       # prompts whose rows have several contexts: the draw over all their candidates
            several = (first.where("_contexts > 1").join(blocks, F.col("prev") == F.col("_prev"))
                       .select(prompt_id, "times", F.inline(F.arrays_zip(F.col("tokens").alias("token"), F.col("ns").alias("n"), F.col("knowns").alias("known"))))
                       .select(prompt_id, "token", "n", "known", F.explode(F.sequence(F.lit(1), F.col("times")))))
            drawn = drawn.unionByName(SM.draw(several, [prompt_id], "token", "n", seed, salt="gen0").select(prompt_id, "token", "known"))
        drawn = drawn.withColumn("step", F.lit(step))
        if (step + 1) % checkpoint_every == 0:
            drawn = cut_lineage(drawn)
        out_parts.append(drawn.select(prompt_id, "step", "token"))
        live = drawn.where(F.col("token") != eos).select(
            prompt_id, F.when(F.col("known"), F.col("token")).otherwise(F.lit(BOS)).alias("prev"), F.lit(1).cast("long").alias("times"))
        if (step + 1) % checkpoint_every == 0 and live.isEmpty():
            break
    allgen = out_parts[0]
    for p in out_parts[1:]:
        allgen = allgen.unionByName(p)
    return allgen.groupBy(prompt_id).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("step", "token"))), lambda s: s["token"]).alias("generated"))
