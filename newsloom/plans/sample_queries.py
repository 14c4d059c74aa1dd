"""Registered queries of the sampling and language-model operators, each with its DuckDB oracle.

Candidate tables come from the data: per user, the event types weighted by their counts
(``events``); per context word, the next-word counts of ``documents`` (the n-gram model M1),
scored on the held-out ``benchmark`` texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import evaluate as E, models as MD, sampling as SM
from newsloom.plans import common as K, sqltext as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _cands(spark: SparkSession, sf: str) -> DataFrame:
    ev = K.table(spark, sf, "events")
    return ev.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


CANDS = "(SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)"
RANKED = f"""(SELECT *, row_number() OVER w AS rank,
    sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
    sum(n) OVER (PARTITION BY user_id) AS tot
  FROM {CANDS} WINDOW w AS (PARTITION BY user_id ORDER BY n DESC, event_type))"""
TOP_P = 0.6


@register("sample_top_p", f"""
SELECT user_id, event_type, n, rank FROM {RANKED} WHERE cum < {TOP_P} * tot OR rank = 1""")
def sample_top_p(spark: SparkSession, sf: str) -> DataFrame:
    """Nucleus candidate sets (p = 0.6, crossing candidate dropped)."""
    return SM.top_p(_cands(spark, sf), ["user_id"], "event_type", "n", TOP_P)


@register("sample_top_k", f"SELECT user_id, event_type, n, rank FROM {RANKED} WHERE rank <= 2")
def sample_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """Top-2 candidates per context."""
    return SM.top_k(_cands(spark, sf), ["user_id"], "event_type", "n", 2)


@register("sample_top_p_required", f"""
SELECT e.event_id, coalesce(c.above / c.tot, 1.0) AS top_p_required FROM events e LEFT JOIN
  (SELECT user_id, event_type, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY n DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
          - sum(n) OVER (PARTITION BY user_id, n) AS DOUBLE) AS above, sum(n) OVER (PARTITION BY user_id) AS tot FROM {CANDS}) c
  ON e.user_id = c.user_id AND e.event_type = c.event_type""")
def sample_top_p_required(spark: SparkSession, sf: str) -> DataFrame:
    """For every event, the probability mass of the user's event types strictly more likely
    than the observed one."""
    ev = K.table(spark, sf, "events").select("event_id", "user_id", "event_type")
    out = SM.top_p_required(ev, _cands(spark, sf), ["user_id"], "event_type", "n")
    return out.select("event_id", "top_p_required")


@register("sample_draw", f"""
SELECT user_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r2 FROM (
    SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY n DESC, event_type ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kc,
           sum(n) OVER (PARTITION BY user_id) AS kt
    FROM (SELECT user_id, event_type, n FROM {RANKED} WHERE cum < 0.9 * tot OR rank = 1))
  WHERE kc > {S.uniform(3, 'draw', 'user_id')} * kt) WHERE r2 = 1""")
def sample_draw(spark: SparkSession, sf: str) -> DataFrame:
    """W1 + W4: one seeded weighted draw per user from the p = 0.9 nucleus."""
    kept = SM.top_p(_cands(spark, sf), ["user_id"], "event_type", "n", 0.9).drop("rank")
    return SM.draw(kept, ["user_id"], "event_type", "n", seed=3).select("user_id", "event_type")


@register("sample_softmax", """
SELECT vec_id, label, round(exp(d) / sum(exp(d)) OVER (PARTITION BY label), 9) AS prob,
       round(d - ln(sum(exp(d)) OVER (PARTITION BY label)), 9) AS logprob
FROM (SELECT vec_id, label, x - max(x) OVER (PARTITION BY label) AS d
      FROM (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) * 10.0 AS x FROM embeddings))""")
def sample_softmax(spark: SparkSession, sf: str) -> DataFrame:
    """Softmax and log-softmax across the candidates of each context (label)."""
    emb = K.table(spark, sf, "embeddings").select(
        "vec_id", "label", (F.col("embedding").getItem(0).cast("double") * 10.0).alias("x"))
    out = SM.softmax(emb, ["label"], "x", "prob")
    out = SM.softmax(out, ["label"], "x", "logprob", log=True)
    return out.select("vec_id", "label", F.round("prob", 9).alias("prob"), F.round("logprob", 9).alias("logprob"))


# ------------------------------------------------------------------------------ M1 n-gram LM
def _tok_sql(src: str, doc: str) -> str:
    return f"""(SELECT {doc}, pos - 1 AS pos, CASE WHEN pos = 1 THEN '{MD.BOS}' ELSE toks[pos - 1] END AS prev, toks[pos] AS token
      FROM (SELECT {doc}, toks, generate_subscripts(toks, 1) AS pos FROM
            (SELECT {doc}, regexp_extract_all(text, {S.q(MD.WORD_PATTERN)}) AS toks FROM {src})))"""


TRAIN_TOK = _tok_sql("documents", "doc_id")
TEST_TOK = _tok_sql("benchmark", "item_id")
COUNTS = f"(SELECT prev, token, count(*) AS n FROM {TRAIN_TOK} GROUP BY ALL)"
SCORED = f"""(SELECT t.item_id, t.pos, t.prev, t.token, coalesce(c.n, 0) AS n, coalesce(x.n_ctx, 0) AS n_ctx,
    ln((coalesce(c.n, 0) + 1.0) / (coalesce(x.n_ctx, 0) + 1.0 * (SELECT count(DISTINCT token) + 1 FROM {COUNTS}))) AS gt_logprob
  FROM {TEST_TOK} t LEFT JOIN {COUNTS} c ON t.prev = c.prev AND t.token = c.token
  LEFT JOIN (SELECT prev, sum(n) AS n_ctx FROM {COUNTS} GROUP BY prev) x ON t.prev = x.prev)"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    train = MD.word_tokens(K.table(spark, sf, "documents"), "text", "doc_id")
    test = MD.word_tokens(K.table(spark, sf, "benchmark"), "text", "item_id")
    return MD.ngram_score(test, MD.ngram_fit(train))


@register("lm_perplexity", f"""
SELECT item_id, round(exp(-avg(gt_logprob)), 6) AS perplexity, count(*) AS n_tokens FROM {SCORED} GROUP BY item_id""")
def lm_perplexity(spark: SparkSession, sf: str) -> DataFrame:
    """M1 + A3: per held-out text, perplexity under the bigram model of the corpus."""
    return _scored(spark, sf).groupBy("item_id").agg(F.round(F.exp(-F.avg("gt_logprob")), 6).alias("perplexity"),
                                                     F.count(F.lit(1)).alias("n_tokens"))


@register("lm_corpus_perplexity", f"""
SELECT round(exp(-avg(gt_logprob)), 6) AS perplexity, count(*) AS n_tokens,
       round(sum(-gt_logprob) / (count(*) + 1e-5), 9) AS mean_loss FROM {SCORED}""")
def lm_corpus_perplexity(spark: SparkSession, sf: str) -> DataFrame:
    """M1 + A3 (token weighted over all texts) + P23 + A7 (masked mean loss, every target real)."""
    sc = _scored(spark, sf).withColumn("loss", -F.col("gt_logprob")).withColumn("target", F.lit(1))
    ppl = sc.agg(F.exp(-F.avg("gt_logprob")).alias("perplexity"), F.count(F.lit(1)).alias("n_tokens"))
    ml = E.masked_mean_loss(sc)
    out = ppl.withColumn("_k", F.lit(1)).join(ml.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return out.select(F.round("perplexity", 6).alias("perplexity"), "n_tokens", F.round("mean_loss", 9).alias("mean_loss"))


@register("lm_predict", f"""
WITH c AS {COUNTS},
best AS (SELECT prev, token AS prediction, n AS nbest FROM (
    SELECT *, row_number() OVER (PARTITION BY prev ORDER BY n DESC, token) AS r FROM c) WHERE r = 1),
req AS (SELECT prev, token, CAST(sum(n) OVER (PARTITION BY prev ORDER BY n DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
          - sum(n) OVER (PARTITION BY prev, n) AS DOUBLE) / sum(n) OVER (PARTITION BY prev) AS top_p_required FROM c)
SELECT s.item_id, s.pos, s.token, round(s.gt_logprob, 9) AS gt_logprob, b.prediction,
  round(ln((coalesce(b.nbest, 0) + 1.0) / (s.n_ctx + 1.0 * (SELECT count(DISTINCT token) + 1 FROM c))), 9) AS pred_logprob,
  round(coalesce(r.top_p_required, CASE WHEN s.n_ctx > 0 THEN 1.0 ELSE 0.0 END), 9) AS top_p_required
FROM {SCORED} s LEFT JOIN best b ON s.prev = b.prev LEFT JOIN req r ON s.prev = r.prev AND s.token = r.token""")
def lm_predict(spark: SparkSession, sf: str) -> DataFrame:
    """M1 predictor outputs per position: gt_logprob, prediction, pred_logprob, top_p_required."""
    train = MD.word_tokens(K.table(spark, sf, "documents"), "text", "doc_id")
    test = MD.word_tokens(K.table(spark, sf, "benchmark"), "text", "item_id")
    out = MD.ngram_predict(test, MD.ngram_fit(train))
    return out.select("item_id", "pos", "token", F.round("gt_logprob", 9).alias("gt_logprob"), "prediction",
                      F.round("pred_logprob", 9).alias("pred_logprob"), F.round("top_p_required", 9).alias("top_p_required"))
