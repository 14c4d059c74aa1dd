"""Candidate-set operators over a long table ``(ctx, token, weight)``.

A "context" is whatever the scores are conditioned on (a prefix, a user, a document position).
A window partitioned by context sorts all its candidates in one task: at most one vocabulary's worth
of rows for a fixed vocabulary, but a number that grows with the corpus where the tokens are open words.

Weights may be unnormalised (e.g. counts): thresholds are scaled by the context total, which keeps
integer weights exact (no floating running sums compared against ``p``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import fixed, rand


def _order(ctx: list[str], weight: str, token: str):
    return Window.partitionBy(*ctx).orderBy(F.col(weight).desc(), F.col(token).asc())


def softmax(df: DataFrame, ctx: list[str], logit: str, name: str = "prob", log: bool = False) -> DataFrame:
    """Softmax (or log-softmax) of ``logit`` across the candidates of each context."""
    w = Window.partitionBy(*ctx)
    shifted = F.col(logit) - F.max(logit).over(w)
    if log:
        return df.withColumn(name, shifted - F.log(F.sum(F.exp(shifted)).over(w)))
    return df.withColumn(name, F.exp(shifted) / F.sum(F.exp(shifted)).over(w))


def top_p(df: DataFrame, ctx: list[str], token: str, weight: str, p: float,
          include_crossing: bool = False, banned: list | None = None) -> DataFrame:
    """Nucleus set.  Sort by weight desc (then token), keep candidates whose *inclusive*
    running share is < p, and always the first (X10: the candidate that crosses p is dropped
    unless ``include_crossing``).  ``banned`` ids are removed first (X11 intent).
    ``p > 0.999999`` keeps every candidate."""
    if banned:
        df = df.where(~F.col(token).isin(banned))
    if p > fixed.TOP_P_DISABLE:
        return df.withColumn("rank", F.row_number().over(_order(ctx, weight, token)))
    o = _order(ctx, weight, token)
    run = o.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum(weight).over(Window.partitionBy(*ctx))
    cum = F.sum(weight).over(run)
    prev = cum - F.col(weight)
    out = df.withColumns({"rank": F.row_number().over(o), "_cum": cum, "_prev": prev, "_tot": total})
    keep = (F.col("_prev") < F.lit(p) * F.col("_tot")) if include_crossing else (F.col("_cum") < F.lit(p) * F.col("_tot"))
    return out.where(keep | (F.col("rank") == 1)).drop("_cum", "_prev", "_tot")


def top_k(df: DataFrame, ctx: list[str], token: str, weight: str, k: int, banned: list | None = None) -> DataFrame:
    """The k best candidates per context (ties broken by token)."""
    if banned:
        df = df.where(~F.col(token).isin(banned))
    return df.withColumn("rank", F.row_number().over(_order(ctx, weight, token))).where(F.col("rank") <= k)


def mass_above(df: DataFrame, ctx: list[str], weight: str, name: str = "mass_above") -> DataFrame:
    """W3 building block: per candidate, the share of the context's weight held by candidates
    strictly better than it (ties excluded)."""
    w_ctx = Window.partitionBy(*ctx)
    ge = F.sum(weight).over(Window.partitionBy(*ctx).orderBy(F.col(weight).desc())
                            .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    peers = F.sum(weight).over(Window.partitionBy(*ctx, weight))
    return df.withColumn(name, (ge - peers) / F.sum(weight).over(w_ctx))


def top_p_required(targets: DataFrame, cands: DataFrame, ctx: list[str], token: str, weight: str,
                   name: str = "top_p_required") -> DataFrame:
    """For every target row (ctx, token), the total probability of candidates strictly better
    than the true token.  One equi-join of the targets with the per-candidate table."""
    per = mass_above(cands, ctx, weight, name).select(*ctx, token, name)
    return targets.join(per, ctx + [token], "left").withColumn(name, F.coalesce(F.col(name), F.lit(1.0)))


def draw(kept: DataFrame, ctx: list[str], token: str, weight: str, seed: int, salt: str = "draw",
         draw_key: Column | None = None) -> DataFrame:
    """One weighted draw per context from its kept set (inverse CDF on a hash-uniform u,
    so the draw is reproducible and partition independent)."""
    o = _order(ctx, weight, token)
    cum = F.sum(weight).over(o.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum(weight).over(Window.partitionBy(*ctx))
    u = rand.uniform(seed, salt, *ctx) if draw_key is None else rand.uniform(seed, salt, draw_key)
    marked = kept.withColumns({"_cum": cum, "_tot": total, "_u": u})
    hit = marked.where(F.col("_cum") > F.col("_u") * F.col("_tot"))
    first = F.row_number().over(_order(ctx, weight, token))
    return hit.withColumn("_r", first).where(F.col("_r") == 1).drop("_cum", "_tot", "_u", "_r")
