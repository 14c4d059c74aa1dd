"""Evaluation: class pairing and balance, accuracy, paired/unpaired accuracy, weighted metrics,
perplexity (J2, J3, J5, U2, U3, F21, P21-P23, A3-A10, W6, W7, W9, Q12).

Row order of the original (lists, positional score matrices) is an explicit column here; global
numbering uses partition offsets (``with_row_index``), never a single-partition window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import fixed
from newsloom.session import cut_lineage
from newsloom.sources.readers import with_row_index


def argmax_label(machine: str = "machine", human: str = "human") -> Column:
    """The larger column names the label; ties go to the first column (machine)."""
    return F.when(F.col(machine) >= F.col(human), F.lit("machine")).otherwise(F.lit("human"))


def attach_scores(examples: DataFrame, scores: DataFrame, key: str = "raw_index") -> DataFrame:
    """S7 + J3: scores belong to examples by position.  Inner equi-join on the explicit position, with
    both counts checked equal (the original asserts the shapes agree)."""
    n_ex = examples.select(F.count(F.lit(1))).scalar()
    n_sc = scores.select(F.count(F.lit(1))).scalar()
    joined = examples.join(scores, key, "inner")
    # a filter (not a dropped column) so the optimizer keeps the check
    return joined.where(F.when(n_ex == n_sc, F.lit(True)).otherwise(
        F.raise_error(F.lit("score rows and example rows differ in number")).cast("boolean")))


def accuracy(df: DataFrame, label: str = "label", pred: Column | None = None, by: list[str] | None = None,
             name: str = "accuracy") -> DataFrame:
    """A4 (+ A9 with ``by``): mean(prediction == label) per group."""
    pred = argmax_label() if pred is None else pred
    hit = (pred == F.col(label)).cast("double")
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(F.avg(hit).alias(name))


def paired_accuracy(scores: DataFrame, by: list[str] | None = None, label: str = "label",
                    pair: str = "ind30k", group: str = "orig_split") -> DataFrame:
    """A5 + A6 (+ J2, U2): paired accuracy -- a machine article beats its human pair on the
    machine score (a missing pair counts as wrong); unpaired accuracy -- argmax accuracy over
    burner humans plus the machine articles.  One row per ``by`` group (every split, X14)."""
    by = by or []
    gen = scores.where(F.col(group) == "gen")
    mach = gen.where(F.col(label) == "machine").select(*by, pair, "machine", "human", label)
    hum = gen.where(F.col(label) == "human").select(*by, pair, F.col("machine").alias("machine_humanpair"))
    joined = mach.join(hum, by + [pair], "left")
    right = F.coalesce((F.col("machine") > F.col("machine_humanpair"))
                       & ~F.isnan("machine") & ~F.isnan("machine_humanpair"), F.lit(False))
    paired = joined.groupBy(*by).agg(F.avg(right.cast("double")).alias("paired_acc"))
    burners = scores.where(F.col(group) == "train_burner").select(*by, "machine", "human", label)
    combined = burners.unionByName(mach.select(*by, "machine", "human", label))
    unpaired = accuracy(combined, label, by=by, name="unpaired_acc")
    if not by:  # one row each: join on a constant key (no cartesian product in the plan)
        return paired.withColumn("_all", F.lit(1)).join(unpaired.withColumn("_all", F.lit(1)), "_all").drop("_all")
    return paired.join(unpaired, by, "full")


def balance_pairs(train: DataFrame, order: str, cap: int | None = None, extra: DataFrame | None = None,
                  label: str = "label") -> DataFrame:
    """F21 + U3 + J5: cap the machine class to its first ``cap`` rows, top it up from ``extra``
    machine rows (up to the number of humans), then pair human i with machine (i mod n) and
    interleave them: positions 2i (human), 2i+1 (machine)."""
    # numbered class lists are read by counts and joins below: materialise them once
    humans = cut_lineage(with_row_index(train.where(F.col(label) == "human"), [order], "i"))
    machines = cut_lineage(with_row_index(train.where(F.col(label) == "machine"), [order], "j"))
    if cap is not None:
        machines = machines.where(F.col("j") < cap)
    if extra is not None:
        n_h = humans.select(F.count(F.lit(1))).scalar()
        n_m = machines.select(F.count(F.lit(1))).scalar()
        add = with_row_index(extra.where(F.col(label) == "machine"), [order], "_k")
        add = add.where(F.col("_k") < F.greatest(n_h - n_m, F.lit(0)))
        machines = machines.unionByName(add.withColumn("j", F.col("_k") + n_m).drop("_k"), allowMissingColumns=True)
    n = machines.select(F.count(F.lit(1))).scalar()
    paired_m = humans.select("i", F.pmod(F.col("i"), n).alias("j")).join(machines, "j")
    out_h = humans.withColumn("pos", F.col("i") * 2)
    out_m = paired_m.withColumn("pos", F.col("i") * 2 + 1)
    return out_h.drop("i").unionByName(out_m.drop("i", "j"), allowMissingColumns=True).drop("j")


def weighted_metrics(df: DataFrame, label_id: str = "label_id", pred_id: str = "pred_id",
                     loss: str = "loss", weight: str = "is_real_example", by: list[str] | None = None) -> DataFrame:
    """Accuracy and mean loss weighted by ``is_real_example``."""
    w = F.col(weight).cast("double")
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg((F.sum(w * (F.col(label_id) == F.col(pred_id)).cast("double")) / F.sum(w)).alias("accuracy"),
                 (F.sum(w * F.col(loss)) / F.sum(w)).alias("loss"))


def masked_mean_loss(df: DataFrame, loss: str = "loss", target: str = "target", pad: int = 0,
                     by: list[str] | None = None) -> DataFrame:
    """P23 + A7: sum(w * loss) / (sum(w) + 1e-5) with w = (target != pad)."""
    w = (F.col(target) != pad).cast("double")
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg((F.sum(w * F.col(loss)) / (F.sum(w) + F.lit(fixed.LOSS_EPSILON))).alias("mean_loss"))


def token_position(ids: str, target: int, first: bool = True, default: int = -1) -> Column:
    """W6 + W10 on an array: 0-based index of the first (last) occurrence, else ``default``."""
    c = F.col(ids)
    if first:
        p = F.array_position(c, F.lit(target))
        return F.when(p > 0, p - 1).otherwise(F.lit(default))
    rp = F.array_position(F.reverse(c), F.lit(target))
    return F.when(rp > 0, F.size(c) - rp).otherwise(F.lit(default))


def perplexity(scores: DataFrame, begin: int, end: int, doc: str = "doc_id", pos: str = "pos",
               token: str = "token", logprob: str = "gt_logprob", by: list[str] | None = None) -> DataFrame:
    """W6 + A3 on a long score table (doc, pos, token = the input token at pos, gt_logprob = the
    log-probability of the next token).  Per document the slice is [first begin, first end) with
    defaults 0 and the last position (X19); perplexity = exp(-mean) over all kept positions of all
    documents (token weighted)."""
    by = by or []
    bounds = scores.groupBy(doc).agg(
        F.coalesce(F.min(F.when(F.col(token) == begin, F.col(pos))), F.lit(0)).alias("_b"),
        F.coalesce(F.min(F.when(F.col(token) == end, F.col(pos))), F.max(pos)).alias("_e"))
    kept = scores.join(bounds, doc).where((F.col(pos) >= F.col("_b")) & (F.col(pos) < F.col("_e")))
    g = kept.groupBy(*by) if by else kept.groupBy()
    return g.agg(F.exp(-F.avg(logprob)).alias("perplexity"), F.count(F.lit(1)).alias("n_tokens"))


def extract_target(ids: str, begin_id: int, end_id: int) -> tuple[Column, Column, Column]:
    """(start, end, ids[start:end]); start = first begin + 1 else 0; end = first end else len."""
    c = F.col(ids)
    b = F.array_position(c, F.lit(begin_id))
    e = F.array_position(c, F.lit(end_id))
    start = F.when(b > 0, b).otherwise(F.lit(0))          # 0-based index after the begin token
    stop = F.when(e > 0, e - 1).otherwise(F.size(c))
    return start, stop, F.slice(c, start + 1, F.greatest(stop - start, F.lit(0)))


def completion_rows(spark, n_real: int | Column, batch: int, size: int, intent: bool = True) -> DataFrame:
    """Q12: all-zero rows with is_real_example = 0 so the example count fills the last batch
    (``pmod(-n, batch)`` rows; the original adds ``n % batch``, quirk X8, with ``intent=False``)."""
    k = F.pmod(-F.lit(n_real) if not isinstance(n_real, Column) else -n_real, F.lit(batch)) if intent \
        else F.pmod(F.lit(n_real) if not isinstance(n_real, Column) else n_real, F.lit(batch))
    k = k.cast("long")
    seq = F.when(k > 0, F.sequence(F.lit(0).cast("long"), k - 1)).otherwise(F.array().cast("array<bigint>"))
    base = spark.range(1).select(F.explode(seq).alias("pad_index"))
    return base.select("pad_index", F.array_repeat(F.lit(0), size).alias("input_ids"),
                       F.lit(0).alias("label_id"), F.lit(0).alias("is_real_example"))


def shift_targets(df: DataFrame, ids: str = "input_ids", pad: int = 0, extend: bool = False) -> DataFrame:
    """P22 + P23: language-model inputs and targets from one id sequence: input = ids[:-1],
    target = ids[1:] (or, with ``extend``, input = ids and target = ids[1:] + [pad]); ``weight`` =
    1 where the target is not padding."""
    c = F.col(ids)
    n = F.size(c)
    if extend:
        inp, tgt = c, F.concat(F.slice(c, 2, F.greatest(n - 1, F.lit(0))), F.array(F.lit(pad)))
    else:
        inp = F.slice(c, 1, F.greatest(n - 1, F.lit(0)))
        tgt = F.slice(c, 2, F.greatest(n - 1, F.lit(0)))
    return df.withColumns({"inputs": inp, "targets": tgt,
                           "weights": F.transform(tgt, lambda t: (t != pad).cast("int"))})
