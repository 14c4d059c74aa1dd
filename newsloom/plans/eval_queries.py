"""Registered queries of the evaluation stage (labels + documents), each with its DuckDB oracle.

The classification examples come from ``labels`` joined to ``documents``: quality 1 = human,
0 = machine.  Class scores are hash-derived stand-ins for a classifier's output (M2 trains a real
one); they make every metric exactly checkable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import fixed, rand
from newsloom.operators import evaluate as E
from newsloom.plans import common as K, sqltext as S
from newsloom.session import cut_lineage
from newsloom.sources.readers import with_row_index

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def examples(spark: SparkSession, sf: str) -> DataFrame:
    lab = K.table(spark, sf, "labels")
    docs = K.table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    ex = lab.join(docs, "doc_id")
    u = rand.uniform(7, "evalsplit", "doc_id")
    return ex.withColumns({
        "label": F.when(F.col("quality") == 1, "human").otherwise("machine"),
        "split": F.when(u < 0.5, "train").when(u < 0.75, "val").otherwise("test"),
    })


EX_SQL = f"""(SELECT l.*, d.source, d.n_chars,
    CASE WHEN l.quality = 1 THEN 'human' ELSE 'machine' END AS label,
    CASE WHEN {S.uniform(7, 'evalsplit', 'l.doc_id')} < 0.5 THEN 'train'
         WHEN {S.uniform(7, 'evalsplit', 'l.doc_id')} < 0.75 THEN 'val' ELSE 'test' END AS split
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Score table: raw_index (position, W9), orig_split/ind30k pairing, machine/human scores."""
    ex = examples(spark, sf)
    ex = with_row_index(ex, ["doc_id"], "raw_index")
    numbered = with_row_index(ex, ["doc_id"], "k", partition_by=["split", "label"])
    n_mach = ex.where(F.col("label") == "machine").groupBy("split").agg(F.count(F.lit(1)).alias("n_m"))
    numbered = numbered.join(n_mach, "split", "left").fillna(0, ["n_m"])
    gen = (F.col("label") == "machine") | (F.col("k") < F.col("n_m"))
    u = rand.uniform(1, "score", "doc_id")
    machine = F.when(F.col("label") == "machine", F.lit(0.35) + F.lit(0.65) * u).otherwise(F.lit(0.75) * u)
    # the score table is an artifact (the original writes it to a file): materialise it once
    return cut_lineage(numbered.select(
        "raw_index", "doc_id", "split", "label",
        F.when(gen, "gen").otherwise("train_burner").alias("orig_split"),
        F.when(gen, F.col("k")).alias("ind30k"),
        machine.alias("machine"), (F.lit(1.0) - machine).alias("human")))


SC_SQL = f"""(SELECT (row_number() OVER (ORDER BY doc_id) - 1) AS raw_index, doc_id, split, label,
    CASE WHEN label = 'machine' OR k < n_m THEN 'gen' ELSE 'train_burner' END AS orig_split,
    CASE WHEN label = 'machine' OR k < n_m THEN k END AS ind30k,
    m AS machine, 1.0 - m AS human
  FROM (SELECT e.*, row_number() OVER (PARTITION BY split, label ORDER BY doc_id) - 1 AS k,
          coalesce((SELECT count(*) FROM {EX_SQL} x WHERE x.split = e.split AND x.label = 'machine'), 0) AS n_m,
          CASE WHEN label = 'machine' THEN 0.35 + 0.65 * {S.uniform(1, 'score', 'doc_id')}
               ELSE 0.75 * {S.uniform(1, 'score', 'doc_id')} END AS m
        FROM {EX_SQL} e))"""


@register("eval_scores", f"SELECT * FROM {SC_SQL}")
def eval_scores(spark: SparkSession, sf: str) -> DataFrame:
    """W9 + J3: example positions, pair keys and class scores."""
    return scores(spark, sf)


ARGMAX = "CASE WHEN machine >= human THEN 'machine' ELSE 'human' END"


@register("eval_accuracy", f"""
SELECT split, avg(CASE WHEN {ARGMAX} = label THEN 1.0 ELSE 0.0 END) AS accuracy FROM {SC_SQL} GROUP BY split""")
def eval_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """P21 + A4: argmax accuracy per split."""
    return E.accuracy(scores(spark, sf), by=["split"])


@register("eval_paired", f"""
WITH s AS {SC_SQL},
m AS (SELECT * FROM s WHERE orig_split = 'gen' AND label = 'machine'),
h AS (SELECT split, ind30k, machine AS machine_humanpair FROM s WHERE orig_split = 'gen' AND label = 'human'),
p AS (SELECT m.split, avg(CASE WHEN coalesce(m.machine > h.machine_humanpair AND NOT isnan(m.machine)
                                   AND NOT isnan(h.machine_humanpair), false) THEN 1.0 ELSE 0.0 END) AS paired_acc
      FROM m LEFT JOIN h ON m.split = h.split AND m.ind30k = h.ind30k GROUP BY m.split),
c AS (SELECT split, machine, human, label FROM s WHERE orig_split = 'train_burner'
      UNION ALL SELECT split, machine, human, label FROM m),
u AS (SELECT split, avg(CASE WHEN {ARGMAX} = label THEN 1.0 ELSE 0.0 END) AS unpaired_acc FROM c GROUP BY split)
SELECT coalesce(p.split, u.split) AS split, paired_acc, unpaired_acc FROM p FULL JOIN u ON p.split = u.split""")
def eval_paired(spark: SparkSession, sf: str) -> DataFrame:
    """J2 + A5 + U2 + A6: paired and unpaired accuracy, for every split present."""
    return E.paired_accuracy(scores(spark, sf), by=["split"])


@register("eval_class_counts", f"""
SELECT split, label, orig_split, count(*) AS n FROM {SC_SQL} GROUP BY ALL""")
def eval_class_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A9 + A10: examples per split, label and origin."""
    return scores(spark, sf).groupBy("split", "label", "orig_split").agg(F.count(F.lit(1)).alias("n"))


BAL_CAP = 20


@register("eval_balance", f"""
WITH t AS (SELECT * FROM {EX_SQL} WHERE split = 'train' AND toxic = 0),
x AS (SELECT * FROM {EX_SQL} WHERE split = 'train' AND toxic = 1 AND label = 'machine'),
h AS (SELECT doc_id, label, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM t WHERE label = 'human'),
m0 AS (SELECT doc_id, label, row_number() OVER (ORDER BY doc_id) - 1 AS j FROM t WHERE label = 'machine'),
xa AS (SELECT doc_id, label, row_number() OVER (ORDER BY doc_id) - 1 AS kx FROM x),
c AS (SELECT least(count(*), {BAL_CAP}) AS n_keep FROM m0),
nh AS (SELECT count(*) AS n_h FROM h),
m AS (SELECT doc_id, label, j FROM m0 WHERE j < {BAL_CAP} UNION ALL
      SELECT xa.doc_id, xa.label, xa.kx + c.n_keep AS j FROM xa, c, nh WHERE xa.kx < greatest(nh.n_h - c.n_keep, 0)),
nm AS (SELECT count(*) AS n FROM m)
SELECT doc_id, label, 2 * i AS pos FROM h
UNION ALL
SELECT m.doc_id, m.label, 2 * h.i + 1 AS pos FROM h, nm, m WHERE m.j = h.i % nm.n""")
def eval_balance(spark: SparkSession, sf: str) -> DataFrame:
    """F21 + U3 + J5: cap the machine class, top it up from extra machine rows, pair cyclically,
    interleave human/machine."""
    ex = examples(spark, sf).where(F.col("split") == "train")
    main = ex.where(F.col("toxic") == 0).select("doc_id", "label")
    extra = ex.where(F.col("toxic") == 1).select("doc_id", "label")
    return E.balance_pairs(main, "doc_id", cap=BAL_CAP, extra=extra).select("doc_id", "label", "pos")


BATCH = 16


def _features(spark: SparkSession, sf: str) -> DataFrame:
    sc = scores(spark, sf)
    labels_list = F.array(*[F.lit(x) for x in fixed.CLASS_LABELS])
    true_p = F.when(F.col("label") == "machine", F.col("machine")).otherwise(F.col("human"))
    real = sc.select("split",
                     (F.array_position(labels_list, F.col("label")) - 1).cast("int").alias("label_id"),
                     (F.array_position(labels_list, E.argmax_label()) - 1).cast("int").alias("pred_id"),
                     (-F.log(true_p)).alias("loss"), F.lit(1).alias("is_real_example"))
    n = sc.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    k = F.pmod(-F.col("n"), F.lit(BATCH))
    pads = n.select("split", F.explode(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long")))
                                       .otherwise(F.array().cast("array<bigint>"))).alias("_p"))
    pads = pads.select("split", F.lit(0).alias("label_id"), F.lit(0).alias("pred_id"),
                       F.lit(0.0).alias("loss"), F.lit(0).alias("is_real_example"))
    return real.unionByName(pads)


@register("eval_weighted", f"""
WITH s AS {SC_SQL},
r AS (SELECT split, CASE WHEN label = 'machine' THEN 0 ELSE 1 END AS label_id,
             CASE WHEN {ARGMAX} = 'machine' THEN 0 ELSE 1 END AS pred_id,
             -ln(CASE WHEN label = 'machine' THEN machine ELSE human END) AS loss, 1 AS w FROM s),
n AS (SELECT split, count(*) AS n FROM s GROUP BY split),
p AS (SELECT split, 0 AS label_id, 0 AS pred_id, 0.0 AS loss, 0 AS w FROM n, range(((-n) % {BATCH} + {BATCH}) % {BATCH}))
SELECT split, round(sum(w * CASE WHEN label_id = pred_id THEN 1.0 ELSE 0.0 END) / sum(w), 9) AS accuracy,
       round(sum(w * loss) / sum(w), 9) AS loss, count(*) AS n_rows
FROM (SELECT * FROM r UNION ALL SELECT * FROM p) GROUP BY split""")
def eval_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """Q12 + A8: examples padded to full batches with is_real_example = 0, metrics weighted by it."""
    f = _features(spark, sf)
    m = E.weighted_metrics(f, by=["split"])
    m = m.select("split", F.round("accuracy", 9).alias("accuracy"), F.round("loss", 9).alias("loss"))
    return m.join(f.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows")), "split")
