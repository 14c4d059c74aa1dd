"""Every hash/quantile-based operator gives the same answer on 1 and on 8 partitions."""

from pyspark.sql import functions as F

from newsloom.operators import merge as M, sampling as SM, sequences as Q
from newsloom.sources.readers import with_row_index


def _rows(df, cols):
    return sorted(tuple(r[c] if not isinstance(r[c], list) else tuple(r[c]) for c in cols) for r in df.collect())


def _pieces(spark):
    df = spark.range(0, 120).select(
        F.col("id").alias("doc_id"),
        F.array(F.lit(1), F.col("id").cast("int"), F.lit(2)).alias("p_domain"),
        F.array(F.lit(3), F.col("id").cast("int"), F.lit(4)).alias("p_title"),
        F.concat(F.array(F.lit(5)), F.sequence(F.lit(10), (F.col("id") % 40 + 10).cast("int")), F.array(F.lit(6))).alias("p_article"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit(7), F.lit(8))).alias("p_summary"),
        F.lit(None).cast("array<int>").alias("p_date"), F.lit(None).cast("array<int>").alias("p_authors"))
    return df


def test_operators_ignore_partitioning(spark):
    base = _pieces(spark)
    outs = []
    for df in (base.coalesce(1), base.repartition(8)):
        lay = Q.layout_fields(df, "doc_id", size=24, seed=3)
        lay = M.assign_split(with_row_index(lay, ["doc_id"], "line"), "doc_id")
        folded = Q.assign_folds(lay, "line", 3)
        seqs = Q.build_sequences(folded, size=24, seed=9)
        cands = df.select((F.col("doc_id") % 5).alias("c"), F.col("doc_id").cast("string").alias("t"),
                          (F.col("doc_id") % 7 + 1).alias("w"))
        drawn = SM.draw(SM.top_p(cands, ["c"], "t", "w", 0.8).drop("rank"), ["c"], "t", "w", seed=2)
        outs.append((_rows(seqs, ["fold", "split", "inst_index", "sub_index", "input_ids"]),
                     _rows(drawn, ["c", "t"])))
    assert outs[0] == outs[1]
    assert all(len(r[-1]) == 24 for r in outs[0][0])
