"""Rows that share a doc_id, or have none, each get a decision of their own in the pipeline's stages."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from newsloom.llm import decontaminate, quality_classifier
from newsloom.session import table_scope
from tests.conftest import SF_SMALL


def _left(spark, stage, rows):
    """(doc_id, text) counts after the stage."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    own = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    blank = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("doc_id", "text") else F.col(f.name) for f in docs.schema]
    out = stage(spark, own.select(*blank), SF_SMALL)
    assert out.columns == docs.columns
    return Counter((r.doc_id, r.text) for r in out.collect())


def _text(seed, n=60):
    return " ".join(f"w{k}" for k in np.random.default_rng(seed).integers(0, 10**6, n))


def test_rules_decide_by_row(spark):
    good = _text(1)
    assert _left(spark, P.rules, [(None, good), (None, "short"), (None, None), (3, good + " x"), (3, "too short")]) == Counter(
        [(None, good), (3, good + " x")])


def test_classifier_decides_by_row(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    predicted = {r.doc_id: r.predicted for r in quality_classifier.classify(docs, labels).collect()}
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    good, bad = (next(t for i, t in rows if predicted[i] == y) for y in (1, 0))
    more = [(None, good), (None, bad), (10**6, good), (10**6, bad)]
    assert _left(spark, P.classifier, rows + more) == Counter([(i, t) for i, t in rows if predicted[i]] + [(None, good), (10**6, good)])


def test_one_row_of_each_group_stays(spark):
    t, u, v, w, x = (_text(k, 300) for k in range(5))
    rows = [(5, t), (5, t), (None, t), (None, t + " end"), (6, t + " more"), (None, u), (None, u), (None, "end " + u), (9, v), (9, w), (4, w), (None, x)]
    got = _left(spark, P.near_duplicates, rows)
    assert {k: n for k, n in got.items() if k[1] != u and k[1] != "end " + u} == {(5, t): 1, (9, v): 1, (4, w): 1, (None, x): 1}
    assert sum(got.values()) == 5


def test_contaminated_rows_go_whatever_their_id(spark):
    item = next(r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect() if len(decontaminate.alnum_words(r.text.encode())) >= 10)
    clean = _text(2)
    assert _left(spark, P.decontamination, [(None, clean), (None, clean + " " + item), (7, clean), (7, item), (8, item)]) == Counter(
        [(None, clean), (7, clean)])


def test_row_keys_write_no_copy_of_a_parquet_table(spark, tmp_path):
    spark.range(300).selectExpr("id as doc_id", "repeat(cast(id as string), 9) as text").repartition(3).write.parquet(f"{tmp_path}/a b")
    with table_scope() as written:
        docs = spark.read.parquet(f"{tmp_path}/a b")
        one, two = (P._keyed(docs).select("doc_id", P.ROW) for _ in range(2))
        assert not written
        keys = {r.doc_id: r[P.ROW] for r in one.collect()}
        assert keys == {r.doc_id: r[P.ROW] for r in two.where("doc_id >= 0").repartition(2).collect()}
        assert len(set(keys.values())) == len(keys) == 300
        # rows that share a place in a file, or are not from one, get a written key
        for several in (spark.read.parquet(f"{tmp_path}/a b", f"{tmp_path}/a b"), docs.crossJoin(spark.range(2).select("id")), spark.range(600)):
            assert P._keyed(several).select(P.ROW).distinct().count() == 600
        assert len(written) == 3
