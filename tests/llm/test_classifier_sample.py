"""The classifier's sample: the same whatever the partitions are, one text an id."""

from pyspark.sql import functions as F

from newsloom.llm import quality_classifier


def test_scores_do_not_depend_on_partitions(spark):
    rows = [(i, f"{'good plain prose' if i % 2 else 'buy cheap pills'} word{i % 17} word{i % 5} {i}") for i in range(400)]
    rows += [(7, "a second text of the id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")

    def scores(d, y):
        return sorted((r["doc_id"], round(r["score"], 6)) for r in
                      quality_classifier.classify(d, y, fit_rows=60).select("doc_id", "score").collect())

    first = scores(docs.coalesce(1), labels.coalesce(1))
    assert first == scores(docs.repartition(7, F.col("text")), labels.repartition(5).orderBy(F.desc("doc_id")))
