"""Registered queries: ``registry()`` -> ({name: spark_fn}, {name: oracle_sql})."""

from __future__ import annotations


def registry():
    from newsloom.plans import (corpus_queries, eval_queries, io_queries, sample_queries, stream_queries,
                                token_queries)
    queries, oracles = {}, {}
    for m in (corpus_queries, eval_queries, token_queries, sample_queries, stream_queries, io_queries):
        queries.update(m.QUERIES)
        oracles.update(m.ORACLES)
    return queries, oracles
