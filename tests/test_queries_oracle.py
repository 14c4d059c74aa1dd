"""Registered queries against their DuckDB oracles (sf0.001 by default; set NEWSLOOM_FULL=1 to
check every query at sf0.01, as the driver does)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_CHECK, SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
FAST = ["crawl_url_filter", "crawl_extract", "crawl_domain_counts", "doc_clean", "doc_dedupe", "dedupe_crowded",
        "doc_merge", "eval_paired", "eval_balance", "sample_top_p", "sample_draw", "lm_predict",
        "tok_encode", "seq_pieces", "seq_layout", "seq_build", "clf_features", "seq_positions"]
FULL = os.environ.get("NEWSLOOM_FULL") == "1"
SF = SF_CHECK if FULL else SF_SMALL


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def canon(cols, rows):
    idx = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in idx) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()) if FULL else FAST)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(ocols, res.fetchall())


def test_every_query_has_a_docstring():
    for name, fn in E.queries().items():
        assert fn.__doc__, name


def test_entry_runs(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"domain", "n_articles"}
    assert df.count() >= 0
