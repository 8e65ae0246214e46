"""Queries against their SQL twins on the smallest tables."""

import glob
import os

import duckdb
import pytest

from velum.plans import audit_tables, catalogue, listings, models

DATA = "/root/testdata/sf0.001"
NAMES = ["candidate_scores", "item_knn_neighbors", "user_knn_recommend", "public_catalog", "content_index", "eval_ranking_metrics", "rating_histogram", "tag_topk", "audit_flags", "bmf_score_modes", "stable_choice_sha256", "popularity_fillers", "content_similarity", "profile_signals", *listings.QUERIES, *audit_tables.QUERIES, *models.SQL]
QUERIES, SQL = catalogue.QUERIES | listings.QUERIES | audit_tables.QUERIES | models.QUERIES, catalogue.SQL | listings.SQL | audit_tables.SQL | models.SQL


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    want = duck.sql(SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    tidy = lambda f: f[cols].sort_values(cols).reset_index(drop=True).astype(str)
    assert tidy(got).equals(tidy(want))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
def test_whole_index_has_the_text_block(spark):
    whole = catalogue.QUERIES["content_index_whole"](spark, DATA).toPandas()
    texts = whole[whole.feature.str.startswith("text:")]
    assert len(texts) and set(texts.movieId) <= set(whole.movieId)
    assert ((whole.weight**2).groupby(whole.movieId).sum() - 1).abs().max() < 1e-3


def test_entry_point_has_a_twin_only_for_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
def test_all_audit_tables_can_be_planned(spark):
    from velum.operators import audit_tables as tables
    from velum.plans import adapters

    every = tables.tables(catalogue._frame(spark, DATA), adapters.ratings(spark, DATA))
    assert len(every) == 12 and all(t.columns for t in every.values())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
@pytest.mark.parametrize("name", ["eval_coverage", "eval_catalogue_fields", "role_summary", "popularity_fillers"])
def test_ratings_are_derived_once(spark, duck, name):
    """Results equal the SQL, and the plan that gives them reads no line items: ratings were written before, once."""
    frame = QUERIES[name](spark, DATA)
    assert "l_orderkey" not in frame._jdf.queryExecution().toString()
    got, want = frame.toPandas(), duck.sql(SQL[name]).df()
    cols = sorted(got.columns)
    tidy = lambda f: f[cols].sort_values(cols).reset_index(drop=True).astype(str)
    assert tidy(got).equals(tidy(want))
