"""Scores of all users and items in blocks, against loops."""

import random

import pytest
from pyspark.sql import functions as F

from velum.functions.numbers import round_away
from velum.operators import explain, factors

NAN = float("nan")


@pytest.mark.parametrize(("users", "items"), [(512, 4096), (3, 7)])
def test_mode_scores_equal_a_loop(spark, monkeypatch, users, items):
    """To the last bit, however the vectors are grouped; vectors of other lengths or with nulls meet nothing."""
    monkeypatch.setattr(factors, "USERS", users)
    monkeypatch.setattr(factors, "ITEMS", items)
    rng = random.Random(4)
    rows = [(i, rng.uniform(-1, 1), [rng.uniform(-1, 1) for _ in range(5)]) for i in range(60)] + [(60, 0.5, [1.0, 2.0]), (61, 0.4, [2.0, 1.0]), (62, None, [1.0] * 5), (63, 0.1, [1.0, None, 1.0, 1.0, 1.0]), (64, 0.9, []), (65, 0.2, None)]
    v = spark.createDataFrame(rows, "movieId long, bias double, factors array<double>")
    got = factors.mode_scores(v.where("movieId % 3 = 0").withColumnRenamed("movieId", "requestId"), v, 3.0)
    want = {}
    for i, bu, p in rows[::3]:
        for j, bi, q in rows:
            if None in (bu, bi, p, q) or len(p) != len(q) or None in p + q:
                continue
            dot = 0.0
            for x, y in zip(p, q, strict=True):
                dot += x * y
            raw = 3.0 + bu + bi + dot
            predicted = max(0.5, min(raw, 5.0))
            if predicted > 3:
                want[i, j] = (raw, predicted, predicted, predicted - (3.0 + bi), dot, dot + 0.25 * bi)
    assert {(r[0], r[1]): tuple(r)[2:] for r in got.collect()} == want


def test_plan_of_mode_scores_has_no_product_of_rows(spark):
    v = spark.range(10).select(F.col("id").alias("movieId"), F.lit(0.1).alias("bias"), F.array(F.lit(1.0)).alias("factors"))
    plan = factors.mode_scores(v.withColumnRenamed("movieId", "requestId"), v, 3.0)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_round_away(spark):
    values = [0.5e-6, -0.5e-6, 1.5e-6, 2.5, -2.5, 3.0000004, 3.0000006, -1e-9, 0.0, 1e300]
    got = spark.createDataFrame([(x,) for x in values], "x double").select(round_away(F.col("x"), 6), round_away(F.col("x"), 0)).collect()
    assert [r[0] for r in got[:9]] == [1e-6, -1e-6, 2e-6, 2.5, -2.5, 3.0, 3.000001, 0.0, 0.0]
    assert [r[1] for r in got[3:5]] == [3.0, -3.0] and "-" not in str(got[7][0])
    assert spark.createDataFrame([(NAN,)], "x double").select(F.isnan(round_away(F.col("x"), 6))).first()[0]


def test_evidence_makes_no_pandas_group_of_a_request(spark):
    """The least used of the three strongest, over batches of several requests, in the order of ranks."""
    rows = [(q, 100 + m, m, s, 5, 1.0 - s / 10) for q in (1, 2, 3) for m in (2, 1, 3) for s in (1, 2, 3, 4)]
    out = explain.evidence(spark.createDataFrame(rows, "requestId long, movieId long, rank int, sourceId long, rating int, contribution double"))
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    got = out.coalesce(1).collect()
    assert len(got) == 9 and {r["rank"] + 100 for r in got} == {101, 102, 103} and all(r["movieId"] == 100 + r["rank"] for r in got)
    for q in (1, 2, 3):
        assert sorted(r["anchor"] for r in got if r["requestId"] == q) == [1, 2, 3]
        assert all(r["evidence"][0] == r["anchor"] and len(r["evidence"]) == 3 and 4 not in r["evidence"] for r in got if r["requestId"] == q)
