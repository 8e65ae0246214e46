"""Descent over blocks against the same descent in one sequence."""

import random

import numpy as np
import pytest

from velum.operators import descent

SETTINGS = {"factors": 4, "epochs": 20, "rate": 0.1, "regular": 0.02}


def ratings(spark, users=60, movies=40, share=0.5, hot=True):
    """Ratings of a known model with noise; one user has rated everything."""
    rng = np.random.default_rng(1)
    p, q, bu, bi = rng.normal(0, 0.7, (users, 3)), rng.normal(0, 0.7, (movies, 3)), rng.normal(0, 0.4, users), rng.normal(0, 0.4, movies)
    rows = [(u * 7, m * 3, float(np.clip(3 + bu[u] + bi[m] + p[u] @ q[m] + rng.normal(0, 0.1), 0.5, 5))) for u in range(users) for m in range(movies) if (hot and not u) or rng.random() < share]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "userId long, movieId long, rating double").repartition(3), rows


def loop(rows, checks, factors, epochs, rate, regular, seed):
    """One rating after another, in a new random order in each epoch; the least error on ``checks``."""
    rng = np.random.default_rng(seed)
    mean = np.mean([y for *_, y in rows])
    p, q = ({i: rng.normal(0, 0.05, factors) for i in {r[c] for r in rows}} for c in (0, 1))
    bu, bi = dict.fromkeys(p, 0.0), dict.fromkeys(q, 0.0)
    best = np.inf
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            u, m, y = rows[k]
            e = y - (mean + bu[u] + bi[m] + p[u] @ q[m])
            bu[u] += rate * (e - regular * bu[u])
            bi[m] += rate * (e - regular * bi[m])
            p[u], q[m] = p[u] + rate * (e * q[m] - regular * p[u]), q[m] + rate * (e * p[u] - regular * q[m])
        guess = [np.clip(mean + bu.get(u, 0) + bi.get(m, 0) + (p[u] @ q[m] if u in p and m in q else 0), 0.5, 5) for u, m, _ in checks]
        best = min(best, float(np.sqrt(np.mean((np.asarray([y for *_, y in checks]) - guess) ** 2))))
    return best


def test_a_block_is_worked_through_in_sequence():
    """Levels give exactly what one update after another gives."""
    rng = np.random.default_rng(5)
    u, m, y = rng.integers(0, 9, 300), rng.integers(0, 7, 300), rng.normal(3, 1, 300)
    start = [rng.normal(0, 0.1, n) for n in (9, 7, (9, 3), (7, 3))]
    bu, bi, p, q = (x.copy() for x in start)
    descent.sweep(u, m, y, 3.0, bu, bi, p, q, 0.1, 0.05)
    b2, i2, p2, q2 = (x.copy() for x in start)
    for a, b, v in zip(u, m, y, strict=True):
        e = v - (3.0 + b2[a] + i2[b] + p2[a] @ q2[b])
        b2[a] += 0.1 * (e - 0.05 * b2[a])
        i2[b] += 0.1 * (e - 0.05 * i2[b])
        p2[a], q2[b] = p2[a] + 0.1 * (e * q2[b] - 0.05 * p2[a]), q2[b] + 0.1 * (e * p2[a] - 0.05 * q2[b])
    for got, want in zip((bu, bi, p, q), (b2, i2, p2, q2), strict=True):
        assert np.allclose(got, want, atol=1e-12)
    assert descent.levels(np.asarray([0, 1, 0, 1]), np.asarray([0, 1, 1, 2])).tolist() == [0, 0, 1, 1]


@pytest.mark.parametrize("blocks", [1, 3])
def test_error_as_of_one_sequence(spark, blocks):
    frame, _ = ratings(spark)
    held = descent.F.pmod(descent.F.xxhash64("userId", "movieId"), descent.F.lit(10)) == 0
    parts = [[tuple(r) for r in frame.where(x).collect()] for x in (~held, held)]
    want = [loop(*parts, **SETTINGS, seed=seed) for seed in range(3)]  # they differ by a few percent with their random start
    model = descent.descend(frame, blocks=blocks, **SETTINGS, patience=20)
    assert 0.95 * min(want) < min(model.errors) < 1.01 * max(want)
    assert model.users.count() == 60 and model.items.count() == 40
    assert abs(descent.rmse(frame.where(held), model.mean, model.users.select("userId", "bias", "factors"), model.items.select("movieId", "bias", "factors")) - min(model.errors)) < 1e-3


def test_more_blocks_than_users_and_odd_rows(spark):
    """Empty groups, null rows, no held-out rating; empty ratings are an error."""
    frame = spark.createDataFrame([(1, 1, 4.0), (1, 2, 2.0), (2, 1, 5.0), (None, 1, 3.0), (2, None, 3.0), (2, 2, None)], "userId long, movieId long, rating double")
    model = descent.descend(frame, factors=2, epochs=2, blocks=5, fold=1_000_003)
    assert sorted(r.userId for r in model.users.collect()) == [1, 2] and len(model.errors) == 2
    with pytest.raises(ValueError, match="no ratings"):
        descent.descend(frame.limit(0), factors=2, epochs=1, blocks=2)
