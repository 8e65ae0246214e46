"""The vote of labelled neighbours against sorting every similarity."""

import math

import numpy as np
import pytest

from velum.llm import neighbours


def space(n=300, seed=2, prior=0.7):
    rng = np.random.default_rng(seed)
    labels = (rng.random(n) < 0.5).astype(int)
    counts = np.log1p(rng.poisson(0.05 + 0.3 * labels[:, None] * (np.arange(neighbours.BUCKETS) % 3 == 0), (n, neighbours.BUCKETS))).astype(np.float32)
    return neighbours.Space(counts, rng.random((n, 10)).astype(np.float32), labels, prior), rng


@pytest.mark.parametrize("k", [1, 7, 25, 10_000])
def test_scores_equal_a_loop_over_all_labelled_vectors(k):
    """All similarities sorted, votes weighted by similarity and true shares; more neighbours than vectors are all of them."""
    s, rng = space()
    counts, shares = np.log1p(rng.poisson(0.2, (600, neighbours.BUCKETS))).astype(np.float32), rng.random((600, 10)).astype(np.float32)
    counts[0] = 0
    got = s.score(counts, shares, k)
    z = s._unit((s._rows(counts, shares) - s.centre) @ s.axes).astype(np.float64)
    ones = s.labels.mean()
    for i in range(0, 600, 7):
        sims = [float(z[i] @ v) for v in s.vectors.astype(np.float64)]
        near = sorted(range(len(sims)), key=lambda j: -sims[j])[:k]
        weight = [(max(sims[j], 0) ** neighbours.SHARPNESS + 1e-9) * (0.7 / ones if s.labels[j] else 0.3 / (1 - ones)) for j in near]
        want = sum(w for w, j in zip(weight, near, strict=True) if s.labels[j]) / sum(weight)
        assert math.isclose(got[i], want, abs_tol=2e-4), i
    assert ((got >= 0) & (got <= 1)).all()


def test_vectors_are_unit():
    s, _ = space()
    assert np.allclose(np.linalg.norm(s.vectors, axis=1), 1, atol=1e-4)
