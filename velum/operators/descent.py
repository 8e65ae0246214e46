"""Stochastic descent of a biased factorization over user x item blocks.

Users and items are dealt into ``blocks`` groups each, so the ratings fall into ``blocks`` squared blocks. In a round every user group
meets one item group, no two meet the same one, and the blocks of a round share neither users nor items: they are worked through
at once, each exactly in sequence. After as many rounds as there are groups every rating was seen once (an epoch). A round is one
cogroup of the factors with the ratings of its blocks; an item group then goes to the user group it meets next. Factors are
written once an epoch.

Within a block, ratings that follow one another but share neither user nor item don't depend on each other, so the sequence
falls into levels that are updated as arrays, with the same result as one after another.

A user's (or item's) updates depend on one another by nature, so those of a user with a third of all ratings are done by one task in
each round, a part of them in each. Ratings travel as rows; only the factors of one user and one item group are held together.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.operators.factors import dot
from velum.sources.written import stored, written

col = F.col
STATE = "at int, kind string, block int, ids array<long>, bias array<double>, factors array<double>"
NAMES = [c.split()[0] for c in STATE.split(", ")]


@dataclass
class Model:
    """``users (userId, bias, factors)``, ``items (movieId, bias, factors)`` and the validation error after each epoch."""

    mean: float
    users: DataFrame
    items: DataFrame
    errors: list[float] = field(default_factory=list)


def levels(u: np.ndarray, m: np.ndarray) -> np.ndarray:
    """For a sequence of (user, item) indexes: one more than the last level of the same user or item before."""
    of_user, of_item, out = [0] * (int(u.max(initial=-1)) + 1), [0] * (int(m.max(initial=-1)) + 1), []
    for a, b in zip(u.tolist(), m.tolist(), strict=True):
        n = of_user[a] if of_user[a] > of_item[b] else of_item[b]
        of_user[a] = of_item[b] = n + 1
        out.append(n)
    return np.asarray(out, np.int64)


def sweep(u, m, y, mean, bu, bi, p, q, rate, regular) -> None:
    """One pass over ratings in their order, in place: arrays of independent updates, level by level."""
    level = levels(u, m)
    order = np.argsort(level, kind="stable")
    bounds = np.flatnonzero(np.diff(level[order], prepend=-1))
    for at in np.split(order, bounds[1:]) if len(order) else []:
        a, b = u[at], m[at]
        e = y[at] - (mean + bu[a] + bi[b] + np.einsum("ij,ij->i", p[a], q[b]))
        bu[a] += rate * (e - regular * bu[a])
        bi[b] += rate * (e - regular * bi[b])
        p[a], q[b] = p[a] + rate * (e[:, None] * q[b] - regular * p[a]), q[b] + rate * (e[:, None] * p[a] - regular * q[b])


def _start(ratings: DataFrame, factors: int, blocks: int, spread: float, seed: int) -> DataFrame:
    """A row for each group of users and items: sorted ids, zero biases, small random factors."""
    ids = None
    for kind, key, block in (("user", "userId", "ub"), ("item", "movieId", "ib")):
        one = ratings.select(F.lit(kind).alias("kind"), col(block).alias("block"), col(key).alias("id"))
        ids = one if ids is None else ids.union(one)
    groups = ids.distinct().groupBy("kind", "block").agg(F.array_sort(F.collect_list("id")).alias("ids"))

    def run(batches):
        for b in batches:
            for kind, block, ids in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                rng = np.random.default_rng([seed, block, kind == "user"])
                yield _row(block, kind, block, np.asarray(ids), np.zeros(len(ids)), rng.normal(0, spread, (len(ids), factors)))

    return groups.mapInArrow(run, STATE)


def _row(at, kind, block, ids, bias, factors) -> pa.RecordBatch:
    cells = [pa.array([at], pa.int32()), pa.array([kind]), pa.array([block], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([bias], pa.list_(pa.float64())), pa.array([factors.ravel()], pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(cells, NAMES)


def _round(state: DataFrame, ratings: DataFrame, blocks: int, turn: int, epoch: int, mean: float, rate: float, regular: float, seed: int) -> DataFrame:
    """State after the blocks (user group i, item group i + turn) were seen; item groups stand at the user group they meet in the next turn."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = {left["kind"][i].as_py(): i for i in range(left.num_rows)}
        part = {}
        for kind, i in rows.items():
            ids, bias, flat = (left[c].combine_chunks()[i].values.to_numpy() for c in ("ids", "bias", "factors"))
            part[kind] = (ids, bias.copy(), flat.reshape(len(ids), -1).copy())
        if right.num_rows and len(part) == 2:
            user, item, y = (right[c].to_numpy() for c in ("userId", "movieId", "rating"))
            order = np.lexsort((item, user))
            order = order[np.random.default_rng([seed, epoch, turn, left["at"][0].as_py()]).permutation(len(order))]
            (us, bu, p), (ms, bi, q) = part["user"], part["item"]
            sweep(np.searchsorted(us, user[order]), np.searchsorted(ms, item[order]), y[order], mean, bu, bi, p, q, rate, regular)
        out = []
        for kind, i in rows.items():
            block = left["block"][i].as_py()
            out.append(_row(block if kind == "user" else (block - turn - 1) % blocks, kind, block, *part[kind]))
        return pa.Table.from_batches(out) if out else left.slice(0, 0).select(NAMES)

    seen = ratings.where(col("turn") == turn).select("ub", "userId", "movieId", "rating")
    return state.groupBy("at").cogroup(seen.groupBy("ub")).applyInArrow(run, STATE)


def _factors(state: DataFrame, kind: str, key: str) -> DataFrame:
    """A row for each user or item of a state."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids, bias, flat = (b.column(c)[i].values for c in range(3))
                wide = len(flat) // max(len(ids), 1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * wide, pa.int32()), flat)
                for a in range(0, len(ids), 10_000):
                    yield pa.RecordBatch.from_arrays([x.slice(a, 10_000) for x in (ids, bias, lists)], [key, "bias", "factors"])

    return state.where(col("kind") == kind).select("ids", "bias", "factors").mapInArrow(run, f"{key} long, bias double, factors array<double>")


def rmse(ratings: DataFrame, mean: float, users: DataFrame, items: DataFrame) -> float:
    """Error of clipped predictions; users and items without factors add nothing to the mean."""
    met = ratings.join(users.toDF("userId", "bu", "p"), "userId", "left").join(items.toDF("movieId", "bi", "q"), "movieId", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    guess = F.greatest(F.lit(0.5), F.least(F.lit(mean) + zero(col("bu")) + zero(col("bi")) + zero(dot(col("p"), col("q"))), F.lit(5.0)))
    return met.agg(F.sqrt(F.avg((col("rating") - guess) ** 2))).first()[0]


def descend(ratings: DataFrame, factors: int = 128, epochs: int = 100, rate: float = 0.005, regular: float = 0.02, blocks: int = 8, fold: int = 10, patience: int = 5, gain: float = 1e-4, spread: float = 0.05, seed: int = 42) -> Model:
    """The factors of the epoch with the least error on the ratings that a hash holds out, one in ``fold``; stops after ``patience`` epochs without a ``gain``.

    ``ratings`` has one row for each ``userId, movieId, rating``; other columns and rows with a null in these are left out. Without
    held-out ratings the error is that of all. Empty ratings are an error.
    """
    group = lambda key: F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(blocks)).cast("int")
    held = F.pmod(F.xxhash64("userId", "movieId"), F.lit(fold)) == 0
    whole = ratings.select(col("userId").cast("long"), col("movieId").cast("long"), col("rating").cast("double")).dropna()
    dealt = whole.withColumns({"held": held, "ub": group("userId"), "ib": group("movieId")}).withColumn("turn", F.pmod(col("ib") - col("ub"), F.lit(blocks)))
    kept = stored(dealt, "held", "turn")  # a round reads the files of its blocks alone
    rest, checks = kept.where("not held"), kept.where("held")
    mean = rest.agg(F.avg("rating")).first()[0]
    if mean is None:
        raise ValueError("no ratings to learn from")
    if checks.isEmpty():
        checks = rest
    state, best, stale, errors = written(_start(rest, factors, blocks, spread, seed)), None, 0, []
    for epoch in range(epochs):
        for turn in range(blocks):
            state = _round(state, rest, blocks, turn, epoch, mean, rate, regular, seed)
        state = written(state)
        users, items = _factors(state, "user", "userId"), _factors(state, "item", "movieId")
        errors.append(rmse(checks, mean, users, items))
        if best is None or errors[-1] < best.errors[-1] - gain:
            best, stale = Model(mean, users, items, list(errors)), 0
        else:
            stale += 1
            if stale >= patience:
                break
    return Model(mean, best.users, best.items, errors)


def holdout_error(ratings: DataFrame, fold: int = 10, **settings) -> DataFrame:
    """``epoch, rmse`` on held-out ratings after each epoch, and ``rmse_mean``, the error of the mean of the others."""
    model = descend(ratings, fold=fold, **settings)
    held = F.pmod(F.xxhash64("userId", "movieId"), F.lit(fold)) == 0
    base = ratings.where(held).agg(F.sqrt(F.avg((col("rating") - model.mean) ** 2)).alias("rmse_mean"))
    rows = ratings.sparkSession.createDataFrame(list(enumerate(model.errors, 1)), "epoch long, rmse double")
    return rows.crossJoin(F.broadcast(base))  # one row
