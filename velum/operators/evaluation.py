"""Leakage-free evaluation: cases, splits, ranking and prediction metrics, coverage, latency."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velum.operators.catalogue import ranked
from velum.sources.written import written

col = F.col


def shuffle_key(seed: str, *ids: str) -> Column:
    """A seeded order that any engine can reproduce."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[col(i).cast("string") for i in ids]), 256)


def cases(ratings: DataFrame, users: DataFrame, positives: int, negatives: int, holdouts: int, seed: str = "42") -> DataFrame:
    """``userId, movieId, rating, role``: for each user a seeded draw of liked movies (>= 4) as holdout, then as input, and of disliked ones (<= 2) as input."""
    polar = F.when(col("rating") >= 4, "positive").when(col("rating") <= 2, "negative")
    mine = ratings.join(users.select("userId").distinct(), "userId", "left_semi").withColumn("polarity", polar).where("polarity is not null")
    n = F.row_number().over(Window.partitionBy("userId", "polarity").orderBy(shuffle_key(seed, "userId", "movieId"), "movieId"))
    role = F.when((col("polarity") == "positive") & (col("n") <= holdouts), "holdout").when((col("polarity") == "positive") & (col("n") <= holdouts + positives), "input").when((col("polarity") == "negative") & (col("n") <= negatives), "input")
    return mine.withColumn("n", n).withColumn("role", role).where("role is not null").select("userId", "movieId", "rating", "role")


def ranking_metrics(recommended: DataFrame, holdouts: DataFrame, k: int) -> DataFrame:
    """Per case: hit, recall, precision, ndcg, mrr and map at k. ``recommended (caseId, movieId, rank)``, ``holdouts (caseId, movieId)``; cases without recommendations score 0."""
    size = holdouts.groupBy("caseId").agg(F.count("*").alias("h"))
    hits = recommended.where(col("rank") <= k).join(holdouts.select("caseId", "movieId"), ["caseId", "movieId"]).select("caseId", "rank")
    run = F.count("*").over(Window.partitionBy("caseId").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    by = hits.withColumn("so_far", run).groupBy("caseId").agg(F.count("*").alias("hits"), F.sum(1 / F.log2(col("rank") + 1)).alias("dcg"), F.min("rank").alias("first"), F.sum(col("so_far") / col("rank")).alias("precisions"))
    best = F.least(col("h"), F.lit(k).cast("long"))
    ideal = F.aggregate(F.sequence(F.lit(1), best.cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    hits_ = F.coalesce(col("hits"), F.lit(0))
    return size.join(by, "caseId", "left").select("caseId", (hits_ > 0).cast("double").alias("hit"), (hits_ / col("h")).alias("recall"), (hits_ / k).alias("precision"), zero(col("dcg") / ideal).alias("ndcg"), zero(1 / col("first")).alias("mrr"), zero(col("precisions") / best).alias("map"))


def prediction_metrics(predicted: DataFrame) -> DataFrame:
    """One row of mae, rmse, bias, p95 of the absolute error and coverage from ``rating, predicted`` (null: no prediction)."""
    predicted = written(predicted.select("rating", "predicted"))  # read twice
    e = col("predicted") - col("rating")
    one = predicted.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.try_divide(100 * F.count("predicted"), F.count("*")).alias("coverage"), F.ceil(0.95 * F.count(e)).alias("__at"))
    # the percentile from places in a range sort: its aggregate would hold every distinct error in one task
    placed = ranked(predicted.select(F.abs(e).alias("__x")).where("__x is not null"), [col("__x")], "__place")
    p95 = placed.join(F.broadcast(one.select("__at")), col("__place") == col("__at")).agg(F.max("__x").alias("p95"))
    return one.crossJoin(p95).select("mae", "rmse", "bias", "p95", "coverage")  # one row each


def safety(recommended: DataFrame, public: DataFrame, universe: DataFrame, session: DataFrame, limit: int) -> DataFrame:
    """One row: recommendations outside the universe, not public, already rated; share of the catalogue that is recommended; cases below the limit."""
    mark = lambda frame, name: frame.select("movieId").distinct().withColumn(name, F.lit(1))
    r = recommended.join(mark(universe, "u"), "movieId", "left").join(mark(public, "p"), "movieId", "left").join(session.select(col("requestId").alias("caseId"), "movieId", F.lit(1).alias("r")), ["caseId", "movieId"], "left")
    total = public.agg(F.countDistinct("movieId").alias("catalogue"))
    out = r.agg(F.count_if(col("u").isNull()).alias("outside"), F.count_if(col("p").isNull()).alias("notPublic"), F.count_if(col("r") == 1).alias("alreadyRated"), F.countDistinct(F.when(col("p") == 1, col("movieId"))).alias("shown"))
    short = recommended.groupBy("caseId").agg(F.count("*").alias("n")).agg(F.count_if(col("n") < limit).alias("belowLimit"), F.count("*").alias("cases"))
    return out.crossJoin(total).crossJoin(short).withColumn("catalogueCoverage", 100 * col("shown") / col("catalogue"))  # one row each


def catalogue_fields(recommended: DataFrame, items: DataFrame, field: str) -> DataFrame:
    """Per case the mean and median of a field of the recommended known movies; null if any of them lacks it."""
    met = recommended.join(items.select("movieId", col(field).alias("x")), "movieId").groupBy("caseId").agg(F.count_if(col("x").isNull()).alias("lacking"), F.avg("x").alias("mean"), F.median("x").alias("median"))
    full = col("lacking") == 0
    return met.select("caseId", F.when(full, col("mean")).alias("mean"), F.when(full, col("median")).alias("median"))


def nearest_rank(values: DataFrame, column: str, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Nearest-rank percentiles, mean and maximum."""
    return values.agg(*[F.expr(f"percentile_disc({p / 100}) within group (order by {column})").alias(f"p{p}") for p in percents], F.avg(column).alias("mean"), F.max(column).alias("max"))


def time_calls(call: Callable[[], object], repeats: int = 3) -> list[float]:
    """Milliseconds of repeated calls, for :func:`nearest_rank`."""
    out = []
    for _ in range(repeats):
        t = time.perf_counter()
        call()
        out.append((time.perf_counter() - t) * 1000)
    return out


def quality_at(recommended: DataFrame, holdouts: DataFrame, ks: list[int]) -> DataFrame:
    """``recommender, k, cases, hit, recall, precision, ndcg, mrr, map, belowLimit, empty, shown``: means over the cases at every k, of all recommenders in one pass.

    ``recommended`` has ``recommender, caseId, movieId, rank``, without repeats of a case's movie, ``holdouts`` ``caseId, movieId``. Lists
    and held-out movies meet once; sums that run along the rank give what every k needs. A case without a list counts 0 with every
    recommender and is below every limit; cases without held-out movies aren't cases. ``shown`` are distinct movies up to k.
    """
    ks = sorted(set(ks))
    size = holdouts.distinct().groupBy("caseId").agg(F.count("*").alias("h"))
    held = holdouts.select("caseId", "movieId").distinct().withColumn("held", F.lit(1))
    run = Window.partitionBy("recommender", "caseId").orderBy("rank", "movieId").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.coalesce(col("held"), F.lit(0))
    met = recommended.where(col("rank") <= ks[-1]).join(size, "caseId").join(held, ["caseId", "movieId"], "left").withColumn("hits", F.sum(hit).over(run))
    met = met.withColumns({"dcg": F.sum(hit / F.log2(col("rank") + 1)).over(run), "precisions": F.sum(hit * col("hits") / col("rank")).over(run), "first": F.min(F.when(hit == 1, col("rank"))).over(run)})
    up_to = lambda k: F.max(F.when(col("rank") <= k, F.struct("rank", "movieId", "hits", "dcg", "precisions", "first")))
    each = met.groupBy("recommender", "caseId").agg(F.first("h").alias("h"), *(up_to(k).alias(f"at{k}") for k in ks), *(F.count_if(col("rank") <= k).alias(f"n{k}") for k in ks))
    each = each.select("recommender", "h", F.inline(F.array(*(F.struct(F.lit(k).cast("long").alias("k"), col(f"at{k}").alias("x"), col(f"n{k}").alias("n")) for k in ks))))
    best = F.least("h", "k")
    ideal = F.aggregate(F.sequence(F.lit(1), best.cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    hits = F.coalesce(col("x.hits"), F.lit(0))
    means = {"hit": (hits > 0).cast("double"), "recall": hits / col("h"), "precision": hits / col("k"), "ndcg": zero(col("x.dcg") / ideal), "mrr": zero(1 / col("x.first")), "map": zero(col("x.precisions") / best)}
    sums = each.groupBy("recommender", "k").agg(*(F.sum(v).alias(n) for n, v in means.items()), F.count_if(col("n") >= col("k")).alias("full"), F.count_if(col("n") > 0).alias("some"))
    shown = recommended.where(col("rank") <= ks[-1]).join(size, "caseId", "left_semi").groupBy("recommender", "movieId").agg(F.min("rank").alias("best"))
    shown = shown.groupBy("recommender").agg(*(F.count_if(col("best") <= k).alias(f"s{k}") for k in ks)).select(col("recommender").alias("who"), F.inline(F.array(*(F.struct(F.lit(k).cast("long").alias("of"), col(f"s{k}").alias("shown")) for k in ks))))
    out = sums.join(shown, (col("who") == col("recommender")) & (col("of") == col("k"))).crossJoin(F.broadcast(size.agg(F.count("*").alias("cases"))))  # one row
    return out.select("recommender", "k", "cases", *((col(n) / col("cases")).alias(n) for n in means), (col("cases") - col("full")).alias("belowLimit"), (col("cases") - col("some")).alias("empty"), "shown")
