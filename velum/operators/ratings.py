"""Rating tables: keep-last, user statistics, popularity, and the audit's rating reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velum.functions import constants as K
from velum.functions.numbers import round_away
from velum.operators.catalogue import ranked

col = F.col

ACTIVITY = [(1, 10, "1-9"), (10, 20, "10-19"), (20, 30, "20-29"), (30, 40, "30-39"), (40, 50, "40-49"), (50, 100, "50-99"), (100, None, "100+")]
#: The same for the audit.
AUDIT_ACTIVITY = [(1, 5, "1-4"), (5, 10, "5-9"), (10, 25, "10-24"), (25, 50, "25-49"), (50, 100, "50-99"), (100, 250, "100-249"), (250, None, "250+")]


def keep_last(ratings: DataFrame, order: list[Column]) -> DataFrame:
    """One rating for each user and movie, the last in ``order``."""
    last = F.row_number().over(Window.partitionBy("userId", "movieId").orderBy(*order))
    return ratings.withColumn("__n", last).where("__n = 1").drop("__n")


def semi_filter(ratings: DataFrame, movies: DataFrame) -> DataFrame:
    return ratings.join(movies.select("movieId").distinct(), "movieId", "left_semi")


def train_split(ratings: DataFrame, held_users: DataFrame) -> DataFrame:
    return ratings.join(held_users.select("userId").distinct(), "userId", "left_anti")


def user_stats(ratings: DataFrame) -> DataFrame:
    """Count, mean and population deviation of each user, from sums that Spark combines before the shuffle."""
    by = ratings.groupBy("userId").agg(F.count("*").alias("n"), F.sum("rating").alias("s"), F.sum(col("rating") * col("rating")).alias("q"))
    mean = col("s") / col("n")
    return by.select("userId", "n", mean.alias("mean"), F.sqrt(F.greatest(col("q") / col("n") - mean * mean, F.lit(0.0))).alias("std"))


def centred(ratings: DataFrame) -> DataFrame:
    return ratings.withColumn("centred", col("rating") - F.avg("rating").over(Window.partitionBy("userId")))


def app_rating(r: Column) -> Column:
    """Half-star ratings on the five-step scale."""
    return F.when(r >= 4.5, 5).when(r >= 3.5, 4).when(r >= 2.5, 3).when(r >= 1.5, 2).otherwise(1)


# Popularity


def popularity(items: DataFrame) -> DataFrame:
    """Shrunk mean rating with a share of the display score; a filtered count or mean of 0 falls back to the raw one."""
    n = F.coalesce(F.nullif("filteredRatingCount", F.lit(0)), F.nullif("ratingCount", F.lit(0)), F.lit(0))
    mean = F.coalesce(F.nullif("filteredAverageRating", F.lit(0.0)), F.nullif("averageRating", F.lit(0.0)), F.lit(0.0))
    stand = F.coalesce("standDisplayScore", F.lit(0.0))
    stand = F.when(stand > 1, stand / 100).otherwise(stand)
    a, b = K.POPULARITY_WEIGHTS
    score = a * mean * (n / (n + K.POPULARITY_PRIOR)) + b * stand
    rated = items.where((n > 0) & (mean > 0)).select("movieId", score.alias("score"))
    return ranked(rated, [round_away(col("score"), 9).desc(), col("movieId")])


def fillers(ranking: DataFrame, requests: DataFrame, taken: DataFrame, limit: int, universe: DataFrame | None = None) -> DataFrame:
    """For each of ``requests (requestId, have)`` the most popular movies it has not ``taken (requestId, movieId)``, up to ``limit`` in all; ranks go on after ``have``.

    A request looks only as deep into the ranking as it has taken movies, and ``limit`` more: those places are listed and joined by rank.
    """
    if universe is not None:
        kept = ranking.join(universe.select("movieId").distinct(), "movieId", "left_semi")
        ranking = ranked(kept.withColumnRenamed("rank", "__old"), [col("__old")]).drop("__old")
    depth = taken.groupBy("requestId").agg(F.count("*").alias("n"))
    places = requests.join(depth, "requestId", "left").withColumn("rank", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("n", F.lit(0).cast("long")) + limit))).drop("n")
    free = places.join(ranking, "rank").join(taken, ["requestId", "movieId"], "left_anti")
    place = F.row_number().over(Window.partitionBy("requestId").orderBy("rank"))
    return free.withColumn("place", place).where(col("place") + col("have") <= limit).select("requestId", "movieId", (col("have") + col("place")).alias("rank"), "score", F.lit(True).alias("fallback"))


# Reports


def overview(ratings: DataFrame) -> DataFrame:
    users = ratings.groupBy("userId").agg(F.count("*").alias("n")).agg(F.count("*").alias("users"), F.avg("n").alias("perUserMean"), F.median("n").alias("perUserMedian"), F.max("n").alias("perUserMax"), F.sum("n").alias("ratings"))
    movies = ratings.groupBy("movieId").agg(F.count("*").alias("n")).agg(F.count("*").alias("movies"), F.avg("n").alias("perMovieMean"), F.median("n").alias("perMovieMedian"))
    both = users.crossJoin(movies)  # one row each
    return both.withColumn("density", F.when(col("users") * col("movies") > 0, col("ratings") / (col("users") * col("movies"))).otherwise(0.0))


def histogram(ratings: DataFrame) -> DataFrame:
    """Counts and shares of the ten rating values, zeros included."""
    spark = ratings.sparkSession
    steps = spark.range(1, 11).select((col("id") / 2).alias("rating"))
    by = ratings.groupBy("rating").agg(F.count("*").alias("n"))
    out = steps.join(by, "rating", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("share", col("n") * 100 / F.sum("n").over(Window.partitionBy()))


def by_year(ratings: DataFrame) -> DataFrame:
    by = ratings.where(col("timestamp").isNotNull()).groupBy(F.year(F.timestamp_seconds("timestamp")).alias("year")).agg(F.count("*").alias("n"))
    return by.withColumn("share", col("n") * 100 / F.sum("n").over(Window.partitionBy()))


def activity(ratings: DataFrame, classes: list[tuple] | None = None) -> DataFrame:
    """Users by number of ratings in fixed classes, zeros included."""
    classes = classes or ACTIVITY
    spark = ratings.sparkSession
    label = None
    for lo, hi, name in classes:
        hit = (col("n") >= lo) & (col("n") < hi if hi else F.lit(True))
        label = F.when(hit, name) if label is None else label.when(hit, name)
    by = ratings.groupBy("userId").agg(F.count("*").alias("n")).groupBy(label.alias("bucket")).agg(F.count("*").alias("users"))
    names = spark.createDataFrame([(i, x[2]) for i, x in enumerate(classes)], "place int, bucket string")
    return names.join(by, "bucket", "left").select("place", "bucket", F.coalesce("users", F.lit(0)).alias("users"))


def solid_users(ratings: DataFrame, least: int, positives: int, negatives: int) -> DataFrame:
    by = ratings.groupBy("userId").agg(F.count("*").alias("n"), F.count_if(col("rating") >= 4).alias("positive"), F.count_if(col("rating") <= 2).alias("negative"))
    return by.where((col("n") >= least) & (col("positive") >= positives) & (col("negative") >= negatives))
