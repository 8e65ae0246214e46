"""The inspection of a raw rating data set: every counter from one scan of each table.

Ratings are read once: their number is observed while they are grouped by movie and user in one pass of grouping sets. Movies, with
what was counted for them, then give all other counters in one pass of grouping sets over decades.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from velum.sources.written import written

col = F.col
YEARS, RATINGS = (1990, 1995, 2000, 2010, 2015, 2020), (20, 50, 100, 250)


def inspect(movies: DataFrame, ratings: DataFrame, tags: DataFrame) -> DataFrame:
    """``name, key, n``: general counts, years, decades (those with a movie), movies from each year of YEARS on, and movies with at least each number of RATINGS.

    ``movies`` has one row for each ``movieId`` with ``year`` and ``tmdbId``, which may be null; ratings of unknown movies count as
    ratings only. An absent minimum or maximum is null.
    """
    seen, tagged = Observation(), Observation()
    pairs = ratings.select("userId", "movieId").observe(seen, F.count(F.lit(1)).alias("n"))
    both = pairs.groupingSets([[col("userId")], [col("movieId")]], "userId", "movieId").agg(F.grouping("movieId").alias("by_user"), F.count(F.lit(1)).alias("n"))
    both = written(both)  # the one scan of the ratings
    tags.select(F.lit(1).alias("x")).observe(tagged, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    users = both.agg(F.count_if(col("by_user") == 1)).first()[0]
    counted = both.where("by_user = 0").select("movieId", "n")
    met = movies.select("movieId", "year", "tmdbId").join(counted, "movieId", "left").withColumn("decade", F.concat((F.floor(col("year") / 10) * 10).cast("string"), F.lit("s")))
    rated = F.coalesce(col("n"), F.lit(0))
    general = {"movies": F.count(F.lit(1)), "withTmdbId": F.count("tmdbId"), "withoutYear": F.count_if(col("year").isNull()), "rated": F.count("n"), "earliestYear": F.min("year").cast("long"), "latestYear": F.max("year").cast("long")}
    later = {("yearFrom", str(y)): F.count_if(col("year") >= y) for y in YEARS} | {("ratingsFrom", str(r)): F.count_if(rated >= r) for r in RATINGS}
    later |= {("recentRatingsFrom", str(r)): F.count_if((rated >= r) & (col("year") >= 2000)) for r in RATINGS}
    columns = {**{("general", k): v for k, v in general.items()}, **later}
    sets = met.groupingSets([[], [col("decade")]], "decade").agg(F.grouping("decade").alias("all"), *(v.alias(f"c{i}") for i, v in enumerate(columns.values())))
    row = lambda name, key, n: F.struct(F.lit(name).alias("name"), key.alias("key"), n.cast("long").alias("n"))
    whole = [row(name, F.lit(key), col(f"c{i}")) for i, (name, key) in enumerate(columns)]
    whole += [row("general", F.lit(key), F.lit(n)) for key, n in (("ratings", seen.get["n"]), ("tags", tagged.get["n"]), ("users", users))]
    return sets.where((col("all") == 1) | col("decade").isNotNull()).select(F.inline(F.when(col("all") == 1, F.array(*whole)).otherwise(F.array(row("decade", col("decade"), col("c0"))))))
