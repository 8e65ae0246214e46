"""The audit's tables by name, over the partitioned catalogue and the ratings.

The frame has ``partition`` (public, support, excluded) and the columns of the items; a movie may stand in two partitions.
Missing numbers come last in every order, and ties end in title, id and partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velum.functions import constants as K
from velum.operators import audit, listings, ratings
from velum.operators.catalogue import overlap, strings

col = F.col
TOP = 100
MOVIE = ["partition", "movieId", "title", "year", "language", "genres", "suitabilityCategory", "ratingCount", "popularity", "standDisplayScore", "standDisplayReasons", "publicBlockedTerms", "publicExclusionReasons", "filteredRatingCount", "filteredAverageRating"]


def down(*names: str) -> list[Column]:
    return [col(n).desc_nulls_last() for n in names]


def up(*names: str) -> list[Column]:
    return [col(n).asc_nulls_last() for n in names]


def end() -> list[Column]:
    return up("title", "movieId", "partition")


def low_access() -> Column:
    """Movies outside the public list that only their accessibility keeps out."""
    return (col("partition") != "public") & F.array_contains("publicExclusionReasons", "low_stand_accessibility")


def teen_sensitive() -> Column:
    return (col("partition") == "public") & (col("suitabilityCategory") == "teen") & overlap(col("genres"), K.SENSITIVE_GENRES)


def family_certified() -> Column:
    return (col("partition") == "public") & F.array_contains("standDisplayReasons", "stand_family_certified_teen_suitability")


def comparison(frame: DataFrame) -> DataFrame:
    """Each partition's movies, those with ratings, means and median, and public movies with audit flags."""
    some = lambda c: F.count_if(F.coalesce(c, F.lit(0)) > 0)
    return frame.groupBy("partition").agg(
        F.countDistinct("movieId").alias("movieCount"), some("ratingCount").alias("moviesWithRatings"), some("filteredRatingCount").alias("moviesWithFilteredRatings"),
        F.avg("ratingCount").alias("averageRatingCount"), F.avg("filteredRatingCount").alias("averageFilteredRatingCount"), F.avg("standDisplayScore").alias("averageStandDisplayScore"),
        F.median("standDisplayScore").alias("medianStandDisplayScore"), F.count_if((col("partition") == "public") & (audit.flags() != "")).alias("suspiciousMovieCount"),
    )


def counts(frame: DataFrame) -> DataFrame:
    """``name, partition, value, movies, percentage``: distinct movies by value for the four counted fields, and their share of the partition's sum; blanks are ``unknown``. One pass over the frame."""
    category = col("suitabilityCategory")
    fields = {"suitability_by_partition": F.coalesce(category, F.lit("")), "public_suitability_counts": F.when(col("partition") == "public", F.coalesce(category, F.lit(""))), "language_by_partition": F.coalesce("language", F.lit("")), "decade_by_partition": F.coalesce(audit.decade(), F.lit(""))}
    cells = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(n).alias("name"), F.trim(v).alias("value"))) for n, v in fields.items()]))
    rows = frame.select("partition", "movieId", F.inline(cells))
    by = rows.groupBy("name", "partition", F.coalesce(F.nullif(col("value"), F.lit("")), F.lit("unknown")).alias("value")).agg(F.countDistinct("movieId").alias("movies"))
    return by.withColumn("percentage", F.round(col("movies") * 100 / F.sum("movies").over(Window.partitionBy("name", "partition")), 2))


def low_access_counts(frame: DataFrame) -> DataFrame:
    """``name, value, movies``: distinct movies that their accessibility keeps out, by language and by suitability."""
    fields = {"low_stand_accessibility_by_language": "language", "low_stand_accessibility_by_suitability": "suitabilityCategory"}
    cells = F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(F.nullif(col(c), F.lit("")), F.lit("unknown")).alias("value")) for n, c in fields.items()])
    return frame.where(low_access()).select("movieId", F.inline(cells)).groupBy("name", "value").agg(F.countDistinct("movieId").alias("movies"))


def named_reasons(c: str) -> Column:
    """Reasons under the names that the audit shows."""
    named = F.create_map(*[F.lit(x) for pair in K.REASON_LABELS.items() for x in pair])
    return F.transform(c, lambda x: F.coalesce(named[x], x))


def elements(frame: DataFrame) -> DataFrame:
    """``name, partition, value, movies, examples``: distinct movies by partition and element of the lists, with the first titles."""
    public, excluded = col("partition") == "public", col("partition") == "excluded"
    lists = {
        "genre_by_partition": F.when(F.size("genres") > 0, col("genres")).otherwise(strings(["unknown"])),
        "blocked_terms_by_partition": col("publicBlockedTerms"),
        "stand_display_reasons_by_partition": col("standDisplayReasons"),
        "stand_display_reasons_public": F.when(public, col("standDisplayReasons")),
        "public_exclusion_reasons_by_partition": named_reasons("publicExclusionReasons"),
        "excluded_reasons": F.when(excluded, col("publicExclusionReasons")),
        "teen_sensitive_genres": F.when(teen_sensitive(), F.array_intersect("genres", strings(K.SENSITIVE_GENRES))),
    }
    cells = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("values")) for n, v in lists.items()])
    return audit.explode_by(frame.select("partition", "movieId", "title", F.inline(cells)), "values", by=("name", "partition"))


def movies(frame: DataFrame, top: int = TOP) -> DataFrame:
    """``name, place`` and the movie's columns: the lists of at most ``top`` movies.

    All lists are ranked in one pass: a row goes into each list it belongs to with up to four keys that sort upwards, so tasks keep their own best
    before the exchange.
    """
    x = {n: col(n).cast("double") for n in ("standDisplayScore", "ratingCount", "popularity", "filteredRatingCount", "filteredAverageRating")}
    score, n, known, filtered, mean = x.values()
    frame = frame.withColumn("auditFlags", F.when(col("partition") == "public", audit.flags()).otherwise(F.lit("")))
    public, flagged = col("partition") == "public", F.size(F.split("auditFlags", r"\|")).cast("double")
    told = (F.size("publicBlockedTerms") > 0) | (F.size("publicExclusionReasons") > 0)
    lists = {
        "low_stand_accessibility_examples": (low_access(), [score, n, known]),
        "public_top_movies": (public, [-score, -n]),
        "public_top_by_stand_score": (public, [-score, -n]),
        "public_low_score_movies": (public, [score, n]),
        "public_bottom_by_stand_score": (public, [score, n]),
        "public_teen_sensitive_movies": (teen_sensitive(), [-score, -n, -known]),
        "public_family_certified_teen_movies": (family_certified(), [-score, -n]),
        "support_examples": ((col("partition") == "support") & told, [-filtered, -n]),
        "excluded_examples": (col("partition") == "excluded", [F.array_join("publicExclusionReasons", "|")]),
        "top_movies_by_filtered_ratings": (filtered > 0, [-filtered, -mean]),
        "suspicious_public_movies_sample": (public & (col("auditFlags") != ""), [-flagged, score, n, known]),
    }
    cells = []
    for name, (hit, keys) in lists.items():
        text = keys if name == "excluded_examples" else [F.lit("")]
        keys = ([] if name == "excluded_examples" else keys) + [F.lit(0.0)] * 4
        key = F.struct(F.lit(name).alias("name"), text[0].alias("text"), *[k.alias(f"k{i}") for i, k in enumerate(keys[:4])])
        cells.append(F.when(F.coalesce(hit, F.lit(False)), key))
    rows = frame.select(*MOVIE, "auditFlags", F.inline(F.array_compact(F.array(*cells))))
    place = F.row_number().over(Window.partitionBy("name").orderBy(*up("k0", "k1", "k2", "k3", "text"), *end()))
    return rows.withColumn("place", place).where(col("place") <= top).drop("text", "k0", "k1", "k2", "k3")


def low_access_order() -> list[Column]:
    return [*up("standDisplayScore", "ratingCount", "popularity"), *end()]


def family_summary(public: DataFrame) -> DataFrame:
    """One row: family and teen movies of the public list, their shares, and how many are among the first 100 and 250 by display score."""
    family, teen = col("suitabilityCategory") == "family_friendly", col("suitabilityCategory") == "teen"
    share = lambda n: F.when(col("currentPublicMovies") > 0, F.round(col(n) * 100 / col("currentPublicMovies"), 2)).otherwise(0.0)
    whole = public.agg(F.count("*").alias("currentPublicMovies"), F.count_if(family).alias("familyFriendlyPublicMovies"), F.count_if(teen).alias("teenPublicMovies"))
    whole = whole.withColumns({"publicShareFamilyFriendlyPercent": share("familyFriendlyPublicMovies"), "publicShareTeenPercent": share("teenPublicMovies")})
    first = listings.head(public, [*down("standDisplayScore", "ratingCount"), *up("title", "movieId")], 250)
    cells = [F.count_if((col("place") <= n) & hit).alias(f"top{n}{name}Count") for n in (100, 250) for name, hit in (("FamilyFriendly", family), ("Teen", teen))]
    return whole.crossJoin(first.agg(*cells))  # one row each


def collaborative_summary(table: DataFrame) -> DataFrame:
    """``metric, value`` of the ratings; density to eight places, means to four."""
    places = {"totalRatings": ("ratings", None), "uniqueUsers": ("users", None), "uniqueRatedMovies": ("movies", None), "matrixDensity": ("density", 8), "averageRatingsPerUser": ("perUserMean", 4), "medianRatingsPerUser": ("perUserMedian", 4), "maxRatingsPerUser": ("perUserMax", None), "averageRatingsPerMovie": ("perMovieMean", 4), "medianRatingsPerMovie": ("perMovieMedian", 4)}
    cells = []
    for metric, (name, n) in places.items():
        value = F.coalesce(col(name).cast("double"), F.lit(0.0))
        cells.append(F.struct(F.lit(metric).alias("metric"), (value if n is None else F.round(value, n)).alias("value")))
    return ratings.overview(table).select(F.inline(F.array(*cells)))


def tables(frame: DataFrame, rated: DataFrame, top: int = TOP) -> dict[str, DataFrame]:
    """The audit's tables; ``counts``, ``elements``, ``movies`` and ``low_access_counts`` hold those of one shape, told apart by ``name``."""
    return {
        "comparison_by_partition": comparison(frame),
        "counts": counts(frame),
        "elements": elements(frame),
        "movies": movies(frame, top),
        "low_stand_accessibility_movies": frame.where(low_access()).select(*MOVIE).orderBy(*low_access_order()),
        "low_access_counts": low_access_counts(frame),
        "family_only_simulation_summary": family_summary(frame.where("partition = 'public'")),
        "collaborative_summary": collaborative_summary(rated),
        "rating_distribution": ratings.histogram(rated),
        "ratings_by_year": ratings.by_year(rated),
        "ratings_per_user_buckets": ratings.activity(rated, ratings.AUDIT_ACTIVITY),
        "top_users_by_rating_count": listings.top_users(rated),
    }
