"""Listings of the catalogue: their orders, the export record, role-tagged summaries, set differences and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velum.functions import constants as K
from velum.functions.numbers import round_away
from velum.operators.catalogue import AUDIENCE_REASONS, overlap, public_order, ranked, strings
from velum.operators.ratings import fillers
from velum.sources.written import written

col = F.col


def collaborative_order() -> list[Column]:
    return [col("ratingCount").desc(), col("averageRating").desc(), col("dataReliabilityScore").desc(), col("candidateScore").desc(), col("title"), col("movieId")]


def excluded_order() -> list[Column]:
    adult = F.when(col("suitabilityCategory") == "adult_or_sensitive", 0).otherwise(1)
    return [adult, col("candidateScore").desc(), col("ratingCount").desc(), col("title"), col("movieId")]


def rated_order() -> list[Column]:
    """Public movies first, then by filtered ratings; no mean counts as the lowest."""
    return [col("isPublic").desc(), F.coalesce("filteredRatingCount", F.lit(0)).desc(), col("filteredAverageRating").desc_nulls_last(), col("title"), col("movieId")]


def suspicious_order() -> list[Column]:
    return [col("auditFlagCount").desc(), col("standDisplayScore").asc_nulls_last(), col("ratingCount").asc_nulls_last(), col("popularity").asc_nulls_last(), col("title").asc_nulls_last(), col("movieId")]


def suspicious(frame: DataFrame, flags: Column) -> DataFrame:
    """Public movies with audit flags, with their number."""
    return frame.where("isPublic").withColumn("auditFlags", flags).where("auditFlags <> ''").withColumn("auditFlagCount", F.size(F.split("auditFlags", r"\|")))


def head(frame: DataFrame, order: list, n: int, name: str = "place") -> DataFrame:
    """The first n rows with their places; only n rows are numbered in one task."""
    return frame.orderBy(*order).limit(n).withColumn(name, F.row_number().over(Window.orderBy(*order)))


def top_users(ratings: DataFrame, n: int = 100) -> DataFrame:
    """The users with the most ratings; ties by id."""
    return head(ratings.groupBy("userId").agg(F.count("*").alias("n")), [col("n").desc(), col("userId")], n)


def top_movies(ratings: DataFrame, items: DataFrame, n: int = 100) -> DataFrame:
    by = ratings.groupBy("movieId").agg(F.count("*").alias("n"), F.avg("rating").alias("mean"))
    return head(by.join(items.select("movieId", "title"), "movieId"), [col("n").desc(), round_away(col("mean"), 9).desc(), col("title"), col("movieId")], n)


def first_by(frame: DataFrame, key: Column, order: list) -> DataFrame:
    """The first row of each key, which compares without case and outer white space; blank keys go."""
    key = F.lower(F.trim(key))
    return frame.withColumn("__key", key).where("__key <> ''").withColumn("__n", F.row_number().over(Window.partitionBy("__key").orderBy(*order))).where("__n = 1").drop("__key", "__n")


def record(items: DataFrame) -> DataFrame:
    """The export record: display fields fall back on the plain ones, lists are never null, roles are named."""
    filled = lambda *names: F.coalesce(*[F.nullif(col(n), F.lit("")) for n in names])
    have = set(items.columns)
    maybe = lambda *names: [n for n in names if n in have]
    none = F.array().cast("array<string>")
    lists = {c: F.coalesce(col(c), none) for c in ("genres", "keywords", "userTags", "publicBlockedTerms", "publicExclusionReasons")}
    roles = F.array_compact(F.array(F.when(col("isPublic"), F.lit("public")), F.when(col("isCollaborative"), F.lit("collaborative")), F.when(~col("isPublic"), F.lit("excluded"))))
    return items.select(
        "movieId", "tmdbId", "title", filled(*maybe("displayTitle", "tmdbTitle", "cleanTitle", "title")).alias("displayTitle"), "year", "overview",
        filled(*maybe("displayOverview", "overview")).alias("displayOverview"), F.nullif("posterPath", F.lit("")).alias("posterPath"), *[e.alias(c) for c, e in lists.items()], "runtime",
        col("language").alias("originalLanguage"), col("popularity").alias("tmdbPopularity"), "ratingCount", "averageRating", "candidateScore", "dataReliabilityScore", "recencyScore", "standDisplayScore", "suitabilityCategory", roles.alias("catalogRoles"),
    )


def merged(*lists: DataFrame, key: str = "movieId") -> DataFrame:
    """One row for each key of several lists; a later list wins over an earlier one."""
    out = None
    for i, frame in enumerate(lists):
        part = frame.withColumn("__list", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    whole = F.struct(*[c for c in out.columns if c != "__list"])
    return out.groupBy(key).agg(F.max_by(whole, F.struct(col("__list"), whole)).alias("x")).select("x.*")


def role_summary(public: DataFrame, support: DataFrame, summary: DataFrame) -> DataFrame:
    """Rating summaries of both lists with ``datasetRole``; missing values stay null."""
    part = lambda frame, role: frame.select("movieId", "title", F.lit(role).alias("datasetRole"), "ratingCount", "averageRating")
    return part(public, "public").unionByName(part(support, "collaborative_support")).join(summary.select("movieId", "filteredRatingCount", "filteredAverageRating"), "movieId", "left")


def rated_intersections(ratings: DataFrame, items: DataFrame, least: float = 1.0) -> DataFrame:
    """How many movies have ratings of at least ``least``, in all and among the public and the collaborative ones."""
    rated = ratings.where(col("rating") >= least).select("movieId").distinct()
    met = rated.join(items.select("movieId", "isPublic", "isCollaborative"), "movieId", "left")
    return met.agg(F.count("*").alias("rated"), F.count_if("isPublic").alias("ratedPublic"), F.count_if("isCollaborative").alias("ratedCore"))


def difference(old: DataFrame, new: DataFrame, key: str = "movieId") -> DataFrame:
    """Keys of ``old`` that ``new`` lacks."""
    return old.select(key).distinct().join(new.select(key), key, "left_anti")


def index_gap(candidates: DataFrame, index: DataFrame) -> DataFrame:
    """Candidates and how many of them a model's index lacks."""
    met = candidates.select("movieId").distinct().join(index.select("movieId", F.lit(True).alias("known")).distinct(), "movieId", "left")
    return met.agg(F.count("*").alias("candidates"), F.count_if(col("known").isNull()).alias("missing"))


def lookup(items: DataFrame, movie_id: int) -> DataFrame:
    """The row of one movie; evaluating the frame fails if there is none or more than one."""
    found = items.where(col("movieId") == movie_id).agg(F.collect_list(F.struct(*items.columns)).alias("x"))
    wrong = F.raise_error(F.concat(F.lit(f"movie {movie_id}: rows found: "), F.size("x").cast("string")))
    return found.select(F.when(F.size("x") == 1, col("x")[0]).otherwise(wrong.cast(items.schema)).alias("x")).select("x.*")


def migrate(public: DataFrame, support: DataFrame) -> DataFrame:
    """Old exports in the canonical form: ``basePublicEligible`` and the reasons apart from the audience; a row without an id and a repeated id are errors."""
    rows = public.withColumn("__public", F.lit(True)).unionByName(support.withColumn("__public", F.lit(False)), allowMissingColumns=True)
    base = F.array_except("publicExclusionReasons", strings(AUDIENCE_REASONS))
    again = F.count("*").over(Window.partitionBy("movieId"))
    bad = F.when(col("movieId").isNull(), F.raise_error("a catalogue row has no movieId")).when(again > 1, F.raise_error("a movieId stands in two rows")).otherwise(F.lit(True))
    out = rows.withColumn("__sound", bad.cast("boolean")).where("__sound")
    return out.withColumns({"basePublicEligible": col("__public") | (F.size(base) == 0), "basePublicExclusionReasons": base}).drop("__public", "__sound")


def selections(frame: DataFrame) -> DataFrame:
    """The audit's examples: ``movieId, selection`` for support movies, teen movies of sensitive genres and family-certified teen movies."""
    sensitive = overlap(col("genres"), K.SENSITIVE_GENRES)
    family = col("us").isin(K.FAMILY_US) | col("es").isin(K.FAMILY_ES)
    teen = col("isPublic") & (col("suitabilityCategory") == "teen")
    parts = [(~col("isPublic") & col("isCollaborative"), "support"), (teen & sensitive, "teen_sensitive"), (teen & family, "family_certified_teen")]
    return frame.select("movieId", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in parts]))).alias("selection"))


def spread(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Least, greatest and mean value (four places) of number columns, one row for each."""
    parts = [F.struct(F.lit(c).alias("field"), F.count(c).alias("present"), F.min(c).cast("double").alias("least"), F.max(c).cast("double").alias("most"), F.round(F.avg(c), 4).alias("mean")) for c in columns]
    return frame.agg(F.array(*parts).alias("x")).select(F.inline("x"))


def top_tokens(items: DataFrame, columns: list[str], n: int = 20) -> DataFrame:
    """``field, token, movies, place`` of the tokens that the most movies have; ties by token."""
    plain = lambda c: F.array_distinct(F.transform(c, lambda x: F.replace(F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " ")), F.lit(" "), F.lit("_"))))
    rows = items.select("movieId", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), plain(col(c)).alias("tokens")) for c in columns])).alias("x")).select("movieId", "x.field", F.explode("x.tokens").alias("token"))
    by = rows.where("token <> ''").groupBy("field", "token").agg(F.countDistinct("movieId").alias("movies"))
    return by.withColumn("place", F.row_number().over(Window.partitionBy("field").orderBy(col("movies").desc(), "token"))).where(col("place") <= n)


def index_summary(index: DataFrame, items: DataFrame) -> DataFrame:
    """Movies in all and in the index, features, non-zero weights, their mean number a movie (four places) and movies with tags, keywords and overview."""
    # features by movie and movies by feature are counted each on its own: two distinct counts in one would deal every weight twice
    by_movie, by_feature = index.groupBy("movieId").agg(F.count("*").alias("n")), index.groupBy("feature").agg(F.lit(1).alias("one"))
    a = by_movie.agg(F.count("movieId").alias("indexed"), F.coalesce(F.sum("n"), F.lit(0)).alias("nonZero")).crossJoin(by_feature.agg(F.count("feature").alias("features")))
    a = a.select("indexed", "features", "nonZero").withColumn("meanNonZero", F.round(col("nonZero") / col("indexed"), 4))
    some = lambda c: F.count_if(F.size(c) > 0)
    b = items.agg(F.count("*").alias("movies"), some("userTags").alias("withTags"), some("keywords").alias("withKeywords"), F.count_if(F.trim(F.coalesce("overview", F.lit(""))) != "").alias("withOverview"))
    return a.crossJoin(b)  # one row each


def block_sizes(index: DataFrame) -> DataFrame:
    return index.groupBy("block").agg(F.countDistinct("feature").alias("features"), F.count("*").alias("nonZero"))


def typed(rows: DataFrame) -> DataFrame:
    """Catalogue records from a CSV of texts: numbers that don't parse are null, lists are pipe-joined, rows without a whole id or a title go."""
    text = lambda c: F.nullif(F.trim(col(c)), F.lit(""))
    number = lambda c, kind: text(c).try_cast("double").cast(kind) if kind == "double" else text(c).try_cast("double").cast("long").cast(kind)
    many = lambda c: F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    out = rows.select(
        text("movieId").try_cast("long").alias("movieId"), text("title").alias("title"), number("year", "int").alias("year"), many("genres").alias("genres"), number("runtime", "int").alias("runtime"),
        number("averageRating", "double").alias("averageRating"), number("ratingCount", "long").alias("ratingCount"), F.lower(F.trim(F.coalesce(col("isPublic"), F.lit("")))).isin("true", "1", "yes").alias("isPublic"),
    )
    return out.where(col("movieId").isNotNull() & col("title").isNotNull())


def ordered_union(*lists: DataFrame, key: str = "movieId") -> DataFrame:
    """``key, place``: every key of several sorted lists once, where it first stands, in the order of the lists and of their rows.

    A row's order is (list, partition, place in it), as :func:`DataFrame.orderBy` leaves the rows, written once so that it can't change; the first
    of each key is found by grouping, and places are counted by ranges, so no task holds all rows. Rows without a key are left out.
    """
    out = None
    for i, frame in enumerate(lists):
        part = written(frame.select(key).withColumn("__at", F.monotonically_increasing_id())).select(key, F.lit(i).alias("__list"), "__at")
        out = part if out is None else out.unionByName(part)
    first = out.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("__list", "__at")).alias("__first"))
    return ranked(first, [F.col("__first"), F.col(key)], "place").select(key, "place")


def checked_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join in which every row of ``left`` must meet exactly one of ``right``: a lost or doubled key raises an error with its value where it is met.

    The check is part of the plan, so no second pass is needed and nothing is returned before it has passed. Keys that only ``right`` has may
    repeat; a null key of ``left`` is lost.
    """
    others = [c for c in right.columns if c != key]
    clash = set(others) & set(left.columns)
    if clash:
        raise ValueError(f"columns on both sides: {', '.join(sorted(clash))}")
    once = right.groupBy(key).agg(F.count("*").alias("__n"), F.first(F.struct(*others)).alias("__x"))
    met = left.join(once, key, "left")
    named = lambda text: F.raise_error(F.concat(F.lit(text), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    sound = F.when(F.col("__n").isNull(), named(f"lost {key} ").cast("boolean")).when(F.col("__n") > 1, named(f"doubled {key} ").cast("boolean")).otherwise(F.lit(True))
    return met.where(sound).select(*left.columns, *(F.col(f"__x.{c}").alias(c) for c in others))


def filled(personal: DataFrame, requests: DataFrame, ranking: DataFrame, taken: DataFrame, limit: int) -> DataFrame:
    """``requestId, movieId, rank, score, fallback``: personal lists, and for what each of them lacks to ``limit`` the most popular movies that its request has neither rated nor been given.

    ``personal`` has ``requestId, movieId, rank, score``, ``requests`` every ``requestId``, ``taken`` ``requestId, movieId``. The shortfall is carried by request,
    so a full list asks for nothing and one without a personal movie for all.
    """
    own = personal.where(F.col("rank") <= limit).select("requestId", "movieId", F.col("rank").cast("long").alias("rank"), "score", F.lit(False).alias("fallback"))
    have = requests.select("requestId").distinct().join(own.groupBy("requestId").agg(F.count("*").alias("have")), "requestId", "left").select("requestId", F.coalesce("have", F.lit(0)).alias("have"))
    short = have.where(F.col("have") < limit)
    given = taken.select("requestId", "movieId").unionByName(own.select("requestId", "movieId")).distinct().join(short.select("requestId"), "requestId", "left_semi")
    return own.unionByName(fillers(ranking, short, given, limit).select("requestId", "movieId", F.col("rank").cast("long").alias("rank"), "score", "fallback"))


def build(items: DataFrame, public_limit: int | None = None, core_limit: int | None = None) -> DataFrame:
    """The catalogue build: ``part, place, movieId, roles`` of three overlapping selections, each in its own order.

    ``public`` movies and the collaborative ``core`` end at their limits (none: all), ``excluded`` has every movie with a reason. A public
    movie is ``collaborative_core`` too if the limited core has it; a core movie has the public roles if it is public, listed or not.
    ``items`` is what :func:`catalogue.roles` returns, read once for the three.
    """
    need = ["movieId", "title", "isPublic", "isCollaborative", "standDisplayScore", "suitabilityCategory", "recencyScore", "candidateScore", "dataReliabilityScore", "ratingCount", "averageRating", "popularity"]
    items = written(items.select(*need))
    cut = lambda frame, limit: frame if limit is None else frame.where(F.col("place") <= limit)
    public = cut(ranked(items.where("isPublic"), public_order(), "place"), public_limit)
    core = cut(ranked(items.where("isCollaborative"), collaborative_order(), "place"), core_limit)
    excluded = ranked(items.where("not isPublic"), excluded_order(), "place")
    seen = strings(["public", "recommendable", "rateable"])
    also = core.select("movieId", F.lit(True).alias("core"))
    row = lambda frame, part, roles: frame.select(F.lit(part).alias("part"), F.col("place").cast("long").alias("place"), "movieId", roles.alias("roles"))
    mark = strings(["collaborative_core"])
    out = row(public.join(also, "movieId", "left"), "public", F.when(F.col("core"), F.concat(seen, mark)).otherwise(seen))
    out = out.unionByName(row(core, "core", F.when(F.col("isPublic"), F.concat(seen, mark)).otherwise(mark)))
    return out.unionByName(row(excluded, "excluded", strings(["excluded_sensitive"])))


def build_summary(items: DataFrame, public_limit: int | None = None, core_limit: int | None = None) -> DataFrame:
    """``name, n``: the counters of a build in one pass."""
    has = lambda *names: F.forall(strings(names), lambda n: F.array_contains("publicExclusionReasons", n))
    most = lambda n, limit: n if limit is None else F.least(n, F.lit(limit).cast("long"))
    public, core = F.count_if("isPublic"), F.count_if("isCollaborative")
    counts = {
        "totalInputItems": F.count("*"), "publicEligibleMovies": public, "publicCatalog": most(public, public_limit), "collaborativeCore": most(core, core_limit), "excludedOrSensitive": F.count_if(~col("isPublic")),
        "publicDocumentaryExclusions": F.count_if(has("documentary")), "publicShortRuntimeExclusions": F.count_if(has("short_runtime")), "publicDocumentaryAndShortRuntimeExclusions": F.count_if(has("documentary", "short_runtime")),
    } | {f"{n}InputCount": F.count_if(col("suitabilityCategory") == c) for n, c in (("familyFriendly", "family_friendly"), ("teen", "teen"), ("adultOrSensitive", "adult_or_sensitive"), ("unknown", "unknown"))}
    one = items.agg(*(v.alias(k) for k, v in counts.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("name"), col(k).alias("n")) for k in counts))))
