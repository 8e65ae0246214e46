"""Candidate scores, suitability, display score, public policies, partitions and search of the catalogue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velum.functions import constants as K
from velum.functions.numbers import round_even, round_scaled
from velum.functions.text import normalise, once, tag
from velum.sources.written import written

col = F.col


@dataclass(frozen=True)
class Policy:
    min_ratings: int = 100
    public_min_year: int = 2000
    collaborative_min_year: int = 1990
    family_only: bool = False


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def listed(*reasons: tuple[Column, str]) -> Column:
    """The names of the conditions that hold, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(name)) for c, name in reasons]), lambda x: x.isNotNull())


def weight_sum(names: Column, weights: dict[str, float]) -> Column:
    """Sum of the weights of the names in an array."""
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + F.when(F.array_contains(names, name), F.lit(float(w))).otherwise(F.lit(0.0))
    return out


def overlap(a: Column, values) -> Column:
    return F.coalesce(F.arrays_overlap(a, strings(values)), F.lit(False))


# Candidates


def rating_summary(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("movieId").agg(F.count("*").alias("ratingCount"), round_even(F.avg("rating"), 3).alias("averageRating"))


def top_tags(tags: DataFrame, keep: int = K.TAGS_KEPT) -> DataFrame:
    """Per movie its most frequent normalised tags in order, and the number of distinct ones."""
    counted = tags.select("movieId", tag(col("tag")).alias("tag")).where("tag <> ''").groupBy("movieId", "tag").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("movieId").orderBy(col("n").desc(), "tag"))
    ranked = counted.withColumn("rank", rank)
    best = F.array_sort(F.collect_list(F.when(col("rank") <= keep, F.struct("rank", "tag"))))
    return ranked.groupBy("movieId").agg(F.transform(best, lambda x: x["tag"]).alias("userTags"), F.count("*").alias("distinctTagCount"))


def reliability(count: Column, average: Column, most: Column) -> Column:
    share = F.when(most > 0, F.least(F.log1p(count) / F.log1p(most), F.lit(1.0))).otherwise(F.lit(0.0))
    return round_even(K.RELIABILITY_COUNT * share + K.RELIABILITY_AVERAGE * average / 5, 4)


def recency(year: Column) -> Column:
    return F.when(year.isNull(), 0.0).when(year < 1990, 0.25).when(year < 2026, 0.40 + (year - 1990) / 36 * 0.60).otherwise(1.0)


def tag_signal(tags: Column) -> Column:
    return round_even(F.least(F.log1p(F.size(tags)) / F.log1p(F.lit(K.TAGS_FULL)), F.lit(1.0)), 4)


def score_candidates(movies: DataFrame, summary: DataFrame) -> DataFrame:
    """Joins movies (with ``userTags``) to their rating summary and adds the four scores; the largest count is over all rated movies."""
    most = summary.agg(F.max("ratingCount").alias("mostRated"))
    rated = movies.join(summary, "movieId").crossJoin(F.broadcast(most))  # one row
    rated = rated.withColumns({"dataReliabilityScore": reliability(col("ratingCount"), col("averageRating"), col("mostRated")), "recencyScore": recency(col("year")), "userTagsScore": tag_signal(col("userTags"))})
    a, b, c = K.CANDIDATE_WEIGHTS
    return rated.withColumn("candidateScore", round_even(a * col("dataReliabilityScore") + b * col("recencyScore") + c * col("userTagsScore"), 4)).drop("mostRated")


def candidate_order() -> list[Column]:
    return [col("candidateScore").desc(), col("recencyScore").desc(), col("dataReliabilityScore").desc(), col("ratingCount").desc(), col("averageRating").desc(), col("title"), col("movieId")]



def funnel(candidates: DataFrame, min_ratings: int, min_tags: int, first_year: int, last_year: int) -> DataFrame:
    """How many candidates are left after each filter, in one pass."""
    steps = [F.lit(True), col("ratingCount") >= min_ratings, col("distinctTagCount") >= min_tags, col("tmdbId").isNotNull(), col("year").between(first_year, last_year)]
    so_far, out = F.lit(True), []
    for i, s in enumerate(steps):
        so_far = so_far & F.coalesce(s, F.lit(False))
        out.append(F.struct(F.lit(i).alias("step"), F.count_if(so_far).alias("movies")))
    return candidates.agg(F.array(*out).alias("x")).select(F.inline("x"))


# Suitability


def certification(us: Column, es: Column) -> Column:
    us, es = F.coalesce(us, F.lit("")), F.coalesce(es, F.lit(""))
    return (
        F.when(us.isin(K.ADULT_US) | es.isin(K.ADULT_ES), "adult_or_sensitive")
        .when(es.isin(K.TEEN_ES), "teen").when(es.isin(K.FAMILY_ES), "family_friendly")
        .when(us.isin(K.TEEN_US), "teen").when(us.isin(K.FAMILY_US), "family_friendly").otherwise("unknown")
    )


def blocked_terms(texts: Column) -> Column:
    """Blocked terms, in order, that occur as whole words in any of an array of texts, which are normalised once and searched as one."""
    whole = F.concat(F.lit(" "), F.array_join(F.transform(texts, normalise), " | "), F.lit(" "))
    terms = F.array(*[F.struct(F.lit(t).alias("name"), F.lit(f" {_plain(t)} ").alias("phrase")) for t in K.BLOCKED_TERMS])
    found = F.transform(F.array(whole), lambda x: F.filter(terms, lambda t: F.contains(x, t["phrase"])))[0]
    return F.transform(found, lambda t: t["name"])


def _plain(term: str) -> str:
    return "".join(c if c.isalnum() else " " for c in term)


def classify(items: DataFrame) -> DataFrame:
    """Adds ``publicBlockedTerms, suitabilityCategory, suitabilityReasons``; needs ``us, es, genres, keywords, texts``.

    The blocked terms are searched once a row, whatever depends on them.
    """
    items = once(items, publicBlockedTerms=blocked_terms(col("texts")))
    items = items.withColumns({"__cert": certification(col("us"), col("es")), "__bad": overlap(col("genres"), K.SENSITIVE_GENRES), "__good": overlap(col("genres"), K.BOOST_GENRES) | overlap(F.transform("keywords", F.lower), K.FAMILY_TERMS)})
    cert, bad, good = col("__cert"), col("__bad"), col("__good")
    step = F.when(bad & (cert == "family_friendly"), "teen").when(bad & (cert == "unknown"), "adult_or_sensitive").otherwise(cert)
    open_ = step == "unknown"
    final = F.when(F.size("publicBlockedTerms") > 0, "adult_or_sensitive").when(open_ & good & ~bad, "family_friendly").otherwise(step)
    reasons = listed(
        (cert == "adult_or_sensitive", "adult certification"), (cert == "teen", "teen certification"), (cert == "family_friendly", "family certification"),
        (bad & (cert == "adult_or_sensitive"), "sensitive genre too"), (bad & (cert == "teen"), "teen certification outweighs sensitive genre"),
        (bad & (cert == "family_friendly"), "sensitive genre moves family to teen"), (bad & (cert == "unknown"), "sensitive genre without certification"),
        (open_ & good & ~bad, "family signals"), ((step == "teen") & good & ~bad, "family signals near teen"), (open_ & ~(good & ~bad), "no clear signals"),
        (F.size("publicBlockedTerms") > 0, "blocked topic"),
    )
    return items.withColumn("suitabilityReasons", reasons).withColumn("suitabilityCategory", final).drop("__cert", "__bad", "__good")


def classify_inspection(genres: Column, us: Column, es: Column, keywords: Column) -> Column:
    """The inspection report's older rules: both countries tested together, blocked keywords are an adult signal and Science Fiction a family one."""
    us, es = F.coalesce(us, F.lit("")), F.coalesce(es, F.lit(""))
    adult = us.isin(K.ADULT_US) | es.isin(K.ADULT_ES) | overlap(genres, K.SENSITIVE_GENRES) | overlap(F.transform(keywords, F.lower), K.BLOCKED_TERMS)
    family = us.isin(K.FAMILY_US) | es.isin(K.FAMILY_ES)
    teen = us.isin(K.TEEN_US) | es.isin(K.TEEN_ES)
    return F.when(adult, "adult_or_sensitive").when(teen, "teen").when(family | overlap(genres, [*K.BOOST_GENRES, "Science Fiction"]), "family_friendly").otherwise("unknown")


# Display score


def stand_score(items: DataFrame) -> DataFrame:
    """Adds ``standDisplayScore, standDisplayReasons``."""
    category, genres = col("suitabilityCategory"), col("genres")
    certified = (category == "teen") & (F.coalesce(col("us"), F.lit("")).isin(K.FAMILY_US) | F.coalesce(col("es"), F.lit("")).isin(K.FAMILY_ES))
    suit = F.when(certified, K.STAND_CERTIFIED_TEEN)
    for name, w in K.STAND_SUITABILITY.items():
        suit = suit.when(category == name, w)
    suit = suit.otherwise(0.0)
    genre = F.least(weight_sum(genres, K.STAND_GENRES) / K.STAND_GENRE_FULL, F.lit(1.0))
    said = F.transform(F.concat("keywords", "userTags"), lambda x: F.lower(F.trim(x)))
    terms = F.least(weight_sum(said, K.STAND_TERMS) / K.STAND_TERM_FULL, F.lit(1.0))
    popular = F.least(F.coalesce("popularity", F.lit(0.0)) / K.STAND_POPULARITY_FULL, F.lit(1.0))
    known = F.greatest(F.lit(0.0), F.least(0.60 * popular + 0.40 * col("dataReliabilityScore"), F.lit(1.0)))
    context = F.array_contains(genres, "Family") & overlap(genres, K.STAND_CONTEXT_GENRES)
    sensitive = F.least(weight_sum(genres, K.STAND_GENRE_PENALTIES), F.lit(K.STAND_PENALTY_CAP)) * F.when(context, K.STAND_CONTEXT_FACTOR).otherwise(1.0)
    sensitive = F.when(category.isin("teen", "family_friendly"), sensitive).otherwise(0.0)
    fine = F.lit(0.0)
    for name, w in K.STAND_CATEGORY_PENALTIES.items():
        fine = F.when(category == name, w).otherwise(fine)
    new, old, sure = col("recencyScore"), K.STAND_WEIGHTS, col("dataReliabilityScore")
    total = old["suitability"] * suit + old["genre"] * genre + old["recognition"] * known + old["recency"] * new + old["terms"] * terms + old["reliability"] * sure - (fine + sensitive)
    reasons = listed(
        (certified, "stand_family_certified_teen_suitability"), (~certified & (suit >= 1.0), "stand_family_suitability"), (~certified & (suit < 1.0) & (suit >= 0.7), "stand_teen_suitability"),
        (genre >= 0.75, "strong_stand_genre_appeal"), ((genre < 0.75) & (genre >= 0.40), "moderate_stand_genre_appeal"),
        (known >= 0.70, "strong_public_recognition"), ((known < 0.70) & (known >= 0.45), "moderate_public_recognition"),
        (new >= 0.85, "recent_movie"), (terms >= 0.50, "positive_audience_terms"), (sure >= 0.70, "strong_movielens_data"),
        (sensitive > 0, "sensitive_genre_display_penalty"), ((sensitive > 0) & context, "family_context_softens_sensitive_penalty"), (fine > 0, "category_display_penalty"),
    )
    return items.withColumns({"standDisplayScore": round_scaled(F.greatest(total, F.lit(0.0)), 4), "standDisplayReasons": reasons})


# Public catalogue


def documentary() -> Column:
    return F.exists("genres", lambda x: F.lower(x) == "documentary")


def short() -> Column:
    return F.coalesce(col("runtime").try_cast("double") < K.MIN_RUNTIME, F.lit(False))


def low_accessibility() -> Column:
    uncommon = (F.coalesce("language", F.lit("")) != "") & ~col("language").isin(K.COMMON_LANGUAGES)
    low = (F.coalesce("ratingCount", F.lit(0)) < K.LOW_COUNT) & (F.coalesce("popularity", F.lit(0.0)) < K.LOW_POPULARITY) & (F.coalesce("standDisplayScore", F.lit(0.0)) < K.LOW_SCORE)
    return uncommon & low & ~overlap(col("genres"), K.PROTECTED_GENRES)


def exclusion_reasons(p: Policy) -> Column:
    """Reasons against a place in the public catalogue; accessibility and score count only if there is no other."""
    first = listed(
        (F.coalesce("enrichmentError", F.lit("")) != "", "enrichment_error"), (F.coalesce("posterPath", F.lit("")) == "", "missing_poster"),
        (F.coalesce("ratingCount", F.lit(0)) < p.min_ratings, "below_min_ratings"), (col("year").isNull(), "missing_year"), (col("year") < p.public_min_year, "below_public_min_year"),
        (F.size("publicBlockedTerms") > 0, "blocked_public_topic"), (col("suitabilityCategory") == "adult_or_sensitive", "adult_or_sensitive"),
        (col("suitabilityCategory") == "unknown", "unknown_suitability"), (F.lit(p.family_only) & (col("suitabilityCategory") == "teen"), "family_only_excludes_teen"),
        (documentary(), "documentary"), (short(), "short_runtime"),
    )
    weak = F.coalesce(col("standDisplayScore") < K.MIN_STAND_SCORE, F.lit(True))
    return F.when(F.size(first) > 0, first).when(low_accessibility(), strings(["low_stand_accessibility"])).when(weak, strings(["low_stand_display_score"])).otherwise(F.array().cast("array<string>"))


def roles(items: DataFrame, p: Policy) -> DataFrame:
    """Adds ``publicExclusionReasons``, ``isPublic`` and ``isCollaborative``; a movie with any reason is also excluded or sensitive."""
    core = (F.coalesce("enrichmentError", F.lit("")) == "") & (F.coalesce("ratingCount", F.lit(0)) >= p.min_ratings) & F.coalesce(col("year") >= p.collaborative_min_year, F.lit(False))
    items = items.withColumn("publicExclusionReasons", exclusion_reasons(p))
    return items.withColumns({"isPublic": F.size("publicExclusionReasons") == 0, "isCollaborative": core})


def public_order() -> list[Column]:
    category = F.when(col("suitabilityCategory") == "family_friendly", 0).when(col("suitabilityCategory") == "teen", 1).otherwise(2)
    return [col("standDisplayScore").desc(), category, col("recencyScore").desc(), col("candidateScore").desc(), col("dataReliabilityScore").desc(), col("ratingCount").desc(), F.coalesce("popularity", F.lit(0.0)).desc(), col("title"), col("movieId")]



def ranked(items: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Places in a whole ``order`` without one task for all rows, however many have the same score.

    Rows are sorted by ranges of the whole order and written once; a row's place is its place in its range plus the rows of the ranges before.
    """
    dealt = written(items.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    range_of = F.shiftright("__at", 33)  # the id's upper bits are the partition, the lower ones count its rows
    sizes = dealt.groupBy(range_of.alias("__of")).agg(F.count("*").alias("__many"))  # one row a range
    before = F.coalesce(F.sum("__many").over(Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__of", before.alias("__before"))
    met = dealt.join(F.broadcast(sizes), range_of == col("__of"))
    return met.withColumn(name, col("__before") + col("__at").bitwiseAND((1 << 33) - 1) + 1).drop("__at", "__of", "__before")


def partition(items: DataFrame) -> DataFrame:
    """``movieId, part``: public; support = collaborative, not public, technically sound; the rest excluded, with which support movies stand again if they are documentaries or short."""
    sound = (F.coalesce("enrichmentError", F.lit("")) == "") & (F.coalesce("filteredRatingCount", F.lit(1)) > 0)
    support = ~col("isPublic") & col("isCollaborative") & sound
    twice = overlap(col("publicExclusionReasons"), ["documentary", "short_runtime"])
    parts = listed((col("isPublic"), "public"), (support, "support"), (~col("isPublic") & (~support | twice), "excluded"))
    return items.select("movieId", F.explode(parts).alias("part"))


AUDIENCES = {"family_only": ["family_friendly"], "family_and_teen": ["family_friendly", "teen"], "all_classified": ["family_friendly", "teen", "adult_or_sensitive"]}
AUDIENCE_REASONS = ["adult_or_sensitive", "unknown_suitability", "family_only_excludes_teen"]


def reconfigure(canonical: DataFrame, policy: str) -> DataFrame:
    """Re-partitions the canonical catalogue for an audience: ``movieId, part, reasons``; eligible apart from the audience and of an allowed category is public."""
    base = F.array_except("publicExclusionReasons", strings(AUDIENCE_REASONS))
    allowed = col("suitabilityCategory").isin(AUDIENCES[policy])
    public = (F.size(base) == 0) & allowed
    why = F.when(~allowed, F.concat(base, F.array(F.when(col("suitabilityCategory") == "unknown", "unknown_suitability").when(col("suitabilityCategory") == "teen", "family_only_excludes_teen").otherwise("adult_or_sensitive")))).otherwise(base)
    return canonical.select("movieId", F.when(public, "public").otherwise("support").alias("part"), why.alias("reasons"))


def partition_law(parts: DataFrame, everything: DataFrame) -> DataFrame:
    """Counts that must be 0: movies in no part, and in both public and another part."""
    by = parts.groupBy("movieId").agg(F.max(F.when(col("part") == "public", 1).otherwise(0)).alias("p"), F.max(F.when(col("part") != "public", 1).otherwise(0)).alias("o"))
    return everything.select("movieId").distinct().join(by, "movieId", "left").agg(F.count_if(col("p").isNull()).alias("uncovered"), F.count_if((col("p") == 1) & (col("o") == 1)).alias("overlapping"), F.count("*").alias("movies"))


def coverage(items: DataFrame) -> DataFrame:
    """``contentCoverage`` and ``collaborativeCoverage``; a filtered count of 0 is a count."""
    has = lambda c, w: F.when(c, w).otherwise(0.0)
    content = has(F.coalesce("overview", F.lit("")) != "", 0.35) + has(F.size("genres") > 0, 0.25) + has(F.size("keywords") > 0, 0.2) + has(F.size("userTags") > 0, 0.2)
    n = F.coalesce("filteredRatingCount", "ratingCount", F.lit(0))
    return items.withColumns({"contentCoverage": F.round(content, 4), "collaborativeCoverage": F.round(F.least(F.lit(1.0), n / 250), 4)})


def status(covered: DataFrame) -> DataFrame:
    a, b = F.coalesce(F.avg("contentCoverage"), F.lit(0.0)), F.coalesce(F.avg("collaborativeCoverage"), F.lit(0.0))
    return covered.agg(F.count("*").alias("movies"), F.round(a, 2).alias("content"), F.round(b, 2).alias("collaborative"), F.least(F.lit(1.0), F.round((a + b) / 2 + 0.11, 2)).alias("hybrid"))


def search(items: DataFrame, text: str = "", genre: str = "") -> DataFrame:
    """Movies whose title has the text and that have the genre, both without case; blank means any."""
    text, genre = text.strip().lower(), genre.strip().lower()
    if text:
        items = items.where(F.contains(F.lower("title"), F.lit(text)))
    if genre:
        items = items.where(F.exists("genres", lambda x: F.lower(x) == genre))
    return items


def page(items: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page of a sorted list with ``total`` and ``pages``; the list is sorted with a limit, not as a whole."""
    total = items.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(col("total") / size).cast("long"))
    return items.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))  # one row
