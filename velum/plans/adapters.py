"""Domain frames made from the test tables, and the same as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.functions.numbers import round_even
from velum.operators import catalogue as C
from velum.operators import ratings as R
from velum.sources.written import stored

col = F.col
POLICY = C.Policy(min_ratings=25, public_min_year=2000, collaborative_min_year=1990)


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ratings(spark: SparkSession, d: str) -> DataFrame:
    """Who (customer) rated what (part): half stars from quantities, the last line item of each pair."""
    lines = read(spark, d, "lineitem").join(read(spark, d, "orders").select("o_orderkey", "o_custkey"), col("l_orderkey") == col("o_orderkey"))
    rows = lines.select(col("o_custkey").alias("userId"), col("l_partkey").alias("movieId"), (F.ceil(col("l_quantity") / 5.0) / 2.0).cast("double").alias("rating"), F.unix_timestamp("l_shipdate").alias("timestamp"), "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    last = [col(c).desc() for c in ("timestamp", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")]
    return R.keep_last(rows, last).select("userId", "movieId", "rating", "timestamp")


def rated(spark: SparkSession, d: str) -> DataFrame:
    """:func:`ratings` written once, for queries that read them several times."""
    return stored(ratings(spark, d))


def tags(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "part").agg(F.count("*").alias("n"))
    return read(spark, d, "events").crossJoin(F.broadcast(n)).select("user_id", (col("event_id") % col("n")).alias("movieId"), col("event_type").alias("tag"))  # one row of n


def texts(spark: SparkSession, d: str) -> DataFrame:
    """``movieId, overview``."""
    return read(spark, d, "documents").select(col("doc_id").alias("movieId"), col("text").alias("overview"))


def movies(spark: SparkSession, d: str, overviews: DataFrame | None = None) -> DataFrame:
    """Movies with the rows of :func:`texts`, or of ``overviews`` in their place."""
    k = col("p_partkey")
    pick = lambda m, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % m + 1).cast("int"))
    by_type = {"SMALL": ["Animation", "Family"], "PROMO": ["Comedy"], "STANDARD": ["Drama"], "LARGE": ["Action", "Thriller"], "MEDIUM": ["Adventure", "Fantasy"], "ECONOMY": ["Crime", "Drama"]}
    genres = F.array().cast("array<string>")
    for t, g in by_type.items():
        genres = F.when(col("p_type") == t, C.strings(g)).otherwise(genres)
    genres = F.concat(genres, F.when(k % 17 == 0, C.strings(["Documentary"])).otherwise(F.array().cast("array<string>")))
    word = F.split("p_name", " ")[0]
    parts = read(spark, d, "part").select(
        k.alias("movieId"), col("p_name").alias("title"), (1985 + k % 42).cast("int").alias("year"), genres.alias("genres"), (col("p_size") * 4).cast("int").alias("runtime"), (col("p_retailprice") % 120).alias("popularity"),
        pick(5, "en", "es", "fr", "de", "").alias("language"), pick(6, "PG-13", "R", "G", "PG", "", "").alias("us"), pick(4, "12", "A", "18", "").alias("es"),
        F.array(word, pick(7, "Magic", "school", "Murder", "robot", "drug trade", "family", "nature")).alias("keywords"), F.when(k % 11 != 0, F.concat(F.lit("/"), k.cast("string"))).alias("posterPath"),
        F.when(k % 13 != 0, k).alias("tmdbId"), F.lit(None).cast("string").alias("enrichmentError"),
    )
    out = parts.join(texts(spark, d) if overviews is None else overviews, "movieId", "left").join(C.top_tags(tags(spark, d)), "movieId", "left")
    return out.withColumns({"userTags": F.coalesce("userTags", F.array().cast("array<string>")), "distinctTagCount": F.coalesce("distinctTagCount", F.lit(0)), "texts": F.concat(F.array("title"), F.col("keywords"))})


def candidates(spark: SparkSession, d: str, r: DataFrame | None = None, overviews: DataFrame | None = None) -> DataFrame:
    """Movies with their scores; ``r`` are :func:`rated` ones that the query reads elsewhere too, ``overviews`` as in :func:`movies`."""
    return C.score_candidates(movies(spark, d, overviews), C.rating_summary(rated(spark, d) if r is None else r))


def items(spark: SparkSession, d: str, r: DataFrame | None = None, overviews: DataFrame | None = None) -> DataFrame:
    """Candidates with suitability, display score, filtered counts and catalogue roles."""
    r = rated(spark, d) if r is None else r
    filtered = r.where("rating >= 1.0").groupBy("movieId").agg(F.count("*").alias("filteredRatingCount"), round_even(F.avg("rating"), 3).alias("filteredAverageRating"))
    scored = C.stand_score(C.classify(candidates(spark, d, r, overviews))).join(filtered, "movieId", "left")
    return C.roles(scored, POLICY)


def sessions(spark: SparkSession, d: str, r: DataFrame | None = None) -> DataFrame:
    """Every user as a request, with its ratings on the five-step scale."""
    return (ratings(spark, d) if r is None else r).select(col("userId").alias("requestId"), "movieId", R.app_rating(col("rating")).alias("rating"), "timestamp")



def _array(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _sum(names: str, weights: dict) -> str:
    return "(0.0::double" + "".join(f" + case when list_contains({names}, '{n}') then {w!r}::double else 0 end" for n, w in weights.items()) + ")"


def _list(*pairs: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"case when {c} then '{n}' end" for c, n in pairs) + "], lambda x: x is not null)"


def _sql() -> dict[str, str]:
    from velum.functions import constants as K

    out = {}
    out["ratings"] = """
ratings as (select userId, movieId, rating, ts from (select o_custkey as userId, l_partkey as movieId, (ceil(l_quantity / 5.0) / 2.0)::double as rating, epoch(l_shipdate)::bigint as ts,
  row_number() over (partition by o_custkey, l_partkey order by l_shipdate desc, l_orderkey desc, l_linenumber desc, l_suppkey desc, l_quantity desc) as n
  from lineitem join orders on l_orderkey = o_orderkey) where n = 1),
summary as (select movieId, count(*)::bigint as ratingCount, round_even(avg(rating), 3) as averageRating from ratings group by 1),"""
    out["tags"] = """
tags as (select event_id % (select count(*) from part) as movieId, trim(lower(event_type)) as tag from events),
tag_counts as (select movieId, tag, count(*) as n from tags where tag <> '' group by 1, 2),
tag_ranks as (select *, row_number() over (partition by movieId order by n desc, tag) as rnk from tag_counts),
top_tags as (select movieId, list(tag order by rnk) filter (rnk <= 35) as userTags, count(*)::bigint as distinctTagCount from tag_ranks group by 1),"""
    pick = lambda m, *v: f"(case p_partkey % {m} " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(v)) + " end)"
    out["movies"] = f"""
movies as (select p_partkey as movieId, p_name as title, (1985 + p_partkey % 42)::int as year,
  list_concat(case p_type when 'SMALL' then ['Animation', 'Family'] when 'PROMO' then ['Comedy'] when 'STANDARD' then ['Drama'] when 'LARGE' then ['Action', 'Thriller'] when 'MEDIUM' then ['Adventure', 'Fantasy'] when 'ECONOMY' then ['Crime', 'Drama'] else []::varchar[] end, case when p_partkey % 17 = 0 then ['Documentary'] else []::varchar[] end) as genres,
  (p_size * 4)::int as runtime, p_retailprice % 120 as popularity, {pick(5, "en", "es", "fr", "de", "")} as language, {pick(6, "PG-13", "R", "G", "PG", "", "")} as us, {pick(4, "12", "A", "18", "")} as es,
  [split_part(p_name, ' ', 1), {pick(7, "Magic", "school", "Murder", "robot", "drug trade", "family", "nature")}] as keywords, case when p_partkey % 11 <> 0 then '/' || p_partkey end as posterPath,
  case when p_partkey % 13 <> 0 then p_partkey end as tmdbId, text as overview, coalesce(userTags, []::varchar[]) as userTags, coalesce(distinctTagCount, 0) as distinctTagCount
  from part left join documents on doc_id = p_partkey left join top_tags t on t.movieId = p_partkey),"""
    out["candidates"] = """
rated as (select m.*, ratingCount, averageRating, (select max(ratingCount) from summary) as most from movies m join summary s using (movieId)),
signals as (select *, round_even(0.65 * least(ln(1 + ratingCount) / ln(1 + most), 1) + 0.35 * averageRating / 5, 4) as dataReliabilityScore,
  case when year is null then 0.0::double when year < 1990 then 0.25 when year < 2026 then 0.40::double + (year - 1990) / 36.0::double * 0.60::double else 1.0 end as recencyScore,
  round_even(least(ln(1 + len(userTags)) / ln(1 + 20), 1), 4) as userTagsScore from rated),
candidates as (select *, round_even(0.60::double * dataReliabilityScore + 0.25::double * recencyScore + 0.15::double * userTagsScore, 4) as candidateScore from signals),"""
    texts = "list_transform(list_concat([title], keywords), lambda t: ' ' || trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')) || ' ')"
    blocked = _list(*[(f"list_bool_or(list_transform({texts}, lambda s: contains(s, ' {C._plain(t)} ')))", t) for t in K.BLOCKED_TERMS])
    quoted = lambda v: "(" + ", ".join(f"'{x}'" for x in v) + ")"
    out["classified"] = f"""
certified as (select *, case when us in {quoted(K.ADULT_US)} or es in {quoted(K.ADULT_ES)} then 'adult_or_sensitive' when es in {quoted(K.TEEN_ES)} then 'teen' when es in {quoted(K.FAMILY_ES)} then 'family_friendly'
  when us in {quoted(K.TEEN_US)} then 'teen' when us in {quoted(K.FAMILY_US)} then 'family_friendly' else 'unknown' end as cert, list_has_any(genres, {_array(K.SENSITIVE_GENRES)}) as bad,
  list_has_any(genres, {_array(K.BOOST_GENRES)}) or list_has_any(list_transform(keywords, lambda k: lower(k)), {_array(K.FAMILY_TERMS)}) as good, {blocked} as publicBlockedTerms from candidates),
stepped as (select *, case when bad and cert = 'family_friendly' then 'teen' when bad and cert = 'unknown' then 'adult_or_sensitive' else cert end as step from certified),
classified as (select *, case when len(publicBlockedTerms) > 0 then 'adult_or_sensitive' when step = 'unknown' and good and not bad then 'family_friendly' else step end as suitabilityCategory from stepped),"""
    w = K.STAND_WEIGHTS
    out["stand"] = f"""
parts_of_score as (select *, suitabilityCategory = 'teen' and (us in {quoted(K.FAMILY_US)} or es in {quoted(K.FAMILY_ES)}) as certified_teen,
  least({_sum("genres", K.STAND_GENRES)} / 3.0::double, 1.0::double) as g, least({_sum("list_transform(list_concat(keywords, userTags), lambda k: lower(trim(k)))", K.STAND_TERMS)} / 2.5::double, 1.0::double) as t,
  greatest(0.0::double, least(0.60::double * least(popularity / 110.0::double, 1.0::double) + 0.40::double * dataReliabilityScore, 1.0::double)) as known, list_contains(genres, 'Family') and list_has_any(genres, {_array(K.STAND_CONTEXT_GENRES)}) as family_context,
  least({_sum("genres", K.STAND_GENRE_PENALTIES)}, 0.10::double) as harm from classified),
totals as (select *, case when certified_teen then 0.86::double when suitabilityCategory = 'family_friendly' then 1.0 when suitabilityCategory = 'teen' then 0.80 else 0.0 end as suit,
  case when suitabilityCategory in ('teen', 'family_friendly') then harm * case when family_context then 0.35::double else 1.0 end else 0.0 end as sensitive_fine,
  case suitabilityCategory when 'unknown' then 0.15::double when 'adult_or_sensitive' then 0.25 else 0.0 end as fine from parts_of_score),
stands as (select *, round(greatest({w["suitability"]}::double * suit + {w["genre"]}::double * g + {w["recognition"]}::double * known + {w["recency"]}::double * recencyScore + {w["terms"]}::double * t + {w["reliability"]}::double * dataReliabilityScore - (fine + sensitive_fine), 0.0::double), 4) as standDisplayScore, """ + _list(("certified_teen", "stand_family_certified_teen_suitability"), ("not certified_teen and suit >= 1.0", "stand_family_suitability"), ("not certified_teen and suit < 1.0 and suit >= 0.7", "stand_teen_suitability"), ("g >= 0.75", "strong_stand_genre_appeal"), ("g < 0.75 and g >= 0.40", "moderate_stand_genre_appeal"), ("known >= 0.70", "strong_public_recognition"), ("known < 0.70 and known >= 0.45", "moderate_public_recognition"), ("recencyScore >= 0.85", "recent_movie"), ("t >= 0.50", "positive_audience_terms"), ("dataReliabilityScore >= 0.70", "strong_movielens_data"), ("sensitive_fine > 0", "sensitive_genre_display_penalty"), ("sensitive_fine > 0 and family_context", "family_context_softens_sensitive_penalty"), ("fine > 0", "category_display_penalty")) + """ as standDisplayReasons from totals),"""
    p = POLICY
    first = _list(("posterPath is null", "missing_poster"), (f"ratingCount < {p.min_ratings}", "below_min_ratings"), (f"year < {p.public_min_year}", "below_public_min_year"), ("len(publicBlockedTerms) > 0", "blocked_public_topic"), ("suitabilityCategory = 'adult_or_sensitive'", "adult_or_sensitive"), ("suitabilityCategory = 'unknown'", "unknown_suitability"), ("list_contains(genres, 'Documentary')", "documentary"), ("runtime < 70", "short_runtime"))
    out["items"] = f"""
filtered as (select movieId, count(*)::bigint as filteredRatingCount, round_even(avg(rating), 3) as filteredAverageRating from ratings where rating >= 1.0 group by 1),
firsts as (select s.*, filteredRatingCount, filteredAverageRating, {first} as first_reasons, language <> '' and language not in ('en', 'es') and ratingCount < 250 and popularity < 10 and standDisplayScore < 0.55 and not list_has_any(genres, ['Animation', 'Family']) as low_access from stands s left join filtered using (movieId)),
items as (select *, case when len(first_reasons) > 0 then first_reasons when low_access then ['low_stand_accessibility'] when standDisplayScore < 0.5 then ['low_stand_display_score'] else []::varchar[] end as publicExclusionReasons,
  ratingCount >= {p.min_ratings} and year >= {p.collaborative_min_year} as isCollaborative from firsts),
public as (select * from items where len(publicExclusionReasons) = 0),"""
    out["sessions"] = """
sessions as (select userId as requestId, movieId, case when rating >= 4.5 then 5 when rating >= 3.5 then 4 when rating >= 2.5 then 3 when rating >= 1.5 then 2 else 1 end as rating, ts from ratings),"""
    return out


SQL = _sql()


def cte(*names: str) -> str:
    """The expressions of ``names``, in order."""
    return "with " + "".join(SQL[n] for n in names).strip().rstrip(",")


RATED = ("ratings",)
CANDIDATES = ("ratings", "tags", "movies", "candidates")
ITEMS = (*CANDIDATES, "classified", "stand", "items")
