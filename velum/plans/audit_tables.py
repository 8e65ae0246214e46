"""Queries of the audit's tables over the whole test tables, with their SQL twins; tables of one shape stand together, told apart by ``name``."""

from __future__ import annotations

from velum.functions import constants as K
from velum.operators import audit_tables, ratings
from velum.plans import adapters as A
from velum.plans import catalogue as base

FRAME, RATED, big, r6 = base.FRAME, base.RATED, base.big, base.r6
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


BAD = A._array(K.SENSITIVE_GENRES)
LOW = "partition <> 'public' and list_contains(publicExclusionReasons, 'low_stand_accessibility')"
TEEN = f"partition = 'public' and suitabilityCategory = 'teen' and list_has_any(genres, {BAD})"
SURE = "partition = 'public' and list_contains(standDisplayReasons, 'stand_family_certified_teen_suitability')"
FLAGS = "with f as (" + base.SQL["audit_flags"] + "), g as (" + FRAME + " select * from frame)"


@query(FLAGS + """ select partition, count(distinct movieId)::bigint as movieCount, (count(*) filter (ratingCount > 0))::bigint as moviesWithRatings, (count(*) filter (filteredRatingCount > 0))::bigint as moviesWithFilteredRatings,
round(avg(ratingCount), 6) as averageRatingCount, round(avg(filteredRatingCount), 6) as averageFilteredRatingCount, round(avg(standDisplayScore), 6) as averageStandDisplayScore, round(median(standDisplayScore), 6) as medianStandDisplayScore,
(count(*) filter (partition = 'public' and flags <> ''))::bigint as suspiciousMovieCount from g join f using (movieId) group by 1""")
def audit_comparison(spark, d):
    means = r6("averageRatingCount", "averageFilteredRatingCount", "averageStandDisplayScore", "medianStandDisplayScore")
    return audit_tables.comparison(base._frame(spark, d)).select("partition", "movieCount", "moviesWithRatings", "moviesWithFilteredRatings", *means, "suspiciousMovieCount")


COUNTED = [("suitability_by_partition", "suitabilityCategory", "true"), ("public_suitability_counts", "suitabilityCategory", "partition = 'public'"), ("language_by_partition", "language", "true"), ("decade_by_partition", "(year // 10 * 10)::varchar || 's'", "true")]


@query(FRAME + ", v as (" + " union all ".join(f"select '{n}' as name, partition, movieId, coalesce(nullif(trim({e}), ''), 'unknown') as value from frame where {w}" for n, e, w in COUNTED) + """), c as (select name, partition, value, count(distinct movieId)::bigint as movies from v group by 1, 2, 3)
select *, round(movies * 100.0::double / sum(movies) over (partition by name, partition), 2) as percentage from c""")
def audit_counts(spark, d):
    return audit_tables.counts(base._frame(spark, d))


LABELLED = "list_transform(publicExclusionReasons, lambda x: case x " + " ".join(f"when '{k}' then '{v}'" for k, v in K.REASON_LABELS.items()) + " else x end)"
LISTED = [
    ("genre_by_partition", "case when len(genres) > 0 then genres else ['unknown'] end", "true"), ("blocked_terms_by_partition", "publicBlockedTerms", "true"), ("stand_display_reasons_by_partition", "standDisplayReasons", "true"),
    ("stand_display_reasons_public", "standDisplayReasons", "partition = 'public'"), ("public_exclusion_reasons_by_partition", LABELLED, "true"), ("excluded_reasons", "publicExclusionReasons", "partition = 'excluded'"),
    ("teen_sensitive_genres", f"list_filter(genres, lambda x: list_contains({BAD}, x))", TEEN),
]


@query(FRAME + ", v as (" + " union all ".join(f"select '{n}' as name, partition, movieId, title, unnest(list_distinct({e})) as value from frame where {w}" for n, e, w in LISTED) + """), t as (select name, partition, value, title, row_number() over (partition by name, partition, value order by title) as n from (select distinct name, partition, value, title from v)),
e as (select name, partition, value, string_agg(title, ' | ' order by n) as examples from t where n <= 8 group by 1, 2, 3)
select name, partition, value, movies, examples from (select name, partition, value, count(distinct movieId)::bigint as movies from v group by 1, 2, 3) join e using (name, partition, value)""")
def audit_elements(spark, d):
    return audit_tables.elements(base._frame(spark, d))


END = "title nulls last, movieId, partition"
TOPS = [
    ("low_stand_accessibility_examples", LOW, f"standDisplayScore nulls last, ratingCount nulls last, popularity nulls last, {END}"),
    *[(n, "partition = 'public'", f"standDisplayScore desc nulls last, ratingCount desc nulls last, {END}") for n in ("public_top_movies", "public_top_by_stand_score")],
    *[(n, "partition = 'public'", f"standDisplayScore nulls last, ratingCount nulls last, {END}") for n in ("public_low_score_movies", "public_bottom_by_stand_score")],
    ("public_teen_sensitive_movies", TEEN, f"standDisplayScore desc nulls last, ratingCount desc nulls last, popularity desc nulls last, {END}"),
    ("public_family_certified_teen_movies", SURE, f"standDisplayScore desc nulls last, ratingCount desc nulls last, {END}"),
    ("support_examples", "partition = 'support' and (len(publicBlockedTerms) > 0 or len(publicExclusionReasons) > 0)", f"filteredRatingCount desc nulls last, ratingCount desc nulls last, {END}"),
    ("excluded_examples", "partition = 'excluded'", f"array_to_string(publicExclusionReasons, '|'), {END}"),
    ("top_movies_by_filtered_ratings", "filteredRatingCount > 0", f"filteredRatingCount desc nulls last, filteredAverageRating desc nulls last, {END}"),
    ("suspicious_public_movies_sample", "partition = 'public' and flags <> ''", "len(string_split(flags, '|')) desc, standDisplayScore nulls last, ratingCount nulls last, popularity nulls last, title nulls last, movieId"),
]


@query(FLAGS + ", h as (select * from g join f using (movieId)) " + " union all ".join(f"select * from (select '{n}' as name, row_number() over (order by {o}) as place, partition, movieId, title, standDisplayScore, filteredRatingCount from h where {w}) where place <= 100" for n, w, o in TOPS))
def audit_movies(spark, d):
    return audit_tables.movies(base._frame(spark, d)).select("name", *big("place"), "partition", "movieId", "title", "standDisplayScore", "filteredRatingCount")


@query(FRAME + f" select partition, movieId, title, language, suitabilityCategory, standDisplayScore from frame where {LOW}")
def audit_low_access(spark, d):
    f = base._frame(spark, d)
    return f.where(audit_tables.low_access()).select("partition", "movieId", "title", "language", "suitabilityCategory", "standDisplayScore")


@query(FRAME + f", v as (select movieId, language as l, suitabilityCategory as s from frame where {LOW}) " + " union all ".join(f"select '{n}' as name, coalesce(nullif({c}, ''), 'unknown') as value, count(distinct movieId)::bigint as movies from v group by 2" for n, c in (("low_stand_accessibility_by_language", "l"), ("low_stand_accessibility_by_suitability", "s"))))
def audit_low_access_counts(spark, d):
    return audit_tables.low_access_counts(base._frame(spark, d))


@query(FRAME + """, r as (select suitabilityCategory as s, row_number() over (order by standDisplayScore desc, ratingCount desc, title, movieId) as n from frame where partition = 'public'),
c as (select count(*)::bigint as a, (count(*) filter (s = 'family_friendly'))::bigint as b, (count(*) filter (s = 'teen'))::bigint as e, (count(*) filter (s = 'family_friendly' and n <= 100))::bigint as b1, (count(*) filter (s = 'teen' and n <= 100))::bigint as e1, (count(*) filter (s = 'family_friendly' and n <= 250))::bigint as b2, (count(*) filter (s = 'teen' and n <= 250))::bigint as e2 from r)
select a as currentPublicMovies, b as familyFriendlyPublicMovies, e as teenPublicMovies, case when a > 0 then round(b * 100.0::double / a, 2) else 0.0::double end as publicShareFamilyFriendlyPercent, case when a > 0 then round(e * 100.0::double / a, 2) else 0.0::double end as publicShareTeenPercent,
b1 as top100FamilyFriendlyCount, e1 as top100TeenCount, b2 as top250FamilyFriendlyCount, e2 as top250TeenCount from c""")
def audit_family_summary(spark, d):
    return audit_tables.family_summary(base._frame(spark, d).where("partition = 'public'"))


PER = "(select count(*) as n from ratings group by {})"


@query(RATED + f""", u as {PER.format("userId")}, m as {PER.format("movieId")}, x as (select (select count(*) from ratings) as r, (select count(*) from u) as us, (select count(*) from m) as ms)
select 'totalRatings' as metric, r::double as value from x union all select 'uniqueUsers', us::double from x union all select 'uniqueRatedMovies', ms::double from x union all select 'matrixDensity', round(r / (us * ms)::double, 8) from x
union all select 'averageRatingsPerUser', round(avg(n), 4) from u union all select 'medianRatingsPerUser', median(n)::double from u union all select 'maxRatingsPerUser', max(n)::double from u
union all select 'averageRatingsPerMovie', round(avg(n), 4) from m union all select 'medianRatingsPerMovie', median(n)::double from m""")
def audit_collaborative_summary(spark, d):
    return audit_tables.collaborative_summary(A.ratings(spark, d))


@query(RATED + ", b as (select case " + " ".join(f"when n < {hi} then '{name}'" for _, hi, name in ratings.AUDIT_ACTIVITY if hi) + f" else '{ratings.AUDIT_ACTIVITY[-1][2]}' end as bucket from (select count(*) as n from ratings group by userId)) select place::bigint as place, v.bucket, count(b.bucket)::bigint as users from (values " + ", ".join(f"({i}, '{x[2]}')" for i, x in enumerate(ratings.AUDIT_ACTIVITY)) + ") v(place, bucket) left join b on b.bucket = v.bucket group by 1, 2")
def audit_user_buckets(spark, d):
    return ratings.activity(A.ratings(spark, d), ratings.AUDIT_ACTIVITY).select(*big("place"), "bucket", "users")
