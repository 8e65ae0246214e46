"""Queries of the rating and catalogue operators over the whole test tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velum.functions.numbers import round_away
from velum.operators import audit, catalogue, content, content_evidence, evaluation, explain, factors, neighbours, ratings
from velum.plans import adapters as A
from velum.sources.written import stored, written

col = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def text(name: str):
    return F.array_join(name, "|").alias(name)


def big(*names: str) -> list:
    return [col(n).cast("long").alias(n) for n in names]


SUPPORT, NEIGHBOURS, LIMIT = 3, 10, 10
BASE = A.cte(*A.CANDIDATES)
FULL = A.cte(*A.ITEMS)
RATED = A.cte(*A.RATED)

# Candidates and ratings


@query(BASE + " select movieId, title, ratingCount, averageRating, dataReliabilityScore, recencyScore, userTagsScore, candidateScore, row_number() over (order by candidateScore desc, recencyScore desc, dataReliabilityScore desc, ratingCount desc, averageRating desc, title, movieId) as \"rank\" from (select *  replace (round(recencyScore, 6) as recencyScore) from candidates)")
def candidate_scores(spark, d):
    return catalogue.ranked(A.candidates(spark, d).drop("overview", "texts").withColumn("recencyScore", F.round("recencyScore", 6)), catalogue.candidate_order()).select("movieId", "title", "ratingCount", "averageRating", "dataReliabilityScore", "recencyScore", "userTagsScore", "candidateScore", *big("rank"))


@query(BASE + """, f as (select ratingCount >= 20 as a, distinctTagCount >= 2 as b, tmdbId is not null as c, year between 1990 and 2020 as e from candidates)
select s::bigint as step, (select count(*) from f where (s < 1 or a) and (s < 2 or b) and (s < 3 or c) and (s < 4 or e))::bigint as movies from range(5) t(s)""")
def candidate_funnel(spark, d):
    return catalogue.funnel(A.candidates(spark, d), 20, 2, 1990, 2020).select(*big("step"), "movies")


@query(RATED + " select * from summary")
def movie_rating_summary(spark, d):
    return catalogue.rating_summary(A.ratings(spark, d))


@query("with " + A.SQL["tags"].strip().rstrip(",") + " select movieId, array_to_string(userTags, '|') as userTags, distinctTagCount from top_tags")
def tag_topk(spark, d):
    return catalogue.top_tags(A.tags(spark, d)).select("movieId", text("userTags"), "distinctTagCount")


@query(A.cte("ratings", "tags", "movies") + " select userId, count(*)::bigint as n, sum(rating) as total from ratings where movieId in (select movieId from movies where year >= 2000) group by 1")
def ratings_semi_filter(spark, d):
    return ratings.semi_filter(A.ratings(spark, d), A.movies(spark, d).where("year >= 2000")).groupBy("userId").agg(F.count("*").alias("n"), F.sum("rating").alias("total"))


HELD = "solid as (select userId from ratings group by 1 having count(*) >= 30 and count(*) filter (rating >= 4) >= 10 and count(*) filter (rating <= 2) >= 5)"


@query(RATED + f", {HELD} select movieId, count(*)::bigint as n, sum(rating) as total from ratings where userId not in (select userId from solid) group by 1")
def train_anti_split(spark, d):
    r = A.ratings(spark, d)
    return ratings.train_split(r, ratings.solid_users(r, 30, 10, 5)).groupBy("movieId").agg(F.count("*").alias("n"), F.sum("rating").alias("total"))


@query(RATED + " select userId, count(*)::bigint as n, round(avg(rating), 6) as mean, round(sqrt(greatest(sum(rating * rating) / count(*) - (sum(rating) / count(*)) * (sum(rating) / count(*)), 0)), 6) as std from ratings group by 1")
def user_stats(spark, d):
    return ratings.user_stats(A.ratings(spark, d)).select("userId", "n", *r6("mean", "std"))


@query(RATED + " select userId, movieId, rating, round(rating - avg(rating) over (partition by userId), 6) as centred from ratings")
def centered_ratings(spark, d):
    return ratings.centred(A.ratings(spark, d)).select("userId", "movieId", "rating", *r6("centred"))


@query(RATED + f", {HELD} select * from (select userId, count(*)::bigint as n, (count(*) filter (rating >= 4))::bigint as positive, (count(*) filter (rating <= 2))::bigint as negative from ratings group by 1) where userId in (select userId from solid)")
def solid_users(spark, d):
    return ratings.solid_users(A.ratings(spark, d), 30, 10, 5)


POPULAR = ", popular as (select movieId, 0.85 * m * (n / (n + 250)) + 0.15 * case when s > 1 then s / 100 else s end as score from (select movieId, coalesce(nullif(filteredRatingCount, 0), nullif(ratingCount, 0), 0)::double as n, coalesce(nullif(filteredAverageRating, 0), nullif(averageRating, 0), 0) as m, coalesce(standDisplayScore, 0) as s from items) where n > 0 and m > 0), ranking as (select *, row_number() over (order by round(score, 9) desc, movieId) as rnk from popular)"


def _popular(spark, d, r=None):
    return ratings.popularity(A.items(spark, d, r))


@query(FULL + POPULAR + " select movieId, round(score, 9) as score, rnk as \"rank\" from ranking")
def popularity_ranking(spark, d):
    return _popular(spark, d).select("movieId", round_away(col("score"), 9).alias("score"), *big("rank"))


@query(FULL + "," + A.SQL["sessions"].strip().rstrip(",") + POPULAR + """, free as (select u.requestId, r.movieId, r.score, row_number() over (partition by u.requestId order by r.rnk) as place
from (select distinct requestId from sessions) u join (select * from ranking where rnk <= (select max(n) from (select count(*) as n from sessions group by requestId)) + 10) r on true anti join sessions s on s.requestId = u.requestId and s.movieId = r.movieId)
select requestId, movieId, round(score, 9) as score, place as \"rank\", true as fallback from free where place <= 10""")
def popularity_fillers(spark, d):
    r = A.rated(spark, d)
    s = A.sessions(spark, d, r).select("requestId", "movieId")
    return ratings.fillers(_popular(spark, d, r), s.select("requestId", F.lit(0).alias("have")).distinct(), s, LIMIT).select("requestId", "movieId", round_away(col("score"), 9).alias("score"), *big("rank"), "fallback")


@query(RATED + """ select (select count(distinct userId) from ratings)::bigint as users, (select count(distinct movieId) from ratings)::bigint as movies, (select count(*) from ratings)::bigint as ratings,
round((select count(*) from ratings) / ((select count(distinct userId) from ratings) * (select count(distinct movieId) from ratings))::double, 8) as density,
round((select avg(n) from (select count(*) n from ratings group by userId)), 6) as perUserMean, (select median(n) from (select count(*) n from ratings group by userId))::double as perUserMedian, (select max(n) from (select count(*) n from ratings group by userId))::bigint as perUserMax,
round((select avg(n) from (select count(*) n from ratings group by movieId)), 6) as perMovieMean, (select median(n) from (select count(*) n from ratings group by movieId))::double as perMovieMedian""")
def ratings_overview(spark, d):
    return ratings.overview(A.ratings(spark, d)).select("users", "movies", "ratings", F.round("density", 8).alias("density"), *r6("perUserMean"), "perUserMedian", "perUserMax", *r6("perMovieMean"), "perMovieMedian")


@query(RATED + " select s / 2.0::double as rating, count(userId)::bigint as n, round(count(userId) * 100.0::double / (select count(*) from ratings), 6) as share from range(1, 11) t(s) left join ratings on rating = s / 2.0::double group by 1")
def rating_histogram(spark, d):
    return ratings.histogram(A.ratings(spark, d)).select("rating", "n", *r6("share"))


@query(RATED + " select year(to_timestamp(ts) at time zone 'UTC')::bigint as year, count(*)::bigint as n, round(count(*) * 100.0::double / (select count(*) from ratings), 6) as share from ratings group by 1")
def ratings_by_year(spark, d):
    return ratings.by_year(A.ratings(spark, d)).select(*big("year"), "n", *r6("share"))


@query(RATED + """, b as (select case when n < 10 then '1-9' when n < 20 then '10-19' when n < 30 then '20-29' when n < 40 then '30-39' when n < 50 then '40-49' when n < 100 then '50-99' else '100+' end as bucket from (select count(*) as n from ratings group by userId))
select place::bigint as place, v.bucket, count(b.bucket)::bigint as users from (values (0, '1-9'), (1, '10-19'), (2, '20-29'), (3, '30-39'), (4, '40-49'), (5, '50-99'), (6, '100+')) v(place, bucket) left join b on b.bucket = v.bucket group by 1, 2""")
def user_buckets(spark, d):
    return ratings.activity(A.ratings(spark, d)).select(*big("place"), "bucket", "users")


# Neighbourhood models

KNN = f""", norms as (select movieId, sqrt(sum(rating * rating)) as norm from ratings group by 1),
pairs as (select a.movieId as i, b.movieId as j, sum(a.rating * b.rating) as dot, count(*)::bigint as support from ratings a join ratings b on a.userId = b.userId and a.movieId < b.movieId group by 1, 2 having count(*) >= {SUPPORT}),
half as (select i, j, support, dot / (x.norm * y.norm) as similarity from pairs join norms x on x.movieId = i join norms y on y.movieId = j),
knn as (select * from (select *, row_number() over (partition by movieId order by round(similarity, 9) desc, neighborId) as rnk from (select i as movieId, j as neighborId, similarity, support from half union all select j, i, similarity, support from half)) where rnk <= {NEIGHBOURS})"""
SESSIONS = ", " + A.SQL["sessions"].strip().rstrip(",")


def _knn(spark, d, r=None):
    return neighbours.item_neighbours(A.rated(spark, d) if r is None else r, SUPPORT, NEIGHBOURS)


@query(RATED + KNN + " select movieId, neighborId, round(similarity, 6) as similarity, support, rnk as \"rank\" from knn")
def item_knn_neighbors(spark, d):
    return _knn(spark, d).select("movieId", "neighborId", *r6("similarity"), "support", *big("rank"))


ITEM = RATED + SESSIONS + KNN + f""", hits as (select requestId, neighborId as movieId, sum(similarity * (rating - 3)) as score, sum(similarity) as mass from sessions join knn using (movieId) where rating <> 3 group by 1, 2 having sum(similarity * (rating - 3)) > 1e-12),
fresh as (select h.* from hits h anti join sessions s on s.requestId = h.requestId and s.movieId = h.movieId),
served as (select * from (select *, score / mass as preference, row_number() over (partition by requestId order by round(score, 9) desc, movieId) as rnk from fresh) where rnk <= {LIMIT})"""


def _item_served(spark, d, r=None, knn=None):
    r = A.rated(spark, d) if r is None else r
    return neighbours.item_recommend(A.sessions(spark, d, r), _knn(spark, d, r) if knn is None else knn, _titles(spark, d), LIMIT)


@query(ITEM + " select requestId, movieId, round(score, 6) as score, round(preference, 6) as preference, rnk as \"rank\" from served")
def item_knn_recommend(spark, d):
    return _item_served(spark, d).select("requestId", "movieId", *r6("score", "preference"), *big("rank"))


@query(ITEM + " select requestId, movieId, round(greatest(0, least((preference + 2) / 4, 1)) * 100, 0)::bigint as \"match\" from served")
def match_percentage(spark, d):
    return _item_served(spark, d).select("requestId", "movieId", explain.match_percent(col("preference"), "preference").alias("match"))


USER = RATED + SESSIONS + """, centred as (select userId, movieId, rating, rating - avg(rating) over (partition by userId) as c from ratings),
met as (select requestId, userId, sum((s.rating - 3) * c) as xy, sum((s.rating - 3.0) * (s.rating - 3.0)) as xx, sum(c * c) as yy, count(*)::bigint as overlap from sessions s join centred using (movieId) where userId <> requestId group by 1, 2 having count(*) >= 2),
sims as (select *, xy / sqrt(xx * yy) as raw, xy / sqrt(xx * yy) * overlap / (overlap + 25) as similarity from met where xx > 0 and yy > 0),
near as (select * from (select *, row_number() over (partition by requestId order by round(similarity, 9) desc, overlap desc, round(raw, 9) desc, userId) as rnk from sims where similarity > 1e-12) where rnk <= 100)"""


def _near(spark, d, r=None):
    """``r`` are the :func:`A.rated` ratings if the query reads them elsewhere too."""
    c = written(ratings.centred(A.ratings(spark, d) if r is None else r))  # read several times
    s = c.select(col("userId").alias("requestId"), "movieId", ratings.app_rating(col("rating")).alias("rating"))
    return neighbours.user_neighbours(s, c), c


@query(USER + " select requestId, userId, overlap, round(raw, 6) as raw, round(similarity, 6) as similarity, rnk as \"rank\" from near")
def user_knn_neighbors(spark, d):
    return _near(spark, d)[0].select("requestId", "userId", "overlap", *r6("raw", "similarity"), *big("rank"))


PREDICT = USER + """, sums as (select requestId, movieId, sum(similarity * c) / sum(abs(similarity)) as shift, count(*)::bigint as neighbors, (count(*) filter (rating >= 4))::bigint as positives from near join centred using (userId) group by 1, 2),
predicted as (select requestId, movieId, neighbors, positives, 3 + shift as raw, greatest(0.5, least(3 + shift * neighbors / (neighbors + 5), 5)) as predicted from sums)"""


@query(PREDICT + f""" select requestId, movieId, neighbors, positives, round(predicted, 6) as predicted, rnk as \"rank\" from (select *, row_number() over (partition by requestId order by round(predicted, 9) desc, positives desc, neighbors desc, round(raw, 9) desc, movieId) as rnk
from predicted p anti join sessions s on s.requestId = p.requestId and s.movieId = p.movieId where neighbors >= 2 and predicted > 3.0) where rnk <= {LIMIT}""")
def user_knn_recommend(spark, d):
    near, c = _near(spark, d)
    out = neighbours.user_recommend(neighbours.user_predictions(near, c, least=2), A.sessions(spark, d), _titles(spark, d), LIMIT)
    return out.select("requestId", "movieId", "neighbors", "positives", *r6("predicted"), *big("rank"))


@query(PREDICT + " select s.requestId, s.movieId, round(raw, 6) as raw, round(predicted, 6) as predicted from sessions s left join predicted p on p.requestId = s.requestId and p.movieId = s.movieId")
def user_knn_predict(spark, d):
    near, c = _near(spark, d)
    return neighbours.user_predictions(near, c, wanted=A.sessions(spark, d)).select("requestId", "movieId", *r6("raw", "predicted"))


# Factorization

BIAS = RATED + """, mu as (select avg(rating) as mu from ratings), bi as (select movieId, sum(rating - mu) / (count(*) + 10) as bi from ratings, mu group by 1), bu as (select userId, sum(rating - mu - bi) / (count(*) + 10) as bu from ratings join bi using (movieId), mu group by 1),
guessed as (select userId, movieId, rating, greatest(0.5, least(mu + bi + bu, 5)) as predicted from ratings join bi using (movieId) join bu using (userId), mu)"""


@query(BIAS + " select userId, movieId, rating, round(predicted, 6) as predicted, round(rating - predicted, 6) as error from guessed")
def bmf_bias_baseline(spark, d):
    return factors.bias_baseline(A.ratings(spark, d)).select("userId", "movieId", "rating", *r6("predicted", "error"))


@query(BIAS + " select round(avg(abs(predicted - rating)), 6) as mae, round(sqrt(avg((predicted - rating) * (predicted - rating))), 6) as rmse, round(avg(predicted - rating), 6) as bias, round(quantile_disc(abs(predicted - rating), 0.95), 6) as p95, 100.0::double as coverage from guessed")
def eval_prediction_metrics(spark, d):
    return evaluation.prediction_metrics(factors.bias_baseline(written(A.ratings(spark, d)))).select(*r6("mae", "rmse", "bias", "p95"), "coverage")


def _vectors(spark, d):
    return A.read(spark, d, "embeddings").select(col("vec_id").alias("movieId"), ((col("label") - 4.5) / 10).alias("bias"), F.transform("embedding", lambda x: x.cast("double")).alias("factors"))


def _folded(spark, d):
    s = A.sessions(spark, d).withColumn("place", F.struct("timestamp", "movieId"))
    return factors.fold_in(s, _vectors(spark, d), 3.0)


@query()
def bmf_fold_in(spark, d):
    return _folded(spark, d).select("requestId", *r6("bias"), F.transform("factors", lambda x: F.round(x, 6)).alias("factors"))


@query()
def bmf_holdout_error(spark, d):
    return factors.holdout_error(A.rated(spark, d), factors=16, iterations=5, regular=0.3)


VECTORS = "with v as (select vec_id, (label - 4.5) / 10 as bias, list_transform(embedding, lambda x: x::double) as f from embeddings), u as (select * from v where vec_id < 10)"


@query("""with v as (select vec_id, label, (label - 4.5) / 10 as bias, list_transform(embedding, lambda x: x::double) as f from embeddings),
d as (select a.vec_id as requestId, b.vec_id as movieId, a.bias as bu, b.bias as bi, list_inner_product(a.f, b.f) as latent from (select * from v where vec_id % 50 = 0) a, v b),
p as (select *, 3 + bu + bi + latent as raw, greatest(0.5, least(3 + bu + bi + latent, 5)) as predicted from d)
select m as mode, requestId, movieId, round(case m when 'predicted_rating' then predicted when 'personalized_lift' then predicted - (3 + bi) when 'latent_affinity' then latent else latent + 0.25 * bi end, 6) as score from p, (values ('predicted_rating'), ('personalized_lift'), ('latent_affinity'), ('hybrid_personalized_bias')) t(m) where predicted > 3.0""")
def bmf_score_modes(spark, d):
    """Vectors whose id is divisible by 50 as temporary users, scored against all vectors in the four modes in one pass."""
    v = _vectors(spark, d)
    users = v.where("movieId % 50 = 0").withColumnRenamed("movieId", "requestId")
    scored = factors.mode_scores(users, v, 3.0)
    rounded = scored.select("requestId", "movieId", *(round_away(col(m), 6).alias(m) for m in factors.MODES))
    return rounded.unpivot(["requestId", "movieId"], list(factors.MODES), "mode", "score")


# Catalogue


@query(FULL + " select movieId, array_to_string(publicBlockedTerms, '|') as publicBlockedTerms from items")
def blocked_terms(spark, d):
    return A.items(spark, d).select("movieId", text("publicBlockedTerms"))


@query(FULL + " select movieId, cert, suitabilityCategory from items")
def suitability(spark, d):
    return A.items(spark, d).select("movieId", catalogue.certification(col("us"), col("es")).alias("cert"), "suitabilityCategory")


@query(FULL + " select movieId, standDisplayScore, array_to_string(standDisplayReasons, '|') as standDisplayReasons from items")
def stand_score(spark, d):
    return A.items(spark, d).select("movieId", "standDisplayScore", text("standDisplayReasons"))


@query(FULL + " select movieId, array_to_string(publicExclusionReasons, '|') as publicExclusionReasons from items")
def exclusion_reasons(spark, d):
    return A.items(spark, d).select("movieId", text("publicExclusionReasons"))


ORDER = "standDisplayScore desc, case suitabilityCategory when 'family_friendly' then 0 when 'teen' then 1 else 2 end, recencyScore desc, candidateScore desc, dataReliabilityScore desc, ratingCount desc, popularity desc, title, movieId"


def _public(spark, d):
    return catalogue.ranked(A.items(spark, d).where("isPublic").drop("overview", "texts"), catalogue.public_order())


@query(FULL + f" select movieId, title, standDisplayScore, suitabilityCategory, row_number() over (order by {ORDER}) as \"rank\" from public")
def public_catalog(spark, d):
    return _public(spark, d).select("movieId", "title", "standDisplayScore", "suitabilityCategory", *big("rank"))


PARTS = """, flags as (select movieId, len(publicExclusionReasons) = 0 as pub, len(publicExclusionReasons) > 0 and isCollaborative and coalesce(filteredRatingCount, 1) > 0 as sup, list_has_any(publicExclusionReasons, ['documentary', 'short_runtime']) as twice from items),
parts as (select movieId, 'public' as part from flags where pub union all select movieId, 'support' from flags where sup union all select movieId, 'excluded' from flags where not pub and (not sup or twice))"""


def _parts(spark, d, it=None):
    return catalogue.partition(A.items(spark, d) if it is None else it)


@query(FULL + PARTS + " select movieId, part from parts")
def dataset_partition(spark, d):
    return _parts(spark, d)


@query(FULL + PARTS + " select (count(*) filter (p is null))::bigint as uncovered, (count(*) filter (p = 1 and o = 1))::bigint as overlapping, count(*)::bigint as movies from (select distinct movieId from items) left join (select movieId, max((part = 'public')::int) as p, max((part <> 'public')::int) as o from parts group by 1) using (movieId)")
def partition_law(spark, d):
    return catalogue.partition_law(_parts(spark, d), A.items(spark, d))


@query(FULL + """, base as (select movieId, suitabilityCategory, list_filter(publicExclusionReasons, lambda x: x not in ('adult_or_sensitive', 'unknown_suitability', 'family_only_excludes_teen')) as base from items),
allowed as (select *, p, case p when 'family_only' then suitabilityCategory = 'family_friendly' when 'family_and_teen' then suitabilityCategory in ('family_friendly', 'teen') else suitabilityCategory <> 'unknown' end as ok from base, (values ('family_only'), ('family_and_teen'), ('all_classified')) t(p))
select p as policy, movieId, case when len(base) = 0 and ok then 'public' else 'support' end as part, array_to_string(case when ok then base else list_concat(base, [case suitabilityCategory when 'unknown' then 'unknown_suitability' when 'teen' then 'family_only_excludes_teen' else 'adult_or_sensitive' end]) end, '|') as reasons from allowed""")
def audience_reconfigure(spark, d):
    items, out = A.items(spark, d), None
    for p in catalogue.AUDIENCES:
        one = catalogue.reconfigure(items, p).select(F.lit(p).alias("policy"), "movieId", "part", text("reasons"))
        out = one if out is None else out.unionByName(one)
    return out


COVER = FULL + """, covered as (select movieId, round((case when coalesce(overview, '') <> '' then 0.35::double else 0 end) + (case when len(genres) > 0 then 0.25::double else 0 end) + (case when len(keywords) > 0 then 0.2::double else 0 end) + (case when len(userTags) > 0 then 0.2::double else 0 end), 4) as contentCoverage,
round(least(1.0::double, coalesce(filteredRatingCount, ratingCount, 0) / 250.0::double), 4) as collaborativeCoverage from items)"""


@query(COVER + " select * from covered")
def coverage(spark, d):
    return catalogue.coverage(A.items(spark, d)).select("movieId", "contentCoverage", "collaborativeCoverage")


@query(COVER + " select count(*)::bigint as movies, round(avg(contentCoverage), 2) as content, round(avg(collaborativeCoverage), 2) as collaborative, least(1.0::double, round((avg(contentCoverage) + avg(collaborativeCoverage)) / 2 + 0.11, 2)) as hybrid from covered")
def catalog_status(spark, d):
    return catalogue.status(catalogue.coverage(A.items(spark, d)))


@query(A.cte("tags", "movies") + " select movieId, title, year::bigint as year from movies where contains(lower(title), 'bolt') and list_contains(genres, 'Drama')")
def catalog_search(spark, d):
    return catalogue.search(A.movies(spark, d), " Bolt", "drama").select("movieId", "title", *big("year"))


@query(FULL + f" select movieId, standDisplayScore, (select count(*) from public)::bigint as total, ceil((select count(*) from public) / 24.0)::bigint as pages from public order by {ORDER} limit 24 offset 24")
def catalog_page(spark, d):
    return catalogue.page(A.items(spark, d).where("isPublic"), catalogue.public_order(), 2, 24).select("movieId", "standDisplayScore", "total", "pages")


# Content

TOKENS = """, n as (select count(*) as n from items),
tok as (select distinct movieId, 'genres' as block, 'genre:' || replace(trim(regexp_replace(lower(unnest(genres)), '[^a-z0-9]+', ' ', 'g')), ' ', '_') as feature from items
 union all select distinct movieId, 'userTags', 'tag:' || replace(trim(regexp_replace(lower(unnest(userTags)), '[^a-z0-9]+', ' ', 'g')), ' ', '_') from items
 union all select distinct movieId, 'keywords', 'keyword:' || replace(trim(regexp_replace(lower(unnest(keywords)), '[^a-z0-9]+', ' ', 'g')), ' ', '_') from items
 union all select movieId, 'suitability', 'suitability:' || suitabilityCategory from items union all select movieId, 'context', 'context:' || floor(year / 10)::int * 10 || 's' from items),
dfs as (select block, feature, count(*) as df from tok group by 1, 2),
structured as (select movieId, block, feature, case when block in ('userTags', 'keywords') then ln((1 + n) / (1 + df)::double) + 1 else 1.0::double end as weight from tok join dfs using (block, feature), n)"""
INDEX = FULL + TOKENS + """, b1 as (select movieId, block, feature, weight / sqrt(sum(weight * weight) over (partition by movieId, block)) * case block when 'genres' then 1.0 when 'userTags' then 0.95 when 'keywords' then 0.90 when 'suitability' then 0.25 else 0.20 end as weight from structured),
idx as (select movieId, block, feature, weight / sqrt(sum(weight * weight) over (partition by movieId)) as weight from b1)"""


def _first(spark, d):
    """Overviews of only their first character but spaces."""
    return A.texts(spark, d).withColumn("overview", F.substring(F.trim("overview"), 1, 1))


def _fields(spark, d, *more):
    """What the blocks of the items read, and the columns ``more``, written once. Of an overview only its first character but spaces comes along, as texts would be dealt for every join."""
    it = A.items(spark, d, overviews=_first(spark, d))
    return stored(it.select("movieId", "genres", "userTags", "keywords", F.array("suitabilityCategory").alias("suitability"), F.array(audit.decade()).alias("context"), *more))


def _structured(spark, d, it=None, idf=True):
    it = _fields(spark, d) if it is None else it
    return [content.structured_block(it, c, p, i and idf) for c, p, i in (("genres", "genre", False), ("userTags", "tag", True), ("keywords", "keyword", True), ("suitability", "suitability", False), ("context", "context", False))]


def _index(spark, d):
    return content.index(_structured(spark, d))


def _whole_index(spark, d):
    """The index of all six blocks; that of :func:`_index` leaves the texts out. Items have one row for each text of their movie, and one if it has none: the texts join the written movies."""
    it = _fields(spark, d)
    overviews = A.texts(spark, d).join(it.select("movieId").distinct(), "movieId", "right")
    return content.index([*_structured(spark, d, it), content.text_block(overviews)])


@query(FULL + TOKENS + " select movieId, block, feature, round(weight, 6) as weight from structured")
def tfidf_structured(spark, d):
    out = None
    for b in _structured(spark, d):
        out = b if out is None else out.unionByName(b)
    return out.select("movieId", "block", "feature", *r6("weight"))


@query(INDEX + " select movieId, feature, round(weight, 6) as weight from idx")
def content_index(spark, d):
    return _index(spark, d).select("movieId", "feature", *r6("weight"))


@query("""with w as (select doc_id, list_filter(string_split_regex(lower(strip_accents(text)), '[^\\p{L}\\p{N}_]+'), lambda x: length(x) > 1) as w from documents),
g as (select doc_id, unnest(list_concat(w, case when len(w) > 1 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else [] end)) as term from w),
tf as (select doc_id, term, count(*) as tf from g group by 1, 2), by_term as (select term, count(*) as df, sum(tf) as total from tf group by 1), n as (select count(*) as n from documents),
kept as (select term, ln((1 + n) / (1 + df)::double) + 1 as idf from by_term, n where df >= 2 and df <= 0.65 * n order by total desc, term limit 5000)
select doc_id as movieId, 'text:' || term as feature, round((1 + ln(tf)) * idf, 6) as weight from tf join kept using (term)""")
def tfidf_text(spark, d):
    return content.text_block(A.texts(spark, d)).select("movieId", "feature", *r6("weight"))


PROFILE_TAIL = SESSIONS + """, met as (select requestId, (rating - 3) / 2.0::double as w, feature, weight from sessions join idx using (movieId) where rating <> 3),
both_ as (select requestId, 'combined' as kind, feature, sum(w * weight) as x from met group by 1, 3 union all select requestId, case when w > 0 then 'positive' else 'negative' end, feature, sum(abs(w) * weight) from met group by 1, 2, 3),
profiles as (select requestId, kind, feature, x / sqrt(sum(x * x) over (partition by requestId, kind)) as weight from both_ where abs(x) > 1e-12)"""

PROFILE = INDEX + PROFILE_TAIL


@query(PROFILE + " select requestId, kind, feature, round(weight, 6) as weight from profiles")
def user_profile(spark, d):
    return content.profile(A.sessions(spark, d), _index(spark, d)).select("requestId", "kind", "feature", *r6("weight"))


SIMILAR_TAIL = """, sims as (select requestId, movieId, sum(p.weight * i.weight) as similarity from profiles p join idx i using (feature) where kind = 'combined' group by 1, 2),
similar_ as (select * from (select s.*, row_number() over (partition by s.requestId order by round(similarity, 9) desc, lower(title), s.movieId) as rnk from sims s join movies m on m.movieId = s.movieId anti join sessions x on x.requestId = s.requestId and x.movieId = s.movieId where abs(similarity) > 1e-12) where rnk <= 100)"""

SIMILAR = PROFILE + SIMILAR_TAIL


def _titles(spark, d):
    return A.read(spark, d, "part").select(col("p_partkey").alias("movieId"), col("p_name").alias("title"))


def _similar(spark, d):
    return content.similarity(A.sessions(spark, d, A.rated(spark, d)), content.packed(_index(spark, d))[0], _titles(spark, d))


@query(SIMILAR + " select requestId, movieId, round(similarity, 6) as similarity from similar_")
def content_similarity(spark, d):
    return _similar(spark, d).select("requestId", "movieId", *r6("similarity"))


@query(SIMILAR + " select requestId, movieId, round(0.88::double * greatest(similarity, 0) + 0.12::double * standDisplayScore, 6) as score from similar_ join items using (movieId)")
def content_score(spark, d):
    return content.content_score(_similar(spark, d), A.items(spark, d, overviews=_first(spark, d))).select("requestId", "movieId", *r6("score"))


# The text block as in tfidf_text, over the items.
WHOLE = FULL + TOKENS + """, texts as (select movieId, list_filter(string_split_regex(lower(strip_accents(overview)), '[^\\p{L}\\p{N}_]+'), lambda x: length(x) > 1) as w from items),
grams as (select movieId, unnest(list_concat(w, case when len(w) > 1 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else [] end)) as term from texts),
tfs as (select movieId, term, count(*) as tf from grams group by 1, 2), by_term as (select term, count(*) as df, sum(tf) as total from tfs group by 1),
chosen as (select term, ln((1 + n) / (1 + df)::double) + 1 as idf from by_term, n where df >= 2 and df <= 0.65 * n order by total desc, term limit 5000),
blocks as (select movieId, block, feature, weight from structured union all select movieId, 'text', 'text:' || term, (1 + ln(tf)) * idf from tfs join chosen using (term)),
b1 as (select movieId, block, feature, weight / sqrt(sum(weight * weight) over (partition by movieId, block)) * case block when 'genres' then 1.0 when 'userTags' then 0.95 when 'keywords' then 0.90 when 'text' then 0.70 when 'suitability' then 0.25 else 0.20 end as weight from blocks),
idx as (select movieId, block, feature, weight / sqrt(sum(weight * weight) over (partition by movieId)) as weight from b1)"""


@query(WHOLE + " select movieId, feature, round(weight, 6) as weight from idx")
def content_index_whole(spark, d):
    return _whole_index(spark, d).select("movieId", "feature", *r6("weight"))


@query()  # five million rows already at sf 0.01; its twin stands in those of the two queries below
def user_profile_whole(spark, d):
    return content.profile(A.sessions(spark, d), _whole_index(spark, d)).select("requestId", "kind", "feature", *r6("weight"))


def _whole_similar(spark, d, vectors=None, r=None):
    """``vectors`` are the packed index and ``r`` the :func:`A.rated` ratings if the query has them."""
    vectors = vectors or content.packed(_whole_index(spark, d))[0]
    return content.similarity(A.sessions(spark, d, r or A.rated(spark, d)), vectors, _titles(spark, d))


@query(WHOLE + PROFILE_TAIL + SIMILAR_TAIL + " select requestId, movieId, round(similarity, 6) + 0.0::double as similarity from similar_")
def content_similarity_whole(spark, d):
    return _whole_similar(spark, d).select("requestId", "movieId", (F.round("similarity", 6) + 0.0).alias("similarity"))  # no negative zero


@query(WHOLE + PROFILE_TAIL + SIMILAR_TAIL + " select requestId, movieId, round(0.88::double * greatest(similarity, 0) + 0.12::double * standDisplayScore, 6) as score from similar_ join items using (movieId)")
def content_score_whole(spark, d):
    r = A.rated(spark, d)
    return content.content_score(_whole_similar(spark, d, r=r), A.items(spark, d, r, _first(spark, d))).select("requestId", "movieId", *r6("score"))


@query(WHOLE + PROFILE_TAIL + """, shown as (select *, replace(regexp_replace(feature, '^[a-zA-Z]+:', ''), '_', ' ') as display, regexp_matches(feature, '^(context|suitability):') as plain from profiles where kind <> 'combined' and weight > 0),
singles as (select * from shown qualify row_number() over (partition by requestId, kind, display order by round(weight, 9) desc, feature) = 1)
select requestId, kind, display, round(weight, 6) as weight, row_number() over (partition by requestId, kind order by plain, round(weight, 9) desc, feature) as "rank" from singles qualify "rank" <= 10""")
def profile_signals(spark, d):
    return content.best_signals(A.sessions(spark, d), *content.packed(_whole_index(spark, d))).select("requestId", "kind", "display", *r6("weight"), *big("rank"))


@query()
def mmr(spark, d):
    r, (vectors, _) = A.rated(spark, d), content.packed(_whole_index(spark, d))
    return content.diversified(content.content_score(_whole_similar(spark, d, vectors, r), A.items(spark, d, r, _first(spark, d))), vectors).select("requestId", "movieId", *r6("mmr"), *big("rank"))


@query(FULL + SESSIONS + """ select requestId, case when f >= t + 2 then 'family' when t >= f + 2 then 'teen' else 'mixed' end as style from (select requestId, sum(case when suitabilityCategory = 'family_friendly' then 2 else 0 end + case when list_has_any(genres, ['Animation', 'Family']) then 1 else 0 end) as f,
sum(case when suitabilityCategory = 'teen' then 2 else 0 end + case when list_has_any(genres, ['Action', 'Thriller']) then 1 else 0 end) as t from sessions join items using (movieId) where rating >= 4 group by 1)""")
def profile_style(spark, d):
    return content.style(A.sessions(spark, d), A.items(spark, d))


# Evaluation

CASES = RATED + f""", {HELD}, polar as (select userId, movieId, rating, case when rating >= 4 then 'positive' when rating <= 2 then 'negative' end as polarity from ratings where userId in (select userId from solid) and (rating >= 4 or rating <= 2)),
drawn as (select *, row_number() over (partition by userId, polarity order by sha256('42|' || userId || '|' || movieId), movieId) as n from polar),
cases as (select userId, movieId, rating, case when polarity = 'positive' and n <= 5 then 'holdout' when polarity = 'positive' and n <= 25 then 'input' when polarity = 'negative' and n <= 5 then 'input' end as role from drawn)"""


def _cases(spark, d, r=None):
    r = A.rated(spark, d) if r is None else r
    return evaluation.cases(r, ratings.solid_users(r, 30, 10, 5), 20, 5, 5)


@query(CASES + " select * from cases where role is not null")
def eval_cases(spark, d):
    return _cases(spark, d)


def _recommended(spark, d, r=None):
    """Popularity lists for the evaluation cases, from the other users' ratings."""
    r = A.rated(spark, d) if r is None else r
    c = stored(_cases(spark, d, r))
    train = catalogue.rating_summary(ratings.train_split(r, c))
    ranking = catalogue.ranked(train.select("movieId", (col("averageRating") * col("ratingCount") / (col("ratingCount") + 25)).alias("score")), [round_away(col("score"), 9).desc(), col("movieId")])
    inputs = c.where("role = 'input'").select(col("userId").alias("requestId"), "movieId")
    return ratings.fillers(ranking, c.select(col("userId").alias("requestId"), F.lit(0).alias("have")).distinct(), inputs, 50).select(col("requestId").alias("caseId"), "movieId", "rank"), c


RECOMMENDED = CASES + """, train as (select movieId, count(*) as n, round_even(avg(rating), 3) as m from ratings where userId not in (select userId from cases where role is not null) group by 1),
ranking as (select movieId, row_number() over (order by round(m * n / (n + 25.0::double), 9) desc, movieId) as rnk from train),
rec as (select * from (select c.userId as caseId, r.movieId, row_number() over (partition by c.userId order by r.rnk) as k from (select distinct userId from cases where role is not null) c join (select * from ranking where rnk <= 80) r on true anti join (select * from cases where role = 'input') i on i.userId = c.userId and i.movieId = r.movieId) where k <= 50),
hold as (select userId as caseId, movieId from cases where role = 'holdout')"""


@query(RECOMMENDED + """, hits as (select r.caseId, k, row_number() over (partition by r.caseId order by k) as so_far from rec r join hold h on h.caseId = r.caseId and h.movieId = r.movieId where k <= 50),
by_case as (select caseId, count(*) as hits, sum(1 / log2(k + 1)) as dcg, min(k) as first, sum(so_far / k::double) as precisions from hits group by 1), size as (select caseId, count(*) as h from hold group by 1)
select s.caseId, (coalesce(hits, 0) > 0)::int::double as hit, round(coalesce(hits, 0) / h::double, 6) as recall, round(coalesce(hits, 0) / 50.0::double, 6) as precision, round(coalesce(dcg / list_sum(list_transform(range(1, least(h, 50) + 1), lambda i: 1 / log2(i + 1))), 0), 6) as ndcg, round(coalesce(1 / first::double, 0), 6) as mrr, round(coalesce(precisions / least(h, 50), 0), 6) as "map" from size s left join by_case b on b.caseId = s.caseId""")
def eval_ranking_metrics(spark, d):
    rec, c = _recommended(spark, d)
    return evaluation.ranking_metrics(rec, c.where("role = 'holdout'").select(col("userId").alias("caseId"), "movieId"), 50).select("caseId", "hit", *r6("recall", "precision", "ndcg", "mrr", "map"))


@query(A.cte(*A.ITEMS) + RECOMMENDED.removeprefix(RATED) + """ select (count(*) filter (i.movieId is null))::bigint as outside, (count(*) filter (p.movieId is null))::bigint as notPublic, (count(*) filter (s.movieId is not null))::bigint as alreadyRated, round(100.0::double * count(distinct p.movieId) / (select count(*) from public), 6) as catalogueCoverage,
(select count(*) from (select caseId from rec group by 1 having count(*) < 50))::bigint as belowLimit, count(distinct rec.caseId)::bigint as cases from rec left join items i on i.movieId = rec.movieId left join public p on p.movieId = rec.movieId left join ratings s on s.userId = rec.caseId and s.movieId = rec.movieId""")
def eval_coverage(spark, d):
    r = A.rated(spark, d)
    rec, it = stored(_recommended(spark, d, r)[0]), stored(A.items(spark, d, r).select("movieId", "isPublic"))  # both are read several times
    return evaluation.safety(rec, it.where("isPublic"), it, A.sessions(spark, d, r), 50).select("outside", "notPublic", "alreadyRated", *r6("catalogueCoverage"), "belowLimit", "cases")


@query(A.cte(*A.ITEMS) + RECOMMENDED.removeprefix(RATED) + " select caseId, round(avg(ratingCount), 6) as mean, median(ratingCount)::double as median from rec join items using (movieId) group by 1")
def eval_catalogue_fields(spark, d):
    r = A.rated(spark, d)
    return evaluation.catalogue_fields(_recommended(spark, d, r)[0], A.items(spark, d, r), "ratingCount").select("caseId", *r6("mean"), "median")


@query("select quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.99) as p99, round(avg(value), 6) as mean, max(value) as max from events")
def latency_percentiles(spark, d):
    return evaluation.nearest_rank(A.read(spark, d, "events"), "value").select("p50", "p95", "p99", *r6("mean"), "max")


# Audit

FRAME = FULL + PARTS + ", frame as (select part as partition, i.* from parts join items i using (movieId))"


def _frame(spark, d):
    it = stored(A.items(spark, d).drop("texts").withColumn("overview", F.substring("overview", 1, 1)))  # read twice; the audit asks only whether a text is there
    return _parts(spark, d, it).withColumnRenamed("part", "partition").join(it, "movieId")


@query(FRAME + " select partition, value, count(distinct movieId)::bigint as movies, round(count(distinct movieId) * 100.0::double / sum(count(distinct movieId)) over (partition by partition), 4) as share from (select partition, movieId, case when language = '' then '(missing)' else language end as value from frame) group by 1, 2")
def count_by_field(spark, d):
    return audit.count_by(_frame(spark, d), "language")


@query(FRAME + """, rows_ as (select partition, movieId, title, unnest(list_distinct(genres)) as value from frame), named as (select partition, value, title, row_number() over (partition by partition, value order by title) as n from (select distinct partition, value, title from rows_))
select partition, value, count(distinct movieId)::bigint as movies, (select string_agg(title, ' | ' order by n) from named x where x.partition = r.partition and x.value = r.value and n <= 8) as examples from rows_ r group by 1, 2""")
def explode_field(spark, d):
    return audit.explode_by(_frame(spark, d), "genres")


@query(FRAME + """ select partition, count(distinct movieId)::bigint as movies, (count(*) filter (ratingCount > 0))::bigint as rated, (count(*) filter (coalesce(overview, '') <> ''))::bigint as withOverview, round(avg(standDisplayScore), 4) as meanScore, round(avg(popularity), 4) as meanPopularity, round(avg(ratingCount), 4) as meanCount, median(ratingCount)::double as medianCount, (count(*) filter (list_has_any(genres, ['Horror', 'Crime', 'War', 'Thriller'])))::bigint as sensitive from frame group by 1""")
def partition_comparison(spark, d):
    return audit.compare(_frame(spark, d))


@query(FULL + """ select movieId, array_to_string(list_filter([case when ratingCount < 250 then 'low_rating_count' end, case when popularity < 10 then 'low_tmdb_popularity' end, case when standDisplayScore < 0.5 then 'low_stand_display_score' end,
case when language not in ('en', 'es') and (ratingCount < 250 or popularity < 10 or standDisplayScore < 0.5) then 'uncommon_original_language' end, case when suitabilityCategory = 'teen' and list_has_any(genres, ['Horror', 'Crime', 'War', 'Thriller']) then 'teen_with_sensitive_genres' end,
case when list_contains(standDisplayReasons, 'stand_family_certified_teen_suitability') then 'family_certified_teen' end, case when ratingCount < 250 and popularity < 10 and standDisplayScore < 0.5 then 'low_public_recognition' end, case when coalesce(overview, '') = '' then 'missing_display_overview' end, case when coalesce(title, '') = '' then 'missing_display_title' end], lambda x: x is not null), '|') as flags from items""")
def audit_flags(spark, d):
    return A.items(spark, d).select("movieId", audit.flags().alias("flags"))


@query(FULL + " select language as value, count(distinct movieId)::bigint as movies from items where low_access group by 1")
def low_access(spark, d):
    return audit.low_access(A.items(spark, d), "language")


@query(FULL + f", r as (select suitabilityCategory as c, row_number() over (order by {ORDER}) as rnk from public) select t::bigint as top, (select count(*) from r where t = 0 or rnk <= t)::bigint as movies, (select count(*) from r where (t = 0 or rnk <= t) and c = 'family_friendly')::bigint as family, (select count(*) from r where (t = 0 or rnk <= t) and c = 'teen')::bigint as teen from (values (0), (100), (250)) v(t)")
def family_simulation(spark, d):
    return audit.family_simulation(_public(spark, d)).select(*big("top"), "movies", "family", "teen")


@query(FRAME + """, t as (select distinct movieId, partition, lower(trim(unnest(userTags))) as tag, 'userTags' as source from frame union select distinct movieId, partition, lower(trim(unnest(keywords))), 'keywords' from frame)
select tag, count(distinct (movieId, partition))::bigint as rows, string_agg(distinct source, ',' order by source) as sources, string_agg(distinct partition, ',' order by partition) as roles from t where tag <> '' group by 1""")
def tag_export(spark, d):
    return audit.tag_export(_frame(spark, d), {"userTags": "userTags", "keywords": "keywords"})


@query(BASE + " select y::bigint as year, n::bigint as ratings, (select count(*) from candidates where year >= y and ratingCount >= n)::bigint as movies from (values (1985), (1990), (1995), (2000), (2010), (2020)) a(y), (values (10), (20), (30), (40)) b(n)")
def threshold_matrix(spark, d):
    return audit.thresholds(A.candidates(spark, d), [1985, 1990, 1995, 2000, 2010, 2020], [10, 20, 30, 40]).select(*big("year", "ratings"), "movies")


@query(FULL + " select movieId, title, value from (select movieId, title, popularity as value from items order by popularity desc, ratingCount desc, title, movieId limit 20)")
def inspection_tops(spark, d):
    return audit.tops(A.items(spark, d), "popularity")


@query(FULL + " select case when runtime < 80 then '<80' when runtime < 100 then '80-99' when runtime < 120 then '100-119' when runtime < 150 then '120-149' else '150+' end as value, count(*)::bigint as movies from items group by 1")
def runtime_distribution(spark, d):
    return audit.distribution(A.items(spark, d), audit.runtime_bucket())


@query(FULL + " select f as field, (case f when 'overview' then (select count(overview) from items) when 'posterPath' then (select count(posterPath) from items) else (select count(tmdbId) from items) end)::bigint as present, (select count(*) from items)::bigint as rows from (values ('overview'), ('posterPath'), ('tmdbId')) t(f)")
def completeness(spark, d):
    return audit.completeness(A.items(spark, d), ["overview", "posterPath", "tmdbId"])


# Explanations


@query("select s_nationkey::bigint as groupKey, arg_min(s_suppkey, sha256('pick|' || s_nationkey || '|' || s_suppkey)) as option from supplier group by 1")
def stable_choice_sha256(spark, d):
    s = A.read(spark, d, "supplier").select(col("s_nationkey").cast("long").alias("groupKey"), col("s_suppkey").alias("option"))
    return explain.choose(s, "groupKey", "option", "pick")


def _contributions(spark, d):
    r = A.rated(spark, d)
    knn = stored(_knn(spark, d, r).select("movieId", "neighborId", "similarity"))  # the lists and what speaks for them
    hits = A.sessions(spark, d, r).join(knn.select(col("movieId").alias("m"), "neighborId", "similarity"), col("m") == col("movieId")).select("requestId", col("neighborId").alias("target"), col("movieId").alias("sourceId"), "rating", (col("similarity") * (col("rating") - 3)).alias("contribution"))
    served = _item_served(spark, d, r, knn).select("requestId", col("movieId").alias("target"), "rank")
    return hits.join(served, ["requestId", "target"]).withColumnRenamed("target", "movieId")


@query()
def item_knn_evidence(spark, d):
    return explain.evidence(_contributions(spark, d)).select("requestId", "movieId", *big("rank"), "anchor", "evidence")


@query()
def explanations(spark, d):
    titles = A.movies(spark, d).select("movieId", "title")
    contributions = stored(_contributions(spark, d))
    best = contributions.groupBy("requestId", "movieId").agg(F.max("contribution").alias("contribution"))
    found = explain.evidence(contributions).select("requestId", "movieId", "anchor").join(best, ["requestId", "movieId"])
    named = found.join(titles.toDF("movieId", "movie"), "movieId").join(titles.toDF("a", "anchorTitle"), col("a") == col("anchor"))
    return explain.render(named.select("requestId", "movieId", "movie", col("anchorTitle").alias("anchor"), explain.strength(col("contribution"), F.lit(False)).alias("strength")))


SIGNALS = {"genres": "genre", "userTags": "tag", "keywords": "keyword", "text": "text"}


def _signal(c):
    """Features under the prefixes of signals."""
    for block, name in SIGNALS.items():
        c = F.regexp_replace(c, f"^{block}:", f"{name}:")
    return c


def _signals(best, profiles, top, vectors, ids):
    """Signals of recommended movies, strongest first, and those of the requests' profiles, of which ``top`` are the strongest."""
    ordered = lambda n, v: F.transform(F.array_sort(F.collect_list(F.struct(n, v))), lambda x: x[v])
    met = content.shared_signals(best, profiles, vectors).join(ids.select("f", _signal(col("feature")).alias("signal")), "f")
    signals = met.groupBy("requestId", "movieId").agg(ordered("n", "signal").alias("signals"))
    top = top.withColumn("signal", _signal(col("feature"))).groupBy("requestId").pivot("kind", ["positive", "negative"]).agg(ordered("rank", "signal"))
    return signals, top


@query()
def content_evidence_signals(spark, d):
    r, (vectors, ids) = A.rated(spark, d), content.packed(_whole_index(spark, d))
    s, it = A.sessions(spark, d, r), stored(A.items(spark, d, r, _first(spark, d)).select("movieId", "title", "genres", "standDisplayScore"))
    best = stored(content.content_score(_whole_similar(spark, d, vectors, r), it).where("rank <= 10").select("requestId", "movieId"))
    signals, top = _signals(best, content.profile_vectors(s, vectors, ("positive",)), content.best_signals(s, vectors, ids), vectors, ids)
    rows, _ = content_evidence.evidence(signals.join(it.select("movieId", "genres"), "movieId"), top)
    return rows.select("requestId", "movieId", "display", "source", *r6("score"), "generic", *big("place"))
