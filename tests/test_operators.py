"""Hand-computed values of the scores, models and metrics."""

import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from velum.functions import text
from velum.operators import audit, catalogue, content, evaluation, explain, factors, lists, neighbours, ratings

ROWS = [(1, 10, 5.0), (1, 20, 4.0), (1, 30, 1.0), (2, 10, 4.0), (2, 20, 5.0), (3, 10, 2.0), (3, 20, 1.0), (3, 30, 5.0), (4, 20, 3.0), (4, 30, 4.5)]


@pytest.fixture(scope="module")
def rated(spark):
    return spark.createDataFrame(ROWS, "userId long, movieId long, rating double").cache()


def session(spark, rows):
    return spark.createDataFrame([(9, m, r) for m, r in rows], "requestId long, movieId long, rating int")


def test_user_stats(rated):
    got = {r.userId: (r.n, round(r.mean, 6), round(r.std, 6)) for r in ratings.user_stats(rated).collect()}
    assert got == {1: (3, 3.333333, 1.699673), 2: (2, 4.5, 0.5), 3: (3, 2.666667, 1.699673), 4: (2, 3.75, 0.75)}


def test_item_neighbours(spark, rated):
    got = {(r.movieId, r.neighborId): (round(r.similarity, 6), r.support) for r in neighbours.item_neighbours(rated, 2, 10).collect()}
    assert got[10, 20] == (0.876714, 3) and got[30, 10] == (0.328798, 2) and got[20, 30] == (0.463278, 3) and len(got) == 6
    model = neighbours.item_neighbours(rated, 2, 10)
    out = neighbours.item_recommend(session(spark, [(10, 5), (20, 2)]), model, spark.createDataFrame([(30,)], "movieId long"), 10).collect()
    assert len(out) == 1 and round(out[0].score, 6) == 0.194318 and round(out[0].preference, 6) == 0.245328 and round(out[0].match, 2) == 56.13


def test_user_neighbours(spark, rated):
    got = neighbours.user_neighbours(session(spark, [(10, 5), (20, 2)]), ratings.centred(rated)).orderBy("rank").collect()
    assert [(r.userId, r.overlap, round(r.raw, 6), round(r.similarity, 6)) for r in got] == [(1, 2, 0.664364, 0.049212), (3, 2, 0.083045, 0.006152)]


def test_item_neighbour_ties_go_by_id(spark):
    """Movies 2 and 3 are proportional: their cosines with 1 are equal, but for the last bits of 3's, which are larger."""
    rows = [(u, m, r) for m, rs in ((1, (0.5, 2.0, 2.5)), (2, (0.5, 0.5, 0.5)), (3, (1.5, 1.5, 1.5))) for u, r in enumerate(rs)]
    model = neighbours.item_neighbours(spark.createDataFrame(rows, "userId long, movieId long, rating double"), 2, 10)
    assert [r.neighborId for r in model.where("movieId = 1").orderBy("rank").collect()] == [2, 3]


@pytest.mark.parametrize("length", [2, 128])
def test_sums_over_lists_equal_loops(spark, monkeypatch, length):
    monkeypatch.setattr(lists, "LENGTH", length)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # keys go on over batches
    try:
        rnd = random.Random(1)
        rows = {(u, m): rnd.randint(1, 10) / 2 for u in range(12) for m in range(9) if rnd.random() < 0.7}
        r = spark.createDataFrame([(u, m, x) for (u, m), x in rows.items()], "userId long, movieId long, rating double")
        pairs = {(a, b): [(x, rows[u, b]) for (u, m), x in rows.items() if m == a and (u, b) in rows] for a in range(9) for b in range(9) if a != b}
        norm = {m: math.sqrt(sum(x * x for (_, n), x in rows.items() if n == m)) for m in range(9)}
        want = {(a, b): (len(v), round(sum(x * y for x, y in v) / norm[a] / norm[b], 9)) for (a, b), v in pairs.items() if len(v) >= 2}
        assert {(n.movieId, n.neighborId): (n.support, round(n.similarity, 9)) for n in neighbours.item_neighbours(r, 2, 100).collect()} == want
        c = ratings.centred(r)
        asked = c.select(F.col("userId").alias("requestId"), "movieId", "rating")
        near = neighbours.user_neighbours(asked, c)
        plain = near.join(c, "userId").groupBy("requestId", "movieId").agg(F.count("*").alias("n"), F.sum(F.col("similarity") * F.col("centred")).alias("s"), F.sum("similarity").alias("m")).collect()
        assert {(p.requestId, p.movieId): (p.neighbors, round(p.raw, 9)) for p in neighbours.user_predictions(near, c).collect()} == {(p.requestId, p.movieId): (p.n, round(3 + p.s / p.m, 9)) for p in plain}
        left = {(p.requestId, p.movieId): p.raw and round(p.raw, 9) for p in neighbours.user_predictions(near, c, wanted=asked).collect()}
        known = {(p.requestId, p.movieId): round(3 + p.s / p.m, 9) for p in plain}
        assert left == {k: known.get(k) for k in rows}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rankings_tie_at_nine_places_as_in_sql(spark):
    """0.5093149315 scaled is below the half, its shortest decimal is not."""
    model = spark.createDataFrame([(10, 30, 0.509314931), (10, 31, 0.5093149315)], "movieId long, neighborId long, similarity double")
    out = neighbours.item_recommend(session(spark, [(10, 4)]), model, spark.createDataFrame([(30,), (31,)], "movieId long"), 10).collect()
    assert {r.movieId: r["rank"] for r in out} == {30: 1, 31: 2}


def test_scalar_scores(spark):
    one = spark.range(1)
    v = one.select(catalogue.reliability(F.lit(100), F.lit(4.0), F.lit(1000)).alias("a"), *[catalogue.recency(F.lit(y).cast("int")).alias(f"y{y}") for y in (1989, 1990, 2008, 2025, 2026)], catalogue.recency(F.lit(None).cast("int")).alias("none"), catalogue.tag_signal(F.array(*[F.lit(str(i)) for i in range(5)])).alias("t")).first()
    assert v.a == 0.7142 and v.none == 0 and v.t == 0.5885
    assert [round(v[f"y{y}"], 6) for y in (1989, 1990, 2008, 2025, 2026)] == [0.25, 0.40, 0.70, 0.983333, 1.0]


@pytest.mark.parametrize(("us", "es", "want"), [("R", "A", "adult_or_sensitive"), ("PG", "12", "teen"), ("PG-13", "A", "family_friendly"), ("PG-13", None, "teen"), (None, None, "unknown")])
def test_certification(spark, us, es, want):
    assert spark.range(1).select(catalogue.certification(F.lit(us).cast("string"), F.lit(es).cast("string")).alias("x")).first().x == want


def item(spark, **change):
    base = dict(movieId=1, title="A film", year=2020, genres=["Family", "Animation", "Adventure"], runtime=90, popularity=66.0, language="en", us="G", es="", keywords=["disney"], userTags=["friendship"], texts=["A film"], posterPath="/p.jpg", enrichmentError=None, ratingCount=500, dataReliabilityScore=0.8, recencyScore=0.9, suitabilityCategory="family_friendly", publicBlockedTerms=[], standDisplayScore=0.9)
    base |= change
    schema = "movieId long, title string, year int, genres array<string>, runtime int, popularity double, language string, us string, es string, keywords array<string>, userTags array<string>, texts array<string>, posterPath string, enrichmentError string, ratingCount long, dataReliabilityScore double, recencyScore double, suitabilityCategory string, publicBlockedTerms array<string>, standDisplayScore double"
    return spark.createDataFrame([tuple(base[f.split()[0]] for f in schema.split(", "))], schema)


def test_stand_score(spark):
    score = lambda **k: catalogue.stand_score(item(spark, **k)).first().standDisplayScore
    assert score() == 0.8491
    assert score(suitabilityCategory="teen") == 0.8183
    # halves but for last bits round as the scaled value does, in SQL too
    assert score(us="", es="A", genres=["Crime", "Drama"], keywords=["small", "school"], userTags=["view"], suitabilityCategory="teen", popularity=64.89999999999998, dataReliabilityScore=0.7525, recencyScore=0.8) == 0.5266
    assert score(us="PG", genres=["Animation", "Family"], keywords=["blue", "nature"], userTags=["signup"], popularity=114.70000000000005, dataReliabilityScore=0.7875, recencyScore=0.7666666666666667) == 0.7494


@pytest.mark.parametrize(("change", "want"), [({}, []), ({"genres": ["documentary"]}, ["documentary"]), ({"runtime": 69}, ["short_runtime"]), ({"runtime": 70}, []), ({"runtime": None}, []), ({"posterPath": None, "year": None}, ["missing_poster", "missing_year"]), ({"standDisplayScore": 0.4}, ["low_stand_display_score"]), ({"standDisplayScore": 0.4, "language": "fr", "ratingCount": 120, "popularity": 1.0, "genres": ["Drama"]}, ["low_stand_accessibility"])])
def test_exclusion_reasons(spark, change, want):
    assert item(spark, **change).select(catalogue.exclusion_reasons(catalogue.Policy()).alias("x")).first().x == want


def test_classifier_and_blocked_terms(spark):
    out = catalogue.classify(item(spark, texts=["The NEO-Nazi files", "drugstore"])).first()
    assert out.publicBlockedTerms == ["nazi", "neo-nazi"] and out.suitabilityCategory == "adult_or_sensitive"
    assert catalogue.classify(item(spark, genres=["Horror", "Family"])).first().suitabilityCategory == "teen"
    assert catalogue.classify(item(spark, us="", genres=["Drama"], keywords=["Magic"])).first().suitabilityCategory == "family_friendly"


def test_partition_lists_short_support_twice(spark):
    x = catalogue.roles(item(spark, runtime=50), catalogue.Policy()).withColumn("filteredRatingCount", F.lit(5))
    assert sorted(r.part for r in catalogue.partition(x).collect()) == ["excluded", "support"]


def test_reconfigure_is_reversible(spark):
    x = catalogue.roles(item(spark, suitabilityCategory="teen"), catalogue.Policy())
    assert [catalogue.reconfigure(x, p).first().part for p in ("family_only", "family_and_teen")] == ["support", "public"]


def test_popularity(spark):
    rows = spark.createDataFrame([(1, 0, 500, 0.0, 4.0, 0.6), (2, 0, 0, 0.0, 4.0, 0.6)], "movieId long, filteredRatingCount long, ratingCount long, filteredAverageRating double, averageRating double, standDisplayScore double")
    out = ratings.popularity(rows).collect()
    assert len(out) == 1 and round(out[0].score, 6) == 2.356667


def test_popularity_ties_go_by_id(spark):
    rows = spark.createDataFrame([(1, 500, 500, 4.0, 4.0, 0.6), (2, 500, 500, 4.0 + 1e-12, 4.0, 0.6)], "movieId long, filteredRatingCount long, ratingCount long, filteredAverageRating double, averageRating double, standDisplayScore double")
    assert [r.movieId for r in ratings.popularity(rows).orderBy("rank").collect()] == [1, 2]


def test_ranking_metrics(spark):
    rec = spark.createDataFrame([(1, i, i) for i in range(1, 6)], "caseId long, movieId long, rank int")
    hold = spark.createDataFrame([(1, 2), (1, 4)], "caseId long, movieId long")
    r = evaluation.ranking_metrics(rec, hold, 5).first()
    assert (round(r.ndcg, 6), r.map, r.mrr, r.recall) == (0.650921, 0.5, 0.5, 1.0)


def test_prediction_metrics_hold_no_errors_in_one_task(spark):
    rows = spark.range(1, 41).selectExpr("0.0D as rating", "if(id = 40, null, cast(if(id % 2 = 0, id, -id) as double)) as predicted")
    out = evaluation.prediction_metrics(rows)
    assert "percentile" not in out._jdf.queryExecution().executedPlan().toString().lower()
    r = out.first()
    assert (r.p95, r.mae, r.coverage) == (38.0, 20.0, 97.5)
    none = evaluation.prediction_metrics(rows.where("false")).collect()
    assert len(none) == 1 and none[0].p95 is None


def test_percentiles(spark):
    r = evaluation.nearest_rank(spark.range(1, 11).toDF("x"), "x", (50, 95)).first()
    assert (r.p50, r.p95) == (5, 10)


def test_app_rating(spark):
    want = {4.5: 5, 4.0: 4, 3.5: 4, 3.0: 3, 2.5: 3, 2.0: 2, 1.5: 2, 1.0: 1, 0.5: 1}
    got = spark.createDataFrame([(x,) for x in want], "x double").select("x", ratings.app_rating(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in got} == want


def test_normalise_decomposes_every_character(spark):
    """Against the standard library, over every character that has an ASCII form and some that have none."""

    def plain(x):
        x = unicodedata.normalize("NFKD", x.lower())
        return re.sub("[^a-z0-9]+", " ", "".join(c for c in x if not unicodedata.combining(c))).strip()

    titles = [f"a{c}b" for c in text.FOLDS] + ["Tiếng Việt", "ＦＵＬＬ width", "ﬁne ﬄ ĳ", "½ №", "e\u0301te\u0301", "日本 go", "\u1d2c𝐀b", "", " "]
    rows = [(i, x) for i, x in enumerate(titles)] + [(len(titles), None)]
    got = {r.i: r.n for r in spark.createDataFrame(rows, "i int, t string").select("i", text.normalise(F.col("t")).alias("n")).collect()}
    assert got == {i: plain(x or "") for i, x in rows}


def test_holdout_error_is_below_that_of_the_mean(spark):
    rows = [(u, m, float(min(5, max(1, 3 + (1 if u % 2 == m % 2 else -1) + u % 3 - 1)))) for u in range(40) for m in range(30)]
    got = factors.holdout_error(spark.createDataFrame(rows, "userId long, movieId long, rating double"), factors=4, iterations=5).first()
    assert got.seen + got.held == len(rows) and got.held and got.rmse_model < 0.5 * got.rmse_mean


def test_fold_in_equals_a_loop(spark):
    items = [(1, 0.1, [0.2, -0.3]), (2, -0.2, [0.5, 0.4])]
    seen = [(7, 0, 1, 5), (7, 1, 2, 2)]
    b, p = 0.0, [0.0, 0.0]
    for _ in range(25):
        for _, _, m, r in seen:
            bias, q = items[m - 1][1:]
            e = r - (3.1 + b + bias + sum(x * y for x, y in zip(p, q, strict=True)))
            b += 0.01 * (e - 0.05 * b)
            p = [x + 0.01 * (e * y - 0.05 * x) for x, y in zip(p, q, strict=True)]
    got = factors.fold_in(spark.createDataFrame(seen, "requestId long, place int, movieId long, rating int"), spark.createDataFrame(items, "movieId long, bias double, factors array<double>"), 3.1).first()
    assert math.isclose(got.bias, b, rel_tol=1e-9) and all(math.isclose(x, y, rel_tol=1e-9) for x, y in zip(got.factors, p, strict=True))


def test_factorization_learns(spark):
    rows = [(u, m, 5.0 if (u + m) % 2 else 1.0) for u in range(20) for m in range(20) if (u * 7 + m) % 5]
    data = spark.createDataFrame(rows, "userId long, movieId long, rating double")
    mu, users, items = factors.train(data, factors=4, iterations=5)
    guess = data.join(users.toDF("userId", "bu", "p"), "userId").join(items.toDF("movieId", "bi", "q"), "movieId").select((F.lit(mu) + F.col("bu") + F.col("bi") + factors.dot(F.col("p"), F.col("q")) - F.col("rating")).alias("e"))
    assert guess.agg(F.sqrt(F.avg(F.col("e") ** 2))).first()[0] < 0.8


def test_mmr_with_full_weight_keeps_score_order(spark):
    scored = spark.createDataFrame([(1, m, 1.0 - m / 10, m) for m in range(1, 5)], "requestId long, movieId long, score double, rank int")
    features = spark.createDataFrame([(m, "b", f, 0.7) for m in range(1, 5) for f in ("x", f"y{m % 2}")], "movieId long, block string, feature string, weight double")
    assert [r.movieId for r in content.diversify(scored, features, 4, 1.0).orderBy("rank").collect()] == [1, 2, 3, 4]
    assert [r.movieId for r in content.diversify(scored, features, 2, 0.1).orderBy("rank").collect()] == [1, 2]


def test_text(spark):
    r = spark.createDataFrame([("Amélie  (2001) ", "Drama|Comedy|")], "t string, g string").select(text.normalise(F.col("t")).alias("n"), text.title_year(F.col("t")).alias("y"), text.clean_title(F.col("t")).alias("c"), text.genres(F.col("g")).alias("g"), text.slug(F.lit("Sci-Fi")).alias("s"), text.slug(F.lit(" <NA> ")).alias("m")).first()
    assert tuple(r) == ("amelie 2001", 2001, "Amélie", ["Drama", "Comedy"], "sci_fi", "")


def test_text_block_weights(spark):
    docs = spark.createDataFrame([(1, "red red car"), (2, "red bus"), (3, "blue bus"), (4, None)], "movieId long, overview string")
    got = {(r.movieId, r.feature): r.weight for r in content.text_block(docs).collect()}
    assert set(got) == {(1, "text:red"), (2, "text:red"), (2, "text:bus"), (3, "text:bus")}
    assert math.isclose(got[1, "text:red"], (1 + math.log(2)) * (math.log(5 / 3) + 1))


REQUEST = {"strategy": "collaborative", "algorithm": "item_knn", "ratings": [{"movieId": 1, "rating": 5}], "limit": 2}


@pytest.mark.parametrize(("change", "code"), [
    ({"ratings": [{"movieId": 1, "rating": 6}]}, "invalid_rating_value"), ({"ratings": [{"movieId": 1, "rating": 4.5}]}, "invalid_rating_value"), ({"limit": 0}, "invalid_limit"), ({"extra": 1}, "invalid_request"),
    ({"strategy": "hybrid"}, "unsupported_strategy"), ({"algorithm": "missing"}, "unsupported_algorithm"), ({"strategy": "content", "algorithm": "popularity"}, "unsupported_strategy_algorithm_combination"),
    ({"ratings": [{"movieId": 1, "rating": 5}] * 2}, "duplicate_movie_rating"), ({"ratings": [{"movieId": 999, "rating": 5}]}, "unknown_movie"), ({"ratings": []}, "insufficient_ratings"), ({"requestId": " "}, "invalid_request"),
])
def test_request_errors(change, code):
    with pytest.raises(explain.RequestError) as e:
        explain.validate(REQUEST | change, lambda ids: ids & {1, 2, 3})
    assert e.value.code == code


def test_request_ids():
    known = lambda ids: ids
    assert explain.validate(REQUEST | {"requestId": "x" * 128}, known)["requestId"] == "x" * 128
    assert explain.validate(REQUEST, known)["requestId"].startswith("rec-")


def test_evidence_and_texts(spark):
    rows = spark.createDataFrame([(1, 50, 1, 7, 5, 1.5), (1, 50, 1, 8, 4, 0.5), (1, 51, 2, 7, 5, 0.9), (1, 51, 2, 8, 4, 0.8), (1, 51, 2, 9, 2, 2.0)], "requestId long, movieId long, rank int, sourceId long, rating int, contribution double")
    got = {r.movieId: r for r in explain.evidence(rows).collect()}
    assert {got[50].anchor, got[51].anchor} == {7, 8} and 9 not in got[51].evidence
    out = explain.render(spark.createDataFrame([(1, 50, "X", "Y", "strong"), (1, 51, "Z", None, "fallback")], "requestId long, movieId long, movie string, anchor string, strength string")).collect()
    assert all("{" not in r.text and r.text for r in out)


def test_empty_and_null_tables(spark):
    none = spark.createDataFrame([], "userId long, movieId long, rating double, timestamp long")
    assert ratings.histogram(none).where("n <> 0").count() == 0 and ratings.activity(none).count() == 7 and ratings.overview(none).first().users == 0
    assert audit.low_access(item(spark, language=None), "language").count() == 0


def test_listings(spark):
    from velum.operators import catalogue, listings

    items = spark.createDataFrame([(i, f"T{i % 3}", i / 10 if i % 7 else None) for i in range(200)], "movieId long, title string, score double").repartition(5)
    order = [F.col("score").desc(), F.col("title"), F.col("movieId")]
    places = [r.movieId for r in catalogue.ranked(items, order, "place").orderBy("place").collect()]
    assert places == [r.movieId for r in items.orderBy(F.col("score").desc_nulls_last(), "title", "movieId").collect()]
    assert catalogue.ranked(items.where("movieId < 0"), order, "place").count() == 0
    assert listings.lookup(items, 5).first().title == "T2"
    for wrong in (-1,):
        with pytest.raises(Exception, match="rows found"):
            listings.lookup(items, wrong).collect()
    assert {(r.movieId, r.title) for r in listings.merged(items.select("movieId", "title").where("movieId < 3"), spark.createDataFrame([(1, "later")], "movieId long, title string")).collect()} == {(0, "T0"), (1, "later"), (2, "T2")}
    twice = spark.createDataFrame([(1, ["unknown_suitability"]), (1, [])], "movieId long, publicExclusionReasons array<string>")
    with pytest.raises(Exception, match="two rows"):
        listings.migrate(twice, twice.where("false")).collect()
    raw = spark.createDataFrame([("7", " A ", "1999.0", "x| y ||", "ninety", "3.5", "12", "True"), ("x", "B", None, None, None, None, None, None), ("8", "", "1", "", "", "", "", "")], "movieId string, title string, year string, genres string, runtime string, averageRating string, ratingCount string, isPublic string")
    assert [tuple(r) for r in listings.typed(raw).collect()] == [(7, "A", 1999, ["x", "y"], None, 3.5, 12, True)]
