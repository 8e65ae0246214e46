import __spark_entry__ as entry
from velum.operators import listings
from velum.plans import adapters

DATA = "/root/testdata/sf0.001"


def test_index_summary_makes_the_items_once_and_no_weights(spark, monkeypatch):
    calls, real = [], adapters.items
    monkeypatch.setattr(adapters, "items", lambda *a, **k: calls.append(1) or real(*a, **k))
    plan = entry.queries()["index_summary"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert len(calls) == 1 and "Window" not in plan and "Expand" not in plan


def test_summary_counts_distinct_movies_and_features(spark):
    index = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "c"), (3, None)], "movieId long, feature string")
    items = spark.createDataFrame([(1, ["x"], [], " "), (2, [], ["k"], "t"), (3, [], [], None)], "movieId long, userTags array<string>, keywords array<string>, overview string")
    assert listings.index_summary(index, items).collect() == [(3, 3, 5, 1.6667, 3, 1, 1, 1)]
    assert listings.index_summary(index, items).columns == ["indexed", "features", "nonZero", "meanNonZero", "movies", "withTags", "withKeywords", "withOverview"]
