from pyspark.sql import functions as F

import __spark_entry__ as entry
from velum.operators import content
from velum.plans import adapters

DATA = "/root/testdata/sf0.001"


def counted(monkeypatch, name):
    """How often a frame of the adapters is made."""
    calls, real = [], getattr(adapters, name)
    monkeypatch.setattr(adapters, name, lambda *a, **k: calls.append(name) or real(*a, **k))
    return calls


def test_whole_index_makes_the_items_once(spark, monkeypatch):
    calls = counted(monkeypatch, "items")
    entry.queries()["content_index_whole"](spark, DATA)
    assert len(calls) == 1


def test_index_deals_its_rows_once(spark):
    rows = [(m, b, f"{b}:{i}", 1.0 + i) for m in range(20) for b in ("genres", "text") for i in range(3)]
    out = content.index([spark.createDataFrame(rows, "movieId long, block string, feature string, weight double")])
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    norms = out.groupBy("movieId").agg(F.sum(F.pow("weight", F.lit(2))).alias("n")).collect()
    assert len(norms) == 20 and all(abs(r["n"] - 1) < 1e-12 for r in norms)
