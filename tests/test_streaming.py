from velum.operators import ratings
from velum.streaming import refresh


def test_partials_add_up(spark, tmp_path):
    rows = [(u, m, float((u * m) % 5 + 1)) for u in range(6) for m in range(9)]
    data = spark.createDataFrame(rows, "userId long, movieId long, rating double")
    data.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    refresh.keep_partials(stream, "userId", str(tmp_path / "parts"), str(tmp_path / "state")).awaitTermination()
    got = refresh.merged(spark.read.parquet(str(tmp_path / "parts")), "userId")
    tidy = lambda f: sorted((r.userId, r.n, round(r.mean, 9), round(r.std, 9)) for r in f.collect())
    assert tidy(got) == tidy(ratings.user_stats(data))
