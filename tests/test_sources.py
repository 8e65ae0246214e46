import pytest
from pyspark.sql import functions as F

from velum.sources import tables


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "movies.csv").write_text('movieId,title,genres\n1,"Toy Story (1995)",Animation|Comedy\n2,Untitled,(no genres listed)\nx,Bad (2000),Drama\n')
    got = {r.movieId: r for r in tables.movies(spark, str(tmp_path / "movies.csv")).collect()}
    assert got[1].cleanTitle == "Toy Story" and got[1].year == 1995 and got[1].genres == ["Animation", "Comedy"]
    assert got[2].year is None and got[2].genres == [] and None in got
    tables.write_csv(spark.createDataFrame([(1, ["a|b", "c"], True, None)], "movieId long, tags array<string>, ok boolean, note string"), str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True).first()
    assert back.tags == "a/b|c" and back.ok == "true" and not back.note


def test_links_with_bad_ids(spark, tmp_path):
    (tmp_path / "links.csv").write_text("movieId,imdbId,tmdbId\n1,tt1,12.0\n2,tt2,\n3,tt3,abc\n")
    assert [r.tmdbId for r in tables.links(spark, str(tmp_path / "links.csv")).orderBy("movieId").collect()] == [12, None, None]


def test_metadata(spark):
    raw = '{"title":"T","genres":[{"name":"Drama"}],"keywords":{"keywords":[{"name":"k"}]},"credits":{"cast":[],"crew":[{"name":"D","job":"Director"},{"name":"W","job":"Writer"}]},"release_dates":{"results":[{"iso_3166_1":"US","release_dates":[{"certification":" "},{"certification":"PG"}]},{"iso_3166_1":"US","release_dates":[{"certification":"R"}]}]}}'
    r = tables.unpack_metadata(spark.createDataFrame([(1, raw), (2, None)], "movieId long, p string"), F.col("p")).orderBy("movieId").collect()
    assert r[0].genres == ["Drama"] and r[0].directors == ["D"] and r[0].certifications == {"US": "PG"} and r[1].genres is None


def test_promotion_keeps_the_old_table_when_the_check_fails(spark, tmp_path):
    path = str(tmp_path / "model")
    tables.promote(spark.range(3), path, lambda f: None)

    def refuse(frame):
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        tables.promote(spark.range(5), path, refuse)
    assert spark.read.parquet(path).count() == 3
    tables.promote(spark.range(5), path, lambda f: None)
    assert spark.read.parquet(path).count() == 5


def test_manifest_and_requirements(spark, tmp_path):
    a = tables.manifest(spark.range(4), str(tmp_path / "m.json"), kind="test")
    assert a["rows"] == 4 and a["digest"] == tables.manifest(spark.range(4).orderBy(F.desc("id")), str(tmp_path / "n.json"))["digest"]
    with pytest.raises(ValueError, match="missing"):
        tables.require(spark.range(2), ["movieId"])
    with pytest.raises(ValueError, match="duplicate"):
        tables.require(spark.range(2).union(spark.range(2)), ["id"])


def test_filtered_copy_union_and_json(spark, tmp_path):
    rated = spark.createDataFrame([(1, 7, 4.0), (2, 8, 3.0), (3, 7, 1.0)], "userId long, movieId long, rating double")
    tables.write_filtered(rated, spark.createDataFrame([(7,), (7,)], "movieId long"), str(tmp_path / "some"))
    back = spark.read.csv(str(tmp_path / "some"), header=True)
    assert back.columns == ["userId", "movieId", "rating"] and {r.userId for r in back.collect()} == {"1", "3"}
    tables.write_filtered(rated, rated.select("movieId").where("false"), str(tmp_path / "none"))
    assert spark.read.csv(str(tmp_path / "none"), header=True).columns == ["userId", "movieId", "rating"]
    tables.write_union([spark.createDataFrame([(1,)], "b long"), spark.createDataFrame([(2,)], "a long")], str(tmp_path / "both"))
    both = spark.read.csv(str(tmp_path / "both"), header=True)
    assert both.columns == ["a", "b"] and sorted(map(tuple, both.collect())) == [("2", "null"), ("null", "1")]
    tables.write_json(spark.createDataFrame([(1, None)], "a long, b string"), str(tmp_path / "json"))
    assert [r.value for r in spark.read.text(str(tmp_path / "json")).collect()] == ['{"a":1,"b":null}']


def test_fingerprint_ignores_row_order_and_tells_other_data(spark):
    a = tables.fingerprint({"x": spark.range(4), "y": spark.range(2)})
    assert a == tables.fingerprint({"y": spark.range(2), "x": spark.range(4).orderBy(F.desc("id"))})
    assert a != tables.fingerprint({"x": spark.range(5), "y": spark.range(2)})
    tables.compatible({"dataset": a}, a)
    with pytest.raises(ValueError, match="not"):
        tables.compatible({"dataset": "other"}, a)
