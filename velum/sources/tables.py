"""Typed readers and writers of the domain's CSV, JSON and Parquet tables."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from velum.functions.text import clean_title, genres, joined, title_year

MOVIES = "movieId long, title string, genres string"
RATINGS = "userId long, movieId long, rating double, timestamp long"
TAGS = "userId long, movieId long, tag string, timestamp long"
LINKS = "movieId long, imdbId string, tmdbId string"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header row, given types, bad values null."""
    return spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE", escape='"')


def movies(spark: SparkSession, path: str) -> DataFrame:
    raw = read_csv(spark, path, MOVIES)
    return raw.select("movieId", "title", clean_title(F.col("title")).alias("cleanTitle"), title_year(F.col("title")).alias("year"), genres(F.col("genres")).alias("genres"))


def ratings(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, RATINGS)


def tags(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, TAGS).select("movieId", F.coalesce("tag", F.lit("")).alias("tag"))


def links(spark: SparkSession, path: str) -> DataFrame:
    raw = read_csv(spark, path, LINKS)
    return raw.select("movieId", "imdbId", F.col("tmdbId").try_cast("double").try_cast("long").alias("tmdbId"))


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents over several lines."""
    return spark.read.schema(schema).json(path, multiLine=True)


def unpack_metadata(items: DataFrame, payload: str) -> DataFrame:
    """The fields of a metadata payload (JSON text) that the catalogue uses: names of genres and keywords, the first eight of the cast, directors, and the first certificate of each country."""
    schema = "struct<title:string,original_language:string,overview:string,runtime:int,popularity:double,poster_path:string,genres:array<struct<name:string>>,keywords:struct<keywords:array<struct<name:string>>>,credits:struct<cast:array<struct<name:string,character:string>>,crew:array<struct<name:string,job:string>>>,release_dates:struct<results:array<struct<iso_3166_1:string,release_dates:array<struct<certification:string>>>>>>"
    x = F.from_json(payload, schema)
    names = lambda c: F.filter(F.transform(c, lambda v: v["name"]), lambda v: v.isNotNull())
    countries = F.filter(x["release_dates"]["results"], lambda r: r["iso_3166_1"].isNotNull())
    first = F.transform(countries, lambda r: F.struct(r["iso_3166_1"].alias("k"), F.get(F.filter(F.transform(r["release_dates"], lambda d: F.trim(d["certification"])), lambda c: c != ""), F.lit(0)).alias("v")))
    first = F.filter(first, lambda e: e["v"].isNotNull())
    once = F.filter(first, lambda e, i: F.array_position(F.transform(first, lambda y: y["k"]), e["k"]) == i + 1)
    return items.withColumns({
        "tmdbTitle": x["title"], "language": x["original_language"], "overview": x["overview"], "runtime": x["runtime"], "popularity": x["popularity"], "posterPath": x["poster_path"],
        "genres": names(x["genres"]), "keywords": names(x["keywords"]["keywords"]), "topCast": F.slice(x["credits"]["cast"], 1, 8),
        "directors": F.transform(F.filter(x["credits"]["crew"], lambda c: c["job"] == "Director"), lambda c: c["name"]), "certifications": F.map_from_entries(once),
    })


def refresh(candidates: DataFrame, enriched: DataFrame, base: list[str]) -> DataFrame:
    """Resume merge: enriched rows of the candidates, their base fields taken from the candidates."""
    old = enriched.select("movieId", *[c for c in enriched.columns if c not in {*base, "movieId"}])
    return candidates.join(old, "movieId", "left")


def write_csv(frame: DataFrame, path: str, null: str = "", rows_per_file: int | None = None) -> None:
    """CSV with arrays as pipe-joined text and booleans as true/false."""
    flat = frame.select(*[joined(F.col(f.name)).alias(f.name) if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StringType) else F.col(f.name) for f in frame.schema.fields])
    writer = flat.write.mode("overwrite").option("header", True).option("nullValue", null).option("emptyValue", "")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.csv(path)


def write_filtered(ratings: DataFrame, movies: DataFrame, path: str) -> None:
    """A CSV copy of the ratings of the given movies; with none there is still a header."""
    write_csv(ratings.join(movies.select("movieId").distinct(), "movieId", "left_semi").select(*ratings.columns), path)


def write_json(frame: DataFrame, path: str) -> None:
    """One JSON object a line, nulls included."""
    frame.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_union(frames: list[DataFrame], path: str) -> None:
    """One CSV of several tables with all their columns, sorted by name; what a table lacks is ``null``."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    write_csv(out.select(*sorted(out.columns)), path, null="null")


def write_model(frame: DataFrame, path: str, key: str) -> None:
    """A model table, its rows dealt out and sorted by key so that lookups skip row groups."""
    frame.repartition(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def promote(frame: DataFrame, path: str, check) -> None:
    """Writes beside the target, validates what was written, then swaps; the old table stays if the check fails."""
    spark = frame.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    staged, backup, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.staged", f"{path}.backup", path))
    fs = target.getFileSystem(conf)
    frame.write.mode("overwrite").parquet(f"{path}.staged")
    try:
        check(spark.read.parquet(f"{path}.staged"))
    except Exception:
        fs.delete(staged, True)
        raise
    fs.delete(backup, True)
    if fs.exists(target):
        fs.rename(target, backup)
    if not fs.rename(staged, target):
        if fs.exists(backup):
            fs.rename(backup, target)
        raise OSError(f"can't move {staged} to {target}")
    fs.delete(backup, True)


def manifest(frame: DataFrame, path: str, **facts) -> dict:
    """A model's or table's manifest with row count, columns and a content digest that doesn't depend on row order."""
    digest = frame.select(F.xxhash64(*frame.columns).alias("h")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first()
    out = {"rows": digest["n"], "columns": frame.columns, "digest": str(digest["s"] or 0), **facts}
    if path and os.path.isdir(os.path.dirname(path)):
        with open(path, "w", encoding="utf-8") as f:
            json.dump(out, f, indent=1)
    return out


def fingerprint(frames: dict[str, DataFrame]) -> str:
    """SHA-256 of the names, columns, row counts and contents of a dataset's tables, whatever the order of rows."""
    parts = {name: manifest(frames[name], "") for name in sorted(frames)}
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()


def compatible(model: dict, dataset: str) -> None:
    """Raises if a model's manifest names another dataset's fingerprint, or none."""
    if model.get("dataset") != dataset:
        raise ValueError(f"the model was built from dataset {model.get('dataset')}, not {dataset}")


def require(frame: DataFrame, columns: list[str]) -> None:
    """Raises if columns are missing or the key repeats."""
    missing = [c for c in columns if c not in frame.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if frame.groupBy(columns[0]).count().where("count > 1").limit(1).count():
        raise ValueError(f"duplicate {columns[0]}")
