"""Audit tables over the exported catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velum.functions import constants as K
from velum.operators.catalogue import listed, low_accessibility, overlap

col = F.col


def combined(public: DataFrame, support: DataFrame, excluded: DataFrame, summary: DataFrame) -> DataFrame:
    """The three lists in one frame with ``partition`` and the ratings summary; values of the summary fill blanks."""
    out = None
    for name, frame in (("public", public), ("support", support), ("excluded", excluded)):
        part = frame.withColumn("partition", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    extra = summary.select("movieId", *[col(c).alias(f"__{c}") for c in summary.columns if c != "movieId"])
    out = out.join(extra, "movieId", "left")
    for c in summary.columns:
        if c != "movieId":
            out = out.withColumn(c, F.coalesce(c, f"__{c}") if c in out.columns else col(f"__{c}")).drop(f"__{c}")
    return out


def flags() -> Column:
    """The public audit's flags, joined by pipes."""
    few, unknown, weak = F.coalesce("ratingCount", F.lit(0)) < K.LOW_COUNT, F.coalesce("popularity", F.lit(0.0)) < K.LOW_POPULARITY, F.coalesce("standDisplayScore", F.lit(0.0)) < K.MIN_STAND_SCORE
    names = listed(
        (few, "low_rating_count"), (unknown, "low_tmdb_popularity"), (weak, "low_stand_display_score"),
        (~F.coalesce("language", F.lit("")).isin(K.COMMON_LANGUAGES) & (few | unknown | weak), "uncommon_original_language"),
        ((col("suitabilityCategory") == "teen") & overlap(col("genres"), K.SENSITIVE_GENRES), "teen_with_sensitive_genres"),
        (F.array_contains("standDisplayReasons", "stand_family_certified_teen_suitability"), "family_certified_teen"),
        (few & unknown & weak, "low_public_recognition"), (F.coalesce("overview", F.lit("")) == "", "missing_display_overview"), (F.coalesce("title", F.lit("")) == "", "missing_display_title"),
    )
    return F.array_join(names, "|")


def count_by(frame: DataFrame, field: str) -> DataFrame:
    """Distinct movies by partition and value, with their share of the partition."""
    value = F.when(F.trim(F.coalesce(col(field).cast("string"), F.lit(""))) == "", "(missing)").otherwise(F.trim(col(field).cast("string")))
    by = frame.groupBy("partition", value.alias("value")).agg(F.countDistinct("movieId").alias("movies"))
    return by.withColumn("share", F.round(col("movies") * 100 / F.sum("movies").over(Window.partitionBy("partition")), 4))


def explode_by(frame: DataFrame, field: str, examples: int = 8, by: tuple[str, ...] = ("partition",)) -> DataFrame:
    """Distinct movies by ``by`` and element of an array, with the first titles as examples."""
    key = [*by, "value"]
    rows = frame.select(*by, "movieId", "title", F.explode(F.array_distinct(field)).alias("value")).where("value <> ''")
    first = F.row_number().over(Window.partitionBy(*key).orderBy("title", "movieId"))
    ranked = rows.dropDuplicates([*key, "title"]).withColumn("n", first).where(col("n") <= examples)
    names = ranked.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "title"))), lambda x: x["title"]), " | ").alias("examples"))
    return rows.groupBy(*key).agg(F.countDistinct("movieId").alias("movies")).join(names, key)


def compare(frame: DataFrame) -> DataFrame:
    has = lambda c: F.count_if(F.coalesce(c, F.lit(0)) > 0)
    return frame.groupBy("partition").agg(
        F.countDistinct("movieId").alias("movies"), has(F.col("ratingCount")).alias("rated"), F.count_if(F.coalesce("overview", F.lit("")) != "").alias("withOverview"),
        F.round(F.avg("standDisplayScore"), 4).alias("meanScore"), F.round(F.avg("popularity"), 4).alias("meanPopularity"), F.round(F.avg("ratingCount"), 4).alias("meanCount"), F.median("ratingCount").alias("medianCount"), F.count_if(overlap(col("genres"), K.SENSITIVE_GENRES)).alias("sensitive"),
    )


def low_access(frame: DataFrame, by: str) -> DataFrame:
    return frame.where(low_accessibility()).groupBy(F.coalesce(by, F.lit("")).alias("value")).agg(F.countDistinct("movieId").alias("movies"))


def family_simulation(ranked: DataFrame, tops: tuple[int, ...] = (100, 250)) -> DataFrame:
    """Family and teen movies in the whole public list (0) and among its first ones."""
    family, teen = col("suitabilityCategory") == "family_friendly", col("suitabilityCategory") == "teen"
    parts = []
    for n in (0, *tops):
        inside = col("rank") <= n if n else F.lit(True)
        parts.append(F.struct(F.lit(n).alias("top"), F.count_if(inside).alias("movies"), F.count_if(inside & family).alias("family"), F.count_if(inside & teen).alias("teen")))
    return ranked.agg(F.array(*parts).alias("x")).select(F.inline("x"))


def tag_export(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Per lower-cased tag: on how many rows, from which columns and in which partitions it stands."""
    named = lambda c, name: F.transform(c, lambda x: F.struct(F.lower(F.trim(x)).alias("tag"), F.lit(name).alias("source")))
    parts = F.concat(*[named(c, name) for c, name in columns.items()])
    rows = frame.select("movieId", "partition", F.explode(F.array_distinct(parts)).alias("x")).select("movieId", "partition", "x.*").where("tag <> ''")
    return rows.groupBy("tag").agg(F.countDistinct("movieId", "partition").alias("rows"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.array_join(F.array_sort(F.collect_set("partition")), ",").alias("roles"))


def thresholds(candidates: DataFrame, years: list[int], counts: list[int]) -> DataFrame:
    """Movies that pass each pair of a first year and a least count, in one pass."""
    cells = [F.struct(F.lit(y).alias("year"), F.lit(n).alias("ratings"), F.count_if((col("year") >= y) & (col("ratingCount") >= n)).alias("movies")) for y in years for n in counts]
    return candidates.agg(F.array(*cells).alias("x")).select(F.inline("x"))


def tops(frame: DataFrame, metric: str, n: int = 20) -> DataFrame:
    rows = frame.orderBy(col(metric).desc_nulls_last(), col("ratingCount").desc(), "title", "movieId").limit(n)
    return rows.select("movieId", "title", col(metric).cast("double").alias("value"))


def distribution(frame: DataFrame, value: Column) -> DataFrame:
    return frame.groupBy(value.alias("value")).agg(F.count("*").alias("movies"))


def runtime_bucket() -> Column:
    r = col("runtime")
    return F.when(r.isNull(), "unknown").when(r < 80, "<80").when(r < 100, "80-99").when(r < 120, "100-119").when(r < 150, "120-149").otherwise("150+")


def decade() -> Column:
    return F.concat(F.floor(col("year") / 10) * 10, F.lit("s"))


def completeness(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Non-null counts of columns, one row for each."""
    parts = [F.struct(F.lit(c).alias("field"), F.count(c).alias("present"), F.count("*").alias("rows")) for c in columns]
    return frame.agg(F.array(*parts).alias("x")).select(F.inline("x"))
