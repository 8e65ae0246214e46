"""Mixing sources to target weights, with DataFrame operations only.

Tokens are summed per source, targets are shared out by weight under a ceiling of repeats, and each document is emitted
``floor(rate)`` times plus one copy whose coin is a hash of its id, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velum.llm.shared import cut

#: Sources up to this number are broadcast (a few MB); more are joined by shuffle, where AQE splits a hot source.
BROADCAST_SOURCES = 50_000


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null counts 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """``source, source_size, target`` from rows of ``source, size``.

    Sources by code point, null last, take the weights in turn and share the sum of all sizes. A target stops at
    ``max_repeats`` times its source's size and the excess goes to the others by weight, until none is above. That end
    state is one level times the weight, cut at each ceiling; the level is found with running sums over the sources in
    the order in which they reach their ceiling.
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * max_repeats).cast("double"))
    run = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(all_rows).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    by = by.withColumn("level", level)
    chosen = F.min(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    by = by.withColumn("level", F.coalesce(chosen["level"], F.lit(float("inf"))))
    return by.select("source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


def coin(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of id and seed."""
    bits = F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":" + seed))), 1, 13), 16, 10)
    return bits.cast("long").cast("double") / float(1 << 52)


def plan(docs: DataFrame, sizes: DataFrame, *, seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """``docs`` (with ``doc_id, source, size``) plus ``source_size, target, copies``.

    Null sources form one source; empty and null texts have size 0 and no effect on totals; a source without words gets
    target 0 and no copies. Repeated rows of one id share their coin. An empty table gives an empty table.
    """
    goal = cut(targets(sizes, weights, max_repeats).withColumnRenamed("source", "goal_source"))
    if goal.count() <= BROADCAST_SOURCES:
        goal = F.broadcast(goal)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = (whole + F.when(coin(F.col("doc_id"), seed) < rate - whole, 1).otherwise(0)).cast("long")
    return docs.join(goal, docs["source"].eqNullSafe(goal["goal_source"])).drop("goal_source").withColumn("copies", copies)


def emit(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every row of ``docs`` as many times as its plan says, with the columns of ``docs``."""
    planned = plan(docs, docs.select("source", n_words(F.col("text")).alias("size")), **how)
    again = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))
    return planned.where("copies > 0").withColumn("__copy", again).select(*docs.columns)


def oracle(docs: str = "documents") -> str:
    """DuckDB SQL for the digest: doc_id, size, source_size, target, taken."""
    return f"""
with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from {docs}),
by_source as (select source, sum(size)::bigint as source_size, (1 + (row_number() over (order by source asc nulls last) - 1) % 3)::double as weight,
  (3 * sum(size))::double as cap from sized group by source),
runs as (select *, (sum(source_size) over ())::double - coalesce(sum(cap) over w, 0) as rest, (sum(weight) over ()) - coalesce(sum(weight) over w, 0) as rest_weight
  from by_source window w as (order by cap / weight, source asc nulls last rows between unbounded preceding and 1 preceding)),
level as (select arg_min(rest / rest_weight, cap / weight) as l from runs where cap / weight >= rest / rest_weight),
goals as (select source, source_size, least(cap, coalesce(l, 'infinity'::double) * weight) as target from runs, level),
rated as (select s.doc_id, s.size, g.source_size, g.target, case when g.source_size > 0 then g.target / g.source_size else 0 end as rate,
  ('0x' || substr(md5(coalesce(s.doc_id::varchar, 'null') || ':mix'), 1, 13))::bigint::double / 4503599627370496 as u
  from sized s join goals g on s.source is not distinct from g.source)
select doc_id, size, source_size, target, (size * (floor(rate)::bigint + case when u < rate - floor(rate) then 1 else 0 end))::bigint as taken from rated"""


def query(documents: DataFrame) -> DataFrame:
    sized = cut(documents.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    return plan(sized, sized.select("source", "size")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
