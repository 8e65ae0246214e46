"""URL rules by a cascade of Bloom filters, exact over all keys that the corpus's urls can ask for.

A rule is a host and the begin of a path, and its key is both written together. A url asks for the keys of every shape
(number of host labels, length of path) that some rule has, so a rule fits a url exactly if its key is among them. The
first filter of a cascade encodes the listed keys; the second encodes the false positives of the first over all keys of the
corpus, the third those listed keys that the second passes too, and so on until a level has none. The first level that
doesn't hold a key then tells exactly whether it is listed, so urls are judged where they stand, without a join: the filters
are broadcast, after a check of their size. Lists with larger filters are joined instead.

Urls that are null or have no ``://`` have an empty host and path and meet no rule. Repeated rows and repeated urls are
judged like any others, null page ids too; columns of the pages with the names of the new ones are dropped. Urls of any length
are read whole. An empty table gives an empty one; without rules everything is allowed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.llm.arrays import U, mix
from velum.llm.shared import cut

#: Host and begin of path, and what happens to urls below them.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: What a url gets whose keys are in no list.
UNLISTED = "allow"
#: Filters of a list up to this size are broadcast.
BROADCAST_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def address(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url."""
    rest = F.coalesce(F.get(F.split(url, "://", 2), F.lit(1)), F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*(/[^?#]*)?", 1)


def parse(rules: dict[str, str]) -> dict[str, tuple[int, int]]:
    """The shape of every rule's key: labels of its host and code points of its path."""
    out = {}
    for key, verdict in rules.items():
        host, slash, path = key.partition("/")
        if not host or host != host.translate(str.maketrans(UPPER, LOWER)) or verdict not in ("allow", "block"):
            raise ValueError(f"not a rule: {key!r} {verdict!r}")
        out[key] = (host.count(".") + 1, len(slash + path))
    return out


def keyed(urls: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """Adds ``host, path`` and ``__keys``, the keys that a url asks for, longest first (of two of one length that with the longer host)."""
    host, path = address(F.col("url"))
    out = urls.withColumns({"host": host, "path": path}).withColumn("__labels", F.split("host", "\\."))
    keys = []
    for labels, length in shapes:
        own = F.array_join(F.slice("__labels", -labels, labels), ".")
        fits = (F.size("__labels") >= labels) & (F.length("path") >= length)
        keys.append(F.when(fits, F.struct((-F.length(own) - length).alias("size"), (-F.length(own)).alias("of_host"), F.concat(own, F.substring("path", 1, length)).alias("key"))))
    found = F.filter(F.array(*keys), lambda x: x.isNotNull()) if keys else F.array().cast("array<struct<size:int,of_host:int,key:string>>")
    return out.withColumn("__keys", F.transform(F.array_sort(found), lambda x: x["key"])).drop("__labels")


def hashed(keys: DataFrame) -> DataFrame:
    return keys.select("key", F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit("second")).alias("h2"))


@dataclass
class Level:
    bits: int
    hashes: int
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, U))

    @staticmethod
    def sized(inside: int, outside: int, first: bool) -> Level:
        """The first level lets about as many other keys pass as are listed, the later ones half of what they shall not hold."""
        rate = min(0.5, inside / (math.sqrt(2) * outside)) if first and outside else 0.5
        return Level(64 * max(1, math.ceil(inside * 1.4427 * math.log2(1 / rate) / 64)), max(1, round(math.log2(1 / rate))))

    def places(self, h1: np.ndarray, h2: np.ndarray, depth: int):
        step = mix(h2 + U(depth)) | U(1)
        for i in range(self.hashes):
            yield mix(h1 + U(i + 1) * step) % U(self.bits)

    def holds(self, h1: np.ndarray, h2: np.ndarray, depth: int) -> np.ndarray:
        out = np.ones(len(h1), bool)
        for p in self.places(h1, h2, depth):
            out &= (self.words[(p >> U(6)).astype(np.int64)] >> (p & U(63)) & U(1)) == 1
        return out

    def fill(self, keys: DataFrame, depth: int) -> None:
        """Every task sets the bits of its keys; equal words of all tasks are joined by Spark."""

        def run(batches):
            for b in batches:
                for p in self.places(*(b.column(c).to_numpy().view(U) for c in ("h1", "h2")), depth):
                    word, at = np.unique(p >> U(6), return_inverse=True)
                    bits = np.zeros(len(word), U)
                    np.bitwise_or.at(bits, at, U(1) << (p & U(63)))
                    yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])

        got = keys.select("h1", "h2").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        self.words = np.zeros(self.bits // 64, U)
        self.words[got["word"].to_numpy()] = got["bits"].to_numpy().view(U)


def listed(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether keys of the universe are in the list: the first level without a key is an odd one (counted from 0)."""
    first = np.full(len(h1), len(levels))
    left = np.arange(len(h1))
    for depth, level in enumerate(levels):
        held = level.holds(h1[left], h2[left], depth)
        first[left[~held]] = depth
        left = left[held]
    return first % 2 == 1


def passing(keys: DataFrame, level: Level, depth: int) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches):
        for b in batches:
            held = shared.value.holds(*(b.column(c).to_numpy().view(U) for c in ("h1", "h2")), depth)
            yield b.filter(pa.array(held))

    return keys.mapInArrow(run, keys.schema)


def build(keys: DataFrame, others: DataFrame, n_others: int, most_bytes: int = BROADCAST_BYTES) -> list[Level] | None:
    """The cascade of ``keys`` (``key, h1, h2``, distinct) against all of ``others`` (which may repeat and hold listed keys); None if its first level alone passes ``most_bytes``."""
    inside, levels = cut(keys), []
    n = inside.count()
    if not n:
        return levels
    if Level.sized(n, n_others, True).bits // 8 > most_bytes:
        return None
    outside = others
    while True:
        depth = len(levels)
        level = Level.sized(n, n_others, not depth)
        level.fill(inside, depth)
        levels.append(level)
        found = passing(outside, level, depth)
        if not depth:  # only here: what passes the first level, without the listed keys themselves
            found = found.distinct().join(inside.select("key"), "key", "left_anti").select("key", "h1", "h2")
        found = cut(found)
        n, n_others = found.count(), n
        if not n:
            return levels
        if depth > 200:
            raise RuntimeError("two keys have the same 128 bits of hashes")
        inside, outside = found, inside


def judge(pages: DataFrame, rules: dict[str, str] = RULES, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``pages`` with ``host, path, rule`` (the longest that fits, or null) and ``verdict``."""
    new = ["host", "path", "rule", "verdict"]
    pages = pages.drop(*[c for c in pages.columns if c in {*new, "__keys", "__h1", "__h2", "__labels"}])
    spark, columns = pages.sparkSession, pages.columns
    ready = keyed(pages, sorted(set(parse(rules).values())))
    universe = hashed(keyed(pages.select("url"), sorted(set(parse(rules).values()))).select(F.explode("__keys").alias("key")))
    n = universe.agg(F.approx_count_distinct("h1")).first()[0]
    verdicts = sorted(set(rules.values()))
    cascades = [build(hashed(spark.createDataFrame([(k,) for k, v in rules.items() if v == one], "key string")), universe, n, most_bytes) for one in verdicts]
    if any(c is None or sum(level.bits for level in c) // 8 > most_bytes for c in cascades):
        return by_join(ready, rules).select(*columns, *new)
    shared = spark.sparkContext.broadcast(cascades)
    ready = ready.withColumns({"__h1": F.transform("__keys", lambda k: F.xxhash64(k)), "__h2": F.transform("__keys", lambda k: F.xxhash64(k, F.lit("second")))})
    schema = ready.select(*columns, "host", "path").withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("")}).schema

    def run(batches):
        for b in batches:
            keys, h1, h2 = (b.column(b.schema.get_field_index(c)) for c in ("__keys", "__h1", "__h2"))
            edge = keys.offsets.to_numpy()
            flat, h1, h2 = keys.flatten(), h1.flatten().to_numpy().view(U), h2.flatten().to_numpy().view(U)
            row = np.repeat(np.arange(b.num_rows), np.diff(edge))
            at, said = np.full(b.num_rows, len(flat)), np.full(b.num_rows, -1)
            for i, levels in enumerate(shared.value):
                hit = np.flatnonzero(listed(levels, h1, h2))
                own, first = np.unique(row[hit], return_index=True)  # keys stand longest first
                better = hit[first] < at[own]
                at[own[better]], said[own[better]] = hit[first][better], i
            rule = flat.take(pa.array(np.where(said < 0, 0, at), mask=said < 0))
            verdict = pa.array([*verdicts, UNLISTED]).take(pa.array(np.where(said < 0, len(verdicts), said)))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in (*columns, "host", "path")), rule, verdict], schema.names)

    return ready.mapInArrow(run, schema)


def by_join(ready: DataFrame, rules: dict[str, str]) -> DataFrame:
    """The same for lists whose filters are too large to be sent to every executor: each distinct url's keys are joined to the list."""
    urls = ready.select(F.col("url").alias("__url"), "__keys").distinct()
    asked = urls.select("__url", F.posexplode("__keys").alias("__place", "__key"))
    rows = ready.sparkSession.createDataFrame(list(rules.items()), "__key string, __verdict string")
    best = asked.join(rows, "__key").groupBy("__url").agg(F.min(F.struct("__place", "__key", "__verdict")).alias("__best"))
    met = ready.join(best, F.col("url") == F.col("__url"), "left")
    return met.withColumns({"rule": F.col("__best.__key"), "verdict": F.coalesce("__best.__verdict", F.lit(UNLISTED))})


def query(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def oracle(rules: dict[str, str] = RULES) -> str:
    rows = ", ".join(f"('{k}', '{k.partition('/')[0]}', '{k[k.find('/'):]}', '{v}')" for k, v in rules.items())
    return f"""
with rests as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) as path from rests),
rules(rule, rule_host, rule_path, verdict) as (values {rows})
select page_id, host, path, best.rule as rule, coalesce(best.verdict, '{UNLISTED}') as verdict
from (select *, (select max_by({{'rule': rule, 'verdict': verdict}}, length(rule)) from rules where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)) as best from parts)"""
