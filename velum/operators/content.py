"""Content index (TF-IDF blocks), user profiles, similarity, scores and diversified lists, all in long format."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velum.functions import constants as K
from velum.functions.numbers import round_away
from velum.functions.text import slug
from velum.operators import terms
from velum.operators.lists import finished
from velum.operators.products import Vectors, beside, best_of_vectors, packed, products_with
from velum.sources.written import stored

col = F.col
KINDS = ("combined", "positive", "negative")


def structured_block(items: DataFrame, column: str, prefix: str, idf: bool) -> DataFrame:
    """``movieId, block, feature, weight``: one for each distinct token of an array column, times ln((1+N)/(1+df))+1 if asked for."""
    tokens = items.select("movieId", F.explode(F.array_distinct(F.transform(column, slug))).alias("t")).where("t <> ''").select("movieId", F.concat(F.lit(prefix + ":"), "t").alias("feature"))
    if not idf:
        return tokens.select("movieId", F.lit(column).alias("block"), "feature", F.lit(1.0).alias("weight"))
    return tokens.join(_idf(tokens, items), "feature").select("movieId", F.lit(column).alias("block"), "feature", col("idf").alias("weight"))


def _idf(tokens: DataFrame, items: DataFrame) -> DataFrame:
    n = items.agg(F.count("*").alias("N"))
    df = tokens.groupBy("feature").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("feature", "df", "N", (F.ln((1 + col("N")) / (1 + col("df"))) + 1).alias("idf"))  # one row of n


def text_block(items: DataFrame, column: str = "overview", min_df: int = 2, max_df: float = 0.65, most: int = 5000) -> DataFrame:
    """Words and word pairs of a text with 1+ln(tf) times idf; the ``most`` terms by total count, ties by term."""
    lists, n = terms.word_lists(items, column)
    tf = terms.frequencies(lists, terms.chosen(lists, n, min_df, max_df, most))
    return tf.select("movieId", F.lit("text").alias("block"), F.concat(F.lit("text:"), "feature").alias("feature"), ((1 + F.ln("tf")) * col("idf")).alias("weight"))


def unit(features: DataFrame, *by: str) -> DataFrame:
    """Weights divided by their Euclidean norm within groups."""
    norm = F.sqrt(F.sum(col("weight") * col("weight")).over(Window.partitionBy(*by)))
    return features.withColumn("__n", norm).where("__n > 0").withColumn("weight", col("weight") / col("__n")).drop("__n")


def index(blocks: list[DataFrame]) -> DataFrame:
    """Blocks normalised per movie, weighted, joined and normalised again. Empty blocks add nothing. Rows are dealt by movie once, which serves both norms."""
    out = None
    for b in blocks:
        out = b if out is None else out.unionByName(b)
    scale = F.lit(1.0)
    for name, w in K.CONTENT_WEIGHTS.items():
        scale = F.when(col("block") == name, F.lit(float(w))).otherwise(scale)
    return unit(unit(out.repartition("movieId"), "movieId", "block").withColumn("weight", col("weight") * scale), "movieId")


def profile(session: DataFrame, features: DataFrame) -> DataFrame:
    """``requestId, kind, feature, weight``: unit vectors of all (combined), liked (positive) and disliked (negative) movies, weighted by (rating-3)/2."""
    vectors, ids = packed(features)
    return named(profile_vectors(session, vectors), ids)


def _met(session: DataFrame, vectors: DataFrame) -> DataFrame:
    """A row for each rating but 3 with its weight and its movie's vector."""
    return session.where("rating <> 3").select("requestId", "movieId", ((col("rating") - 3) / 2).cast("double").alias("w")).join(vectors.select("movieId", "f", col("w").alias("x")), "movieId").select("requestId", "w", "f", "x")


def _sums(kinds: tuple[str, ...]):
    parts = {"combined": lambda w, x: w * x, "positive": lambda w, x: np.where(w > 0, np.abs(w * x), 0.0), "negative": lambda w, x: np.where(w < 0, np.abs(w * x), 0.0)}
    return lambda w, x: [parts[k](w, x) for k in kinds]


def _units(edge: np.ndarray, sums: list[np.ndarray]) -> list[np.ndarray]:
    """Sums divided by their norm in each request, 0 where they are 0 but for rounding."""
    out = []
    for s in sums:
        s = np.where(np.abs(s) > 1e-12, s, 0.0)
        n = np.repeat(np.sqrt(np.add.reduceat(s * s, edge[:-1])), np.diff(edge))
        out.append(np.divide(s, n, out=np.zeros_like(s), where=n > 0))
    return out


def profile_vectors(session: DataFrame, vectors: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``requestId, f`` and a list for each of ``kinds``: the profiles of a request as one row, with 0 where a kind lacks a feature. ``vectors`` as in :func:`products.packed`."""

    def finish(requests, edge, f, sums):
        # a movie's features travel as one row, a request's profile leaves as one
        lists = [pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(x)) for x in (f, *_units(edge, sums))]
        return [pa.array(requests), *lists]

    schema = "requestId long, f array<int>, " + ", ".join(f"{k} array<double>" for k in kinds)
    return finished(_met(session, vectors), schema, "requestId", _sums(kinds), finish)


def named(profiles: DataFrame, ids: DataFrame) -> DataFrame:
    """Profiles of :func:`profile_vectors` as ``requestId, kind, feature, weight``."""
    rows = profiles.select("requestId", F.inline(F.arrays_zip("f", *KINDS)))
    parts = F.array(*(F.struct(F.lit(k).alias("kind"), col(k).alias("weight")) for k in KINDS))
    return rows.select("requestId", "f", F.inline(parts)).where("weight <> 0").join(ids, "f").select("requestId", "kind", "feature", "weight")


def _shown(feature: str = "feature") -> dict:
    """The display text of a feature, and whether it explains nothing."""
    return {"display": F.regexp_replace(F.regexp_replace(feature, "^[a-zA-Z]+:", ""), "_", " "), "plain": col(feature).rlike("^(context|suitability):")}


def best_signals(session: DataFrame, vectors: DataFrame, ids: DataFrame, top: int = 10) -> DataFrame:
    """:func:`signals` of the profiles of ``session``, of which only features that may be among them leave the sums.

    As many features as have one display text, times the places and the plain features that may take a text away, hold the strongest
    texts; plain features, which come last, are all kept. Features are numbered in order, so plain ones stand in two ranges.
    """
    shown = ids.withColumns(_shown())
    most = shown.groupBy("display").count().agg(F.max("count")).first()[0] or 1
    ranges = shown.where("plain").groupBy(F.substring_index("feature", ":", 1)).agg(F.min("f"), F.max("f"), F.count("*")).collect()  # two rows
    keep = most * (top + sum(r[3] for r in ranges))

    def finish(requests, edge, f, sums):
        plain = np.zeros(len(f), bool)
        for r in ranges:
            plain |= (f >= r[1]) & (f <= r[2])
        request, out = np.repeat(np.arange(len(requests)), np.diff(edge)), []
        for kind, w in enumerate(_units(edge, sums)):
            at = np.flatnonzero(w > 0)
            at = at[np.lexsort((f[at], -np.floor(w[at] * 1e9 + 0.5), plain[at], request[at]))]
            start = np.searchsorted(request[at], np.arange(len(requests)))
            at = at[plain[at] | (np.arange(len(at)) - start[request[at]] < keep)]
            out.append((requests[request[at]], np.full(len(at), kind, np.int32), f[at], w[at]))
        return [pa.array(np.concatenate(x)) for x in zip(*out, strict=True)]

    rows = finished(_met(session, vectors), "requestId long, k int, f int, weight double", "requestId", _sums(KINDS[1:]), finish)
    kind = F.when(col("k") == 0, KINDS[1]).otherwise(KINDS[2])
    return signals(rows.join(ids, "f").select("requestId", kind.alias("kind"), "feature", "weight"), top)


def signals(profiles: DataFrame, top: int = 10) -> DataFrame:
    """The strongest features of the positive and negative profiles, one for each display text, unexplainable ones last."""
    first = F.row_number().over(Window.partitionBy("requestId", "kind", "display").orderBy(round_away(col("weight"), 9).desc(), "feature"))
    rank = F.row_number().over(Window.partitionBy("requestId", "kind").orderBy("plain", round_away(col("weight"), 9).desc(), "feature"))
    best = profiles.where("kind <> 'combined' and weight > 0").withColumns(_shown()).withColumn("n", first).where("n = 1")
    return best.withColumn("rank", rank).where(col("rank") <= top).drop("n")


def similarity(session: DataFrame, vectors: DataFrame, titles: DataFrame, top: int = K.POOL) -> DataFrame:
    """``requestId, movieId, similarity, rank`` of unrated movies by their product with the combined profile; ties by title without case, from ``titles (movieId, title)``, then id."""
    own = stored(profile_vectors(session, vectors, KINDS[:1]).select("requestId", "f", col("combined").alias("w")))
    return best_of_vectors(own, vectors, session.select("requestId", "movieId"), titles, top)


def content_score(similar: DataFrame, items: DataFrame) -> DataFrame:
    """Adds ``score`` and its ``rank``; ties by similarity, display score, title without case and id."""
    a, b = K.CONTENT_SCORE
    scored = similar.drop("rank").join(items.select("movieId", "standDisplayScore", F.lower("title").alias("folded")), "movieId").withColumn("score", a * F.greatest("similarity", F.lit(0.0)) + b * F.coalesce("standDisplayScore", F.lit(0.0)))
    order = [round_away(col("score"), 9).desc(), round_away(col("similarity"), 9).desc(), F.coalesce("standDisplayScore", F.lit(0.0)).desc(), F.coalesce("folded", F.lit("")), "movieId"]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("requestId").orderBy(*order))).drop("folded")


def diversify(scored: DataFrame, features: DataFrame, limit: int = 10, weight: float = K.MMR_WEIGHT) -> DataFrame:
    """:func:`diversified` for ``features (movieId, feature, weight)``."""
    return diversified(scored, packed(features)[0], limit, weight)


def diversified(scored: DataFrame, vectors: DataFrame, limit: int = 10, weight: float = K.MMR_WEIGHT) -> DataFrame:
    """Greedy maximal marginal relevance within each request's pool of at most POOL movies: ``requestId, movieId, mmr, rank``. Values equal at nine places go by the pool's rank, which has the score's tie order; movies without a vector are left out. Each pick depends on those before, so a request's pool is one row."""
    pool = scored.where(col("rank") <= K.POOL).groupBy("requestId").agg(F.array_sort(F.collect_list(F.struct("rank", "movieId", "score"))).alias("l"))
    pool = pool.select("requestId", col("l.movieId").alias("movies"), col("l.score").alias("score"))

    def pick(u: pa.Table, vectors: Vectors):
        dense = np.zeros(vectors.wide)
        for request, movies, score in zip(u.column("requestId").to_numpy(), u.column("movies"), u.column("score"), strict=True):
            movies, score = movies.values.to_numpy(), score.values.to_numpy()
            f, w, edge = vectors.at(movies)
            free = np.diff(edge) > 0
            nearest, chosen, values = np.zeros(len(movies)), [], []
            for n in range(min(limit, int(free.sum()))):
                value = weight * score - (1 - weight) * nearest if n else score
                best = int(np.argmax(np.where(free, np.round(value, 9), -np.inf)))  # the first of equal ones
                chosen.append(best)
                values.append(value[best])
                free[best] = False
                own = slice(edge[best], edge[best + 1])
                dense[f[own]] = w[own]
                nearest = np.maximum(nearest, products_with(dense, f, w, edge))
                dense[f[own]] = 0.0
            yield np.full(len(chosen), request), movies[chosen], np.array(values, float), np.arange(1, len(chosen) + 1)

    return beside(pool, "movies", vectors, pick, "requestId long, movieId long, mmr double, rank int")


def shared_signals(best: DataFrame, profiles: DataFrame, vectors: DataFrame, top: int = 12) -> DataFrame:
    """``requestId, movieId, f, n``: the ``top`` features of each of ``best (requestId, movieId)`` by their product with the request's positive profile, as :func:`profile_vectors` has it; ties by feature."""
    lists = best.groupBy("requestId").agg(F.collect_list("movieId").alias("movies"))
    rows = lists.join(profiles.select("requestId", "f", "positive"), "requestId")

    def pick(u: pa.Table, vectors: Vectors):
        for request, movies, f, p in zip(u.column("requestId").to_numpy(), u.column("movies"), u.column("f"), u.column("positive"), strict=True):
            movies = movies.values.to_numpy()
            mine, w, edge = vectors.at(movies)
            dense = np.zeros(max(vectors.wide, 1 + int(f.values.to_numpy().max(initial=-1))))
            dense[f.values.to_numpy()] = p.values.to_numpy()
            row, x = np.repeat(np.arange(len(movies)), np.diff(edge)), dense[mine] * w
            at = np.flatnonzero(dense[mine] > 0)
            at = at[np.lexsort((mine[at], -np.floor(x[at] * 1e9 + 0.5), row[at]))]
            n = np.arange(len(at)) - np.searchsorted(row[at], row[at]) + 1
            at, n = at[n <= top], n[n <= top]
            yield np.full(len(at), request), movies[row[at]], mine[at], n

    return beside(rows, "movies", vectors, pick, "requestId long, movieId long, f int, n int")


def style(session: DataFrame, items: DataFrame) -> DataFrame:
    """``requestId, style``: family, teen or mixed, by the categories of liked movies and their family genres, with a margin of 2."""
    liked = session.where("rating >= 4").join(items.select("movieId", "suitabilityCategory", "genres"), "movieId")
    family = F.sum(F.when(col("suitabilityCategory") == "family_friendly", 2).otherwise(0) + F.when(F.arrays_overlap("genres", F.array(F.lit("Animation"), F.lit("Family"))), 1).otherwise(0))
    teen = F.sum(F.when(col("suitabilityCategory") == "teen", 2).otherwise(0) + F.when(F.arrays_overlap("genres", F.array(F.lit("Action"), F.lit("Thriller"))), 1).otherwise(0))
    by = liked.groupBy("requestId").agg(family.alias("f"), teen.alias("t"))
    return by.select("requestId", F.when(col("f") >= col("t") + 2, "family").when(col("t") >= col("f") + 2, "teen").otherwise("mixed").alias("style"))
