"""Quality rules with a modified Kneser-Ney n-gram model.

A document's words are scored under the word pairs of all other rows of its language (see ``wordgrams``, unbounded and
sharded). Only words that no other row has are spelt by a byte model: its symbols are UTF-8 bytes folded to 64 classes (letters without case, digits as one, marks, lead and continuation
bytes), n-grams of 4 symbols are counted per language over whole texts by Spark, and the model of a language is a few
sorted arrays of n-gram keys. A language has at most 64**4 keys, whatever the corpus; models are broadcast in groups
of languages of bounded size. A document is rejected by base rules or when its log-perplexity, by words
or by spelling, leaves its language's band, which is set from the quartiles of all documents that pass the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.llm import wordgrams
from velum.llm.arrays import SPACE, Spans, U, byte_spans, chunks, i64, mix, split, words
from velum.llm.shared import cut

ORDER = 4
BITS = 6
#: n-gram keys of the languages scored in one pass; a single language may have up to 64**4.
GROUP_KEYS = 8_000_000
#: Bands: quartiles widened below and above by so many interquartile ranges, set on labelled documents (README). Copies lie low by words; they are for deduplication.
RANGES = {"log_perplexity": (6.0, 4.0), "spelling_perplexity": (2.0, 2.5)}
SYMBOLS = b"#*$%&|<>"
LOG, SPELLING = "log_perplexity", "spelling_perplexity"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _classes() -> np.ndarray:
    """The class of each byte: 0 space, 1-26 letters, 27 digit, 28-48 marks, 49 control, 50-52 lead bytes, 53-63 continuation bytes."""
    out = np.full(256, 49, np.uint8)
    out[SPACE] = 0
    out[65:91] = out[97:123] = np.arange(1, 27)
    out[48:58] = 27
    out[33:48] = out[58:65] = out[91:97] = out[123:127] = 40
    for i, c in enumerate(b".,!?'\"-:;()/"):
        out[c] = 28 + i
    for i, c in enumerate(SYMBOLS):
        out[c] = 41 + i
    out[0xC0:0xE0], out[0xE0:0xF0], out[0xF0:] = 50, 51, 52
    out[0x80:0xC0] = 53 + np.arange(64) * 11 // 64
    return out


CLASS = _classes()
IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
NEWLINE = np.arange(256) == 10


def keys(data: np.ndarray, offs: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each byte, the n-gram that ends there; spaces stand before a text."""
    n, symbols = len(data), CLASS[data]
    out = symbols.astype(np.uint32)
    for j in range(1, min(order, n)):
        part = np.zeros(n, np.uint32)
        part[j:] = symbols[:-j].astype(np.uint32) << np.uint32(BITS * j)
        early = (offs[:-1, None] + np.arange(j)).ravel()  # bytes with fewer than j before them in their text; a space is class 0
        part[early[early < n]] = 0
        out |= part
    return out


def _by_language(batch: pa.RecordBatch, offs: np.ndarray) -> Iterator[tuple[str | None, np.ndarray, np.ndarray]]:
    """Each language of a chunk, which bytes and which rows are its."""
    codes, names = pd.factorize(batch.column(batch.schema.get_field_index("lang")).to_pandas(), use_na_sentinel=False)
    for i, name in enumerate(names):
        yield (None if pd.isna(name) else name), np.repeat(codes == i, np.diff(offs)), codes == i


def count(docs: DataFrame) -> DataFrame:
    """``lang, key, n``: how often each n-gram of ORDER symbols ends in the texts of a language; negative keys count the words after each history class. A null language is its own."""

    def partial(batches):
        held: dict[str | None, list] = {}
        for batch in batches:
            for rows, data, offs in chunks(batch):
                k = keys(data, offs).astype(np.int64)
                doc, history = wordgrams.class_totals(data, offs)
                for lang, own, mine in _by_language(rows, offs):
                    held.setdefault(lang, []).append(np.unique(np.concatenate([-1 - history[mine[doc]], k[own]]), return_counts=True))
                    if len(held[lang]) >= 16:
                        held[lang] = [merge(held[lang])]
        for lang, parts in held.items():
            k, n = merge(parts)
            for a in range(0, len(k), 100_000):
                b = a + 100_000
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k[a:b]), pa.string()), i64(k[a:b]), i64(n[a:b])], ["lang", "key", "n"])

    def merge(parts):
        if len(parts) == 1:
            return parts[0]
        k, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return k, np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)

    return docs.select("lang", "text").mapInArrow(partial, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


class Model:
    """Modified Kneser-Ney probabilities of one language in sorted arrays, from the counts of its longest n-grams."""

    def __init__(self, key: np.ndarray, n: np.ndarray, order: int = ORDER):
        by = np.argsort(key)
        key, n = key[by].astype(np.uint32), n[by].astype(np.float64)
        levels = []
        for k in range(order, 0, -1):
            levels.append((key, n))
            key, n = np.unique(key & np.uint32((1 << BITS * (k - 1)) - 1), return_counts=True)  # in how many contexts the shorter one continues
            n = n.astype(np.float64)
        self.levels = []  # from the shortest: keys, log-probabilities, context keys, log of the mass left to shorter n-grams
        for key, n in reversed(levels):
            t = [max(float((n == i).sum()), 1.0) for i in range(1, 5)]
            y = t[0] / (t[0] + 2 * t[1])
            d = [0.0, *(min(max(i - (i + 1) * y * t[i] / t[i - 1], 0.05), i - 0.05) for i in (1, 2, 3))]
            off = np.asarray(d)[np.minimum(n, 3).astype(int)]
            context, start = np.unique(key >> np.uint32(BITS), return_index=True)
            total, left = np.add.reduceat(n, start), np.add.reduceat(off, start)
            which = np.searchsorted(context, key >> np.uint32(BITS))
            p = (n - off) / total[which] + left[which] / total[which] * self._shorter(key, len(self.levels))
            self.levels.append((key, np.log(p).astype(np.float32), context, np.log(left / total).astype(np.float32)))

    def _shorter(self, key: np.ndarray, have: int) -> np.ndarray:
        return np.exp(self.logp(key & np.uint32((1 << BITS * have) - 1), have)) if have else np.full(len(key), 1 / (1 << BITS))

    def logp(self, key: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log-probability of the last symbol of each n-gram; unseen ones fall back to shorter ones."""
        if not order:
            return np.full(len(key), -np.log(1 << BITS), np.float32)
        have, p, context, left = self.levels[order - 1]
        at = np.minimum(np.searchsorted(have, key), len(have) - 1)
        out, new = p[at], have[at] != key
        if new.any():
            k = key[new]
            c = np.minimum(np.searchsorted(context, k >> np.uint32(BITS)), len(context) - 1)
            known = context[c] == k >> np.uint32(BITS)
            out[new] = self.logp(k & np.uint32((1 << BITS * (order - 1)) - 1), order - 1) + np.where(known, left[c], 0)
        return out


def measures(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each document of a chunk."""
    nd = len(offs) - 1
    total = lambda per_byte: np.diff(np.concatenate([[0], np.cumsum(per_byte)])[offs])
    s, e, doc = words(data, offs)
    out = {"n_words": np.bincount(doc, minlength=nd), "word_chars": total(~SPACE[data] & ((data & 0xC0) != 0x80)), "n_symbols": total(IS_SYMBOL[data])}
    spans = byte_spans(data)
    a, b, at = split(data, offs, NEWLINE)
    filled = np.concatenate([[0], np.cumsum(~SPACE[data])])
    full = filled[b] > filled[a]
    a, b, at = a[full], b[full], at[full]
    h = spans.of(a, b) ^ mix(at.astype(U) + U(1))
    out["n_dup_lines"] = np.bincount(at, minlength=nd) - np.bincount(at[np.unique(h, return_index=True)[1]], minlength=nd)
    covered = np.zeros(len(s) + 1, np.int32)
    if len(s) >= 3:
        w = Spans(spans.of(s, e), 1)
        i = np.flatnonzero(doc[:-2] == doc[2:])
        h = w.of(i, i + 3) ^ mix(doc[i].astype(U) + U(1))
        by = np.argsort(h)
        same = h[by][1:] == h[by][:-1]
        twice = np.zeros(len(h), bool)
        twice[by[1:][same]] = twice[by[:-1][same]] = True
        np.add.at(covered, i[twice], 1)
        np.add.at(covered, i[twice] + 3, -1)
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(covered[:-1]) > 0], minlength=nd)
    return out


def score(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """``docs`` without text, plus the base counts ``log_perplexity`` of its words under all other rows of its language and ``spelling_perplexity`` under the byte model (nats a byte; 0 without text)."""
    sizes = sorted(((r["lang"], r["n"], r["bytes"]) for r in counts.where("key >= 0").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n").alias("bytes")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    groups, room = [], 0
    for lang, n, size in sizes:
        if not groups or room + n > GROUP_KEYS:
            groups.append([])
            room = 0
        groups[-1].append((lang, size))
        room += n
    lacks = [c for c in docs.columns if c != "text"]
    within = lambda langs: F.coalesce(F.col("lang").isin([x for x in langs if x is not None]), F.lit(False)) | (F.col("lang").isNull() if None in langs else F.lit(False))
    spark, out = docs.sparkSession, None
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "lang", "text"))
    for i, group in enumerate(groups or [[]]):
        langs = [x for x, _ in group]
        frame = counts.where(within(langs)).toPandas()
        models, totals = {}, {}
        for lang, own in frame.groupby("lang", dropna=False):
            lang, (key, n) = None if pd.isna(lang) else lang, (own[c].to_numpy() for c in ("key", "n"))
            models[lang] = Model(key[key >= 0], n[key >= 0])
            totals[lang] = np.bincount(-1 - key[key < 0], n[key < 0], minlength=wordgrams.CLASSES)
        # The last pass also takes languages of which no text has a byte.
        rows = keyed if len(groups) < 2 else keyed.where(within(langs)) if i + 1 < len(groups) else keyed.where(~within([x for g in groups[:-1] for x, _ in g]))
        part = wordgrams.nats(rows.select(F.col("__key").alias("key"), "lang", "text"), _spelling(spark.sparkContext.broadcast(models)), sum(size for _, size in group), totals)
        out = part if out is None else out.unionByName(part)
    scored = _measured(keyed, [*lacks, "__key"]).join(out, F.col("__key") == F.col("key"), "left")
    return scored.select(*[F.col(f"`{c}`") for c in lacks], *MEASURES, F.coalesce("nats", F.lit(0.0)).alias("log_perplexity"), F.coalesce("spelt", F.lit(0.0)).alias("spelling_perplexity"))


def _spelling(models):
    def logp(rows: pa.RecordBatch, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """For each byte of a chunk, its log-probability under the byte model of its row's language."""
        k, out = keys(data, offs), np.zeros(len(data), np.float32)
        for lang, own, _ in _by_language(rows, offs):
            if lang in models.value:
                out[own] = models.value[lang].logp(k[own])
        return out

    return logp


def _measured(docs: DataFrame, lacks: list[str]) -> DataFrame:
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"`{c}` {fields[c]}" for c in lacks] + [f"{c} long" for c in MEASURES])

    def run(batches):
        for batch in batches:
            for rows, data, offs in chunks(batch):
                m = measures(data, offs)
                yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index(c)) for c in lacks] + [i64(m[c]) for c in MEASURES], [*lacks, *MEASURES])

    # The columns are selected by name so that clashing extra ones keep their place.
    return docs.select(*[F.col(f"`{c}`") for c in [*lacks, "text"]]).mapInArrow(run, schema)


def judge(scored: DataFrame, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Adds ``base_failed``, the language's ``low`` and ``high`` (``spelling_low``, ``spelling_high``) and ``kept``. A language without documents that pass the base rules has no bands and keeps none of them."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    q = lambda c, p: F.percentile_approx(c, p, 10_000)
    quartiles = [q(c, p).alias(f"{c}_{p}") for c in (LOG, SPELLING) for p in (0.25, 0.75)]
    bands = scored.where("not base_failed").groupBy(F.col("lang").alias("band_lang")).agg(*quartiles)
    q1, q3 = (lambda c: F.col(f"`{c}_0.25`")), (lambda c: F.col(f"`{c}_0.75`"))
    width = lambda c, side: RANGES[c][side] * (q3(c) - q1(c))
    edges = [e for c, name in ((LOG, ""), (SPELLING, "spelling_")) for e in ((q1(c) - width(c, 0)).alias(f"{name}low"), (q3(c) + width(c, 1)).alias(f"{name}high"))]
    bands = bands.select("band_lang", *edges)
    inside = F.col(LOG).between(F.col("low"), F.col("high")) & F.col(SPELLING).between(F.col("spelling_low"), F.col("spelling_high"))
    return scored.join(bands, scored["lang"].eqNullSafe(bands["band_lang"]), "left").drop("band_lang").withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def rules(docs: DataFrame) -> DataFrame:
    """Verdicts for ``docs`` (at least ``doc_id, text, lang``), one row each.

    Null and empty texts have no words and fail the base rules. Null languages share a model. Repeated rows and ids are
    judged one by one. Columns of ``docs`` other than doc_id and lang are not returned, so clashing names do no harm.
    An empty table gives an empty table.
    """
    docs = docs.select("doc_id", "lang", "text")
    return judge(cut(score(docs, cut(count(docs)))))


def query(documents: DataFrame) -> DataFrame:
    return rules(documents).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "log_perplexity", "spelling_perplexity")
