"""Kneser-Ney word pairs without a bound on the vocabulary, for the perplexity of every row under all other rows.

Words are runs of bytes other than white space, as written (case, digits and script count). A word's history is the word
before it, by one of CLASSES hash classes; frequent words have theirs nearly alone. A row's distinct pairs of history and word
go once, as sorted packed arrays, to the shard of their word, which scores all rows that have the word: it has all
counts of the pair and all histories of the word, so no table of words is ever broadcast, and the model grows with the corpus by
the number of its shards. What a row itself adds is taken off these counts exactly, so junk that occurs nowhere else
doesn't vouch for itself. Only the totals of the histories, one number a class and language, are broadcast.

A pair that other rows have ``c`` times has ``(c - D(c)) / c(history)``. Any other has the mass that discounts leave to histories of
its frequency (GROUPS of classes by rank) times ``(N(w) - D) / T`` for N(w) distinct histories of the word in other rows among T
pairs; a word that no other row has gets ``D * V / T`` (V words) times the probability of its spelling under the byte model.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.llm.arrays import U, byte_spans, chunks, expand, i64, mix, squeeze, words
from velum.llm.shared import cut

CLASSES = 1 << 12
GROUPS = 8
#: Discounts of pairs by count (1, 2, 3 and more) and of histories.
DISCOUNTS = np.asarray([0.0, 0.7, 1.05, 1.4])
DISCOUNT = 0.75
#: Bytes of text whose words make one shard, on average; the number of shards grows with the corpus.
SHARD_BYTES = 24 << 20
#: Bits of a word's hash that tell it from others.
WORD_BITS = 48
START = U(0x5851F42D4C957F2D)
#: Parts of a nat in which spellings travel.
STEPS = 64
GRAMS = "lang string, part int, block long, word binary, many binary, doc binary, history binary, m binary, spelt binary"
LEFT = [f"left{g}" for g in range(GROUPS)]
UNSEEN = [f"unseen{g}" for g in range(GROUPS)]
PARTS = "lang string, block long, doc binary, sums binary, unseen binary, new binary, keys binary, size binary, spelt binary, pairs long, words long, " + ", ".join(f"{c} double" for c in LEFT)
BLOCKS = "lang string, key long, size long, spelt double, logp double, new long, " + ", ".join(f"{c} long" for c in UNSEEN)


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def events(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each word of a chunk: begin, end, document, hash and the class of its history."""
    s, e, doc = words(data, offs)
    word = byte_spans(data).of(s, e)
    before = np.concatenate([[START], word])[: len(word)]
    before[np.flatnonzero(np.diff(doc, prepend=-1))] = START
    return s, e, doc, word >> U(64 - WORD_BITS), (mix(before) >> U(20)).astype(np.int64) % CLASSES


def grams(docs: DataFrame, spelling, shards: int) -> DataFrame:
    """Packed pairs of ``docs (key, lang, text)`` for each block of rows, language and shard; negative parts name a block's rows (``word`` has their keys, ``doc`` their places, ``m`` their sizes)."""

    def row(lang, part, block, *arrays):
        return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([part], pa.int32()), pa.array([block], pa.int64()), *(pa.array([squeeze(a)], pa.binary()) for a in arrays)], _names(GRAMS))

    def run(batches):
        for batch in batches:
            for rows, data, offs in chunks(batch, limit=4 << 20):
                keys = rows.column(0).to_numpy()
                total = np.concatenate([[0.0], np.cumsum(spelling(rows, data, offs), dtype=np.float64)])
                codes, langs = pd.factorize(rows.column(1).to_pandas(), use_na_sentinel=False)
                s, e, doc, word, history = events(data, offs)
                at = np.lexsort((doc * CLASSES + history, word))
                word, doc, history = word[at], doc[at], history[at]
                first = np.flatnonzero((np.diff(word, prepend=U(0)) != 0) | (np.diff(doc * CLASSES + history, prepend=-1) != 0))
                m = np.diff(np.append(first, len(word)))
                word, doc, history, at = word[first], doc[first], history[first], at[first]
                for i, lang in enumerate(langs):
                    lang = None if pd.isna(lang) else lang
                    mine = np.flatnonzero(codes == i)
                    block = int(mix(mix(keys[mine].view(U)) ^ mine.astype(U)).sum(dtype=U) >> U(1))
                    none = mine[:0]
                    yield row(lang, -1 - block % max(shards // 4, 1), block, keys[mine], none, np.diff(mine, prepend=0).astype(np.int32), none, np.diff(offs)[mine].astype(np.int64), np.diff(total[offs])[mine])
                    own = np.flatnonzero(codes[doc] == i) if len(langs) > 1 else np.arange(len(doc))
                    edges = np.searchsorted(word[own], (np.arange(1, shards, dtype=np.float64) * (2.0**WORD_BITS / shards)).astype(U))
                    for j, k in enumerate(np.split(own, edges)):
                        if not len(k):
                            continue
                        w, d = word[k], doc[k]
                        new = np.diff(w, prepend=U(0)) != 0
                        new[0] = True
                        head = np.flatnonzero(new)
                        gap = np.diff(d, prepend=0)
                        gap[head] = d[head]
                        spelt = np.clip(np.rint((total[s[at[k[head]]]] - total[e[at[k[head]]]]) * STEPS), 0, 65_535)
                        yield row(lang, j, block, np.diff(w[head], prepend=U(0)), np.diff(np.append(head, len(k))).astype(np.int32), gap.astype(np.int32), history[k].astype(np.uint16), m[k].astype(np.int32), spelt.astype(np.uint16))

    return docs.select("key", "lang", "text").mapInArrow(run, GRAMS)


def groups(totals: np.ndarray) -> np.ndarray:
    """The group of each history class, by rank of its total."""
    rank = np.empty(CLASSES, np.int64)
    rank[np.argsort(-totals, kind="stable")] = np.arange(CLASSES)
    return (np.log2(rank + 1.0) * GROUPS / np.log2(CLASSES + 1.0)).astype(np.int64)


def judge(word: np.ndarray, row: np.ndarray, history: np.ndarray, m: np.ndarray, spelt: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int, np.ndarray]:
    """For each entry, in order of block, word and row: ``m`` times what is known here of its log-probability; whether its pair, and whether its word is in no other row; then the numbers of pairs and words and the mass left in each group."""
    pairs, at = np.unique(word * U(CLASSES) + history.astype(U), return_inverse=True)
    c = np.bincount(at, m).astype(np.int64)
    held, of = np.unique(pairs // U(CLASSES), return_inverse=True)
    rest = c[at] - m
    alone = rest == 0
    group = np.cumsum((np.diff(word, prepend=word[:1]) != 0) | (np.diff(row, prepend=row[:1]) != 0))
    n = np.bincount(of)[of][at] - np.bincount(group, alone)[group]
    novel = alone & (n <= 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.where(alone, np.where(novel, -spelt, np.log(n - DISCOUNT)), np.log(rest - DISCOUNTS[np.minimum(rest, 3)]) - np.log(totals[history]))
    left = np.bincount(groups(totals)[(pairs % U(CLASSES)).astype(np.int64)], DISCOUNTS[np.minimum(c, 3)], minlength=GROUPS)
    return value * m, alone, novel, len(pairs), len(held), left


def _part(totals: dict):
    def run(t: pa.Table) -> pa.Table:
        lang, part = t.column("lang")[0].as_py(), t.column("part")[0].as_py()
        read = lambda c, kind: [expand(x, kind) for x in t.column(c).to_pylist()]
        blocks, zeros, out = t.column("block").to_pylist(), [0.0] * GROUPS, []
        if part < 0:
            for block, *own in zip(blocks, *(t.column(c).to_pylist() for c in ("doc", "word", "m", "spelt")), strict=True):
                out.append((lang, block, own[0], None, None, None, *own[1:], 0, 0, *zeros))
        else:
            many = read("many", np.int32)
            sizes = [int(x.sum()) for x in many]
            word = np.concatenate([np.repeat(np.cumsum(x), k) for x, k in zip(read("word", U), many, strict=True)])
            spelt = np.concatenate([np.repeat(x, k) for x, k in zip(read("spelt", np.uint16), many, strict=True)]) / STEPS
            doc = []
            for gap, k in zip(read("doc", np.int32), many, strict=True):
                sums, first = np.cumsum(gap, dtype=np.int64), np.cumsum(k) - k
                doc.append(sums - np.repeat(sums[first] - gap[first], k))
            history, m = np.concatenate(read("history", np.uint16)).astype(np.int64), np.concatenate(read("m", np.int32))
            row = np.concatenate(doc) + (np.repeat(np.arange(len(doc)), sizes) << 32)
            value, alone, novel, pairs, n_words, left = judge(word, row, history, m, spelt, totals[lang])
            unseen = groups(totals[lang])[history]
            ends = np.cumsum(sizes)
            for i, (block, d, b) in enumerate(zip(blocks, doc, ends, strict=True)):
                own = slice(b - sizes[i], b)
                place, of = np.unique(d, return_inverse=True)
                sums = np.bincount(of, value[own]).astype(np.float32)
                met = np.bincount(of * GROUPS + unseen[own], alone[own] * m[own], minlength=len(place) * GROUPS).astype(np.int32)
                new = np.bincount(of, novel[own] * m[own]).astype(np.int32)
                first = (pairs, n_words, *left.tolist()) if not i else (0, 0, *zeros)
                out.append((lang, block, squeeze(np.diff(place, prepend=0).astype(np.int32)), squeeze(sums), squeeze(met), squeeze(new), None, None, None, *first))
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
        return pa.table([pa.array(c, kinds[f.split()[1]]) for c, f in zip(zip(*out, strict=True), PARTS.split(", "), strict=True)], _names(PARTS))

    return run


def _block(t: pa.Table) -> pa.Table:
    """A block's rows with the sums of all shards; ``keys`` is set in the rows that name them."""
    rows = t.to_pylist()
    heads = [r for r in rows if r["keys"] is not None]
    place = np.cumsum(expand(heads[0]["doc"], np.int32))
    logp, new, unseen = np.zeros(len(place)), np.zeros(len(place), np.int64), np.zeros((len(place), GROUPS), np.int64)
    for r in rows:
        if r["keys"] is None:
            at = np.searchsorted(place, np.cumsum(expand(r["doc"], np.int32)))
            logp[at] += expand(r["sums"], np.float32)
            new[at] += expand(r["new"], np.int32)
            unseen[at] += expand(r["unseen"], np.int32).reshape(-1, GROUPS)
    # Equal blocks of rows with equal keys come under one name.
    size, spelt = (sum(expand(r[c], kind) for r in heads) for c, kind in (("size", np.int64), ("spelt", np.float64)))
    return pa.table({"lang": pa.array([heads[0]["lang"]] * len(place), pa.string()), "key": expand(heads[0]["keys"], np.int64), "size": size, "spelt": spelt, "logp": logp, "new": new} | dict(zip(UNSEEN, unseen.T.copy(), strict=True)))


def nats(docs: DataFrame, spelling, size: int, totals: dict) -> DataFrame:
    """``key, nats, spelt``: nats a byte, by words and by spelling alone, of each distinct ``key`` of ``docs (key, lang, text)`` of ``size`` bytes in all; rows with one key have one text and language. ``totals`` has the words after each history class by language."""
    shards = max(1, -(-size // SHARD_BYTES))
    parts = cut(grams(docs, spelling, shards).groupBy("lang", "part").applyInArrow(_part(totals), PARTS))
    sums = parts.groupBy("lang").agg(F.greatest(F.sum("pairs"), F.lit(1)).alias("T"), F.greatest(F.sum("words"), F.lit(1)).alias("V"), *(F.sum(c).alias(c) for c in LEFT)).collect()
    logs = []
    for r in sums:
        own = totals.get(r["lang"], np.zeros(CLASSES))
        all_ = np.bincount(groups(own), own, minlength=GROUPS)
        left = [float(np.log(r[c] / a)) if a and r[c] else 0.0 for c, a in zip(LEFT, all_, strict=True)]
        logs.append((r["lang"], float(np.log(r["T"])), float(np.log(r["V"] * DISCOUNT)), left))
    spark = docs.sparkSession
    logs = spark.createDataFrame(logs, "log_lang string, lt double, lv double, ll array<double>")
    rows = parts.groupBy("lang", "block").applyInArrow(_block, BLOCKS)
    rows = rows.groupBy("key").agg(F.first("lang").alias("lang"), *(F.sum(c).alias(c) for c in ("size", "spelt", "logp", "new", *UNSEEN)))
    rows = rows.join(F.broadcast(logs), rows["lang"].eqNullSafe(logs["log_lang"]))
    logp = F.col("logp") + F.col("new") * F.col("lv")
    for g, c in enumerate(UNSEEN):
        logp = logp + F.col(c) * (F.col("ll")[g] - F.col("lt"))
    size = F.greatest("size", F.lit(1))
    return rows.select("key", (-logp / size).alias("nats"), (-F.col("spelt") / size).alias("spelt"))


def class_totals(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and history class of each word of a chunk."""
    _, _, doc, _, history = events(data, offs)
    return doc, history
