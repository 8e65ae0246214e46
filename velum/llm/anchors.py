"""Passages of at least L tokens that occur more than once in a corpus: the parts that substring operators share.

Every window of L tokens has an anchor, the position of its smallest k-gram hash (leftmost of equals), which depends on
the window's content alone. Consecutive windows of one anchor form a block, about two in L - k + 1 positions begin
one, and equal windows lie in blocks with equal anchor k-grams. So a block whose k-gram occurs once in the corpus
holds no repeat and goes no further; equal blocks are carried once with their number of occurrences; and the distinct
rest is routed by k-gram to the task that decides its windows exactly. Nothing is sampled or capped, and no pair of
copies is ever formed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.llm.arrays import BYTE, Spans, U, byte_spans, chunks, first_of, i64, mix, sliding_min, words
from velum.llm.shared import cut, drop

#: Low bits of a k-gram's hash that give way to its position when minima are sought.
PLACE = (1 << 28) - 1


def byte_tokens(data: np.ndarray, offs: np.ndarray):
    """Two hash values for each byte, the offsets of the texts in tokens, begins and ends in bytes."""
    at = np.arange(len(data) + 1)
    return BYTE[0][data], BYTE[1][data], offs, at[:-1], at[1:]


def word_tokens(data: np.ndarray, offs: np.ndarray):
    s, e, doc = words(data, offs)
    return byte_spans(data, 0).of(s, e), byte_spans(data, 1).of(s, e), first_of(doc, len(offs) - 1), s, e


def blocks(values: np.ndarray, bounds: np.ndarray, length: int, k: int):
    """First window, number of windows, anchor and anchor hash of each block, for texts that begin at ``bounds``."""
    n = len(values)
    if n < length:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    i = np.arange(n - k + 1)
    g = Spans(values, 1).of(i, i + k)
    low = sliding_min((g & ~U(PLACE)) | i.astype(U), length - k + 1)
    p = np.arange(n - length + 1)
    p = p[p + length <= bounds[np.searchsorted(bounds, p, "right")]]
    a = (low[p] & U(PLACE)).astype(np.int64)
    new = np.ones(len(p), bool)
    new[1:] = (np.diff(p) != 1) | (np.diff(a) != 0)
    first = np.flatnonzero(new)
    return p[first], np.diff(np.concatenate([first, [len(p)]])), a[first], g[a[first]]


def members(texts: DataFrame, tokens: Callable, length: int, k: int) -> DataFrame:
    """Blocks of ``texts (t1, t2, copies, text)``: ``t1, t2, copies, ah, b1, b2, nwin, back, starts``, with the starts of equal blocks of a text in one row."""

    def run(batches):
        for batch in batches:
            for rows, data, offs in chunks(batch):
                v0, v1, bounds, *_ = tokens(data, offs)
                l, nwin, a, ah = blocks(v1, bounds, length, k)
                if not len(l):
                    continue
                end = l + nwin - 1 + length
                b1, b2 = Spans(v0, 0).of(l, end), Spans(v1, 1).of(l, end)
                doc = np.searchsorted(bounds, l, "right") - 1
                by = np.lexsort((l, b2, b1, doc))
                b1, b2, doc, ah, nwin, a, l = (x[by] for x in (b1, b2, doc, ah, nwin, a, l))
                new = np.ones(len(l), bool)
                new[1:] = (b1[1:] != b1[:-1]) | (b2[1:] != b2[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(new)
                starts = pa.ListArray.from_arrays(pa.array(np.concatenate([at, [len(l)]]).astype(np.int32)), pa.array((l - bounds[doc]).astype(np.int32)))
                own = pa.array(doc[at])
                yield pa.RecordBatch.from_arrays([rows.column(0).take(own), rows.column(1).take(own), rows.column(2).take(own), i64(ah[at]), i64(b1[at]), i64(b2[at]), pa.array(nwin[at].astype(np.int32)), pa.array((a - l)[at].astype(np.int32)), starts], ["t1", "t2", "copies", "ah", "b1", "b2", "nwin", "back", "starts"])

    return texts.select("t1", "t2", "copies", "text").mapInArrow(run, "t1 long, t2 long, copies long, ah long, b1 long, b2 long, nwin int, back int, starts array<int>")


def contents(blocks_: DataFrame, texts: DataFrame, tokens: Callable, length: int, width: int) -> tuple[DataFrame, Callable]:
    """A table of texts with their distinct blocks, and what turns its batches into the blocks' tokens, within one Python worker.

    The rows made are ``shard, b1, b2, weight, origin, nwin, back, content``: ``content`` is the bytes of the block,
    ``origin`` its first window in the block that it came from and ``back`` the anchor's place in it. A block of a
    big group comes in slices of up to ``width`` windows, by their distance to the anchor; the shard of a slice is the
    hash of what all windows at these distances have in common, so only blocks that agree there meet.
    """
    per_text = blocks_.groupBy("t1", "t2").agg(F.collect_list(F.struct("b1", "b2", "ah", "weight", "nwin", "back", "start", "big")).alias("blocks"))
    wide = texts.select("t1", "t2", "text").join(per_text, ["t1", "t2"]).select("text", "blocks")

    def run(batches):
        for batch in batches:
            for rows, data, offs in chunks(batch):
                v0, v1, bounds, s, e = tokens(data, offs)
                lists = rows.column(1)
                flat = lists.flatten()
                col = lambda c: flat.field(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                doc = np.repeat(np.arange(rows.num_rows), lists.value_lengths().to_numpy())
                b1, b2, ah, weight, nwin, back, big = (col(c) for c in ("b1", "b2", "ah", "weight", "nwin", "back", "big"))
                l, big = col("start") + bounds[doc], big.astype(bool)
                anchor = l + back
                lo, hi = back - nwin + 1, back  # distances of the last and the first window to the anchor
                slices = np.where(big, hi // width - lo // width + 1, 1)
                take = np.repeat(np.arange(len(l)), slices)
                j = lo[take] // width + np.arange(len(take)) - np.repeat(np.cumsum(slices) - slices, slices)
                cut_ = big[take]
                far = np.where(cut_, np.minimum(hi[take], (j + 1) * width - 1), hi[take])
                near = np.where(cut_, np.maximum(lo[take], j * width), lo[take])
                begin, many = anchor[take] - far, far - near + 1
                shard = ah[take].copy()
                if cut_.any():
                    a, d = anchor[take][cut_], j[cut_] * width
                    shard[cut_] = mix(Spans(v0, 0).of(a - d, a - d - width + 1 + length) ^ mix(d.astype(U))).view(np.int64)
                raw = data.tobytes()
                content = pa.array([raw[x:y] for x, y in zip(s[begin].tolist(), e[begin + many - 2 + length].tolist(), strict=True)], pa.binary())
                i32 = lambda x: pa.array(x.astype(np.int32))
                yield pa.RecordBatch.from_arrays([i64(shard), i64(b1[take]), i64(b2[take]), i64(weight[take]), i32(begin - l[take]), i32(many), i32(far), content], ["shard", "b1", "b2", "weight", "origin", "nwin", "back", "content"])

    return wide, run


CONTENTS = "shard long, b1 long, b2 long, weight long, origin int, nwin int, back int, content binary"


def repeats(docs: DataFrame, tokens: Callable, length: int, k: int, resolve: Callable, big_group: int, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``docs`` (any columns, ``text``) with its text's digest ``t1, t2``; the distinct texts; and for each text with repeats ``spans``.

    ``resolve`` gets what :func:`contents` returns and the number of distinct blocks, and returns ``b1, b2, runs``: pairs of first and end of the windows of a block that
    occur at least twice, by the sum of weights. Groups of one k-gram with more than ``big_group`` distinct blocks are cut
    into slices of ``width`` windows. ``spans`` is a list of (starts, runs). Null counts as empty text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.withColumns({"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit(7), text)})
    texts = cut(docs.groupBy("t1", "t2").agg(F.count("*").alias("copies"), F.first(text).alias("text")))
    every = cut(members(texts, tokens, length, k))
    weight = F.sum(F.col("copies") * F.size("starts"))
    again = every.groupBy("ah").agg(weight.alias("n")).where("n > 1").select("ah")
    mine = cut(every.join(again, "ah"))
    drop(every)
    kinds = mine.groupBy("b1", "b2").agg(F.first("ah").alias("ah"), weight.alias("weight"), *[F.first(c).alias(c) for c in ("nwin", "back", "t1", "t2")], F.first(F.col("starts")[0]).alias("start"))
    kinds = cut(kinds)
    n_kinds = kinds.count()
    big = kinds.groupBy("ah").agg(F.count("*").alias("n")).where(F.col("n") > big_group).select("ah", F.lit(True).alias("big"))
    kinds2 = kinds.join(big, "ah", "left").withColumn("big", F.coalesce("big", F.lit(False)))
    runs = cut(resolve(*contents(kinds2, texts, tokens, length, width), n_kinds))
    # The slices of a big group's block come back one by one.
    runs = runs.groupBy("b1", "b2").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    spans = mine.join(runs, ["b1", "b2"]).groupBy("t1", "t2").agg(F.collect_list(F.struct("starts", "runs")).alias("spans"))
    return docs, texts, spans


def covered(n: int, spans: list, length: int) -> np.ndarray:
    """Which of n tokens lie in a repeated window."""
    edge = np.zeros(n + 1, np.int32)
    for x in spans or ():
        starts, runs = np.asarray(x["starts"], np.int64), np.asarray(x["runs"], np.int64).reshape(-1, 2)
        lo = (starts[:, None] + runs[:, 0]).ravel()
        hi = (starts[:, None] + runs[:, 1]).ravel() - 1 + length
        np.add.at(edge, lo, 1)
        np.add.at(edge, hi, -1)
    return np.cumsum(edge[:-1]) > 0


def finish(texts: DataFrame, spans: DataFrame, length: int, by_word: bool, keep_text: bool) -> DataFrame:
    """``t1, t2, n, n_removed, n_spans, kept, kept_sha256`` of each distinct text; ``kept`` is null without ``keep_text``."""

    def run(batches):
        for batch in batches:
            out = []
            texts_, lists = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                raw = (texts_[i].as_py() or "").encode()
                parts = raw.split() if by_word else None  # splits at the six bytes of white space only
                n = len(parts) if by_word else len(raw)
                spans_ = lists[i].as_py()
                if spans_:
                    gone = covered(n, spans_, length)
                    removed, runs = int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                    kept = [parts[j] for j in np.flatnonzero(~gone)] if by_word else np.frombuffer(raw, np.uint8)[~gone].tobytes()
                else:
                    removed, runs, kept = 0, 0, parts if by_word else raw
                kept = b" ".join(kept) if by_word else kept
                out.append((n, removed, runs, kept if keep_text else None, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True))], ["t1", "t2", "n", "n_removed", "n_spans", "kept", "kept_sha256"])

    return texts.select("t1", "t2", "text").join(spans, ["t1", "t2"], "left").mapInArrow(run, "t1 long, t2 long, n long, n_removed long, n_spans long, kept binary, kept_sha256 string")
