"""Quality scores by voting of the nearest labelled documents in a latent-semantic space.

Documents become hashed counts of byte trigrams (letter case told apart), damped, weighted by inverse document
frequency, with a block of shares such as repeated words, capitals and marks. A truncated SVD of a bounded sample of labelled
documents gives the latent space; the sample's vectors are broadcast, every document is compared with all of them in
blocks of exact cosine products, and its nearest ones vote with their similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.llm.arrays import SPACE, U, chunks, mix
from velum.llm.perplexity import measures

#: Labelled documents of each label that the model is fitted on, those with the smallest hashes of their ids.
PER_LABEL = 2_000
BUCKETS = 2_048
DIMENSIONS = 64
NEIGHBOURS = 25
SHARPNESS = 4.0
SHARE_WEIGHT = 2.5
THRESHOLD = 0.3


def _kinds() -> np.ndarray:
    """Byte kinds of which the shares count: 0 other, 1 space, 2 lower, 3 upper, 4 digit, 5 common mark, 6 other mark, 7 line end."""
    out = np.zeros(256, np.int64)
    out[SPACE] = 1
    out[10] = 7
    out[97:123], out[65:91], out[48:58] = 2, 3, 4
    out[33:48] = out[58:65] = out[91:97] = out[123:127] = 6
    out[list(b".,;:'\"()-?")] = 5
    return out


KIND = _kinds()


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Damped trigram counts (documents x BUCKETS) and shares of each text of a chunk."""
    nd, n = len(offs) - 1, len(data)
    doc = np.repeat(np.arange(nd), np.diff(offs))
    counts = np.zeros(nd * BUCKETS)
    if n > 2:
        g = data[:-2].astype(U) | data[1:-1].astype(U) << U(8) | data[2:].astype(U) << U(16)
        inside = doc[:-2] == doc[2:]
        bucket = (mix(g + U(0x9E3779B97F4A7C15)) >> U(40)).astype(np.int64) % BUCKETS
        counts = np.bincount((doc[:-2] * BUCKETS + bucket)[inside], minlength=nd * BUCKETS)
    kinds = np.bincount(doc * 8 + KIND[data], minlength=nd * 8).reshape(nd, 8)
    m = measures(data, offs)
    some = np.maximum(np.diff(offs), 1)[:, None]
    n_words = np.maximum(m["n_words"], 1)
    upper = kinds[:, 3] / np.maximum(kinds[:, 2] + kinds[:, 3], 1)
    shares = np.column_stack([
        np.sqrt(kinds[:, [4, 5, 6, 7]] / some), upper, np.sqrt(m["n_symbols"] / some[:, 0]), m["n_repeat_words"] / n_words,
        m["n_dup_lines"] / np.maximum(kinds[:, 7] + 1, 1), np.minimum(m["word_chars"] / n_words / 20, 1), np.log1p(m["n_words"]) / 12,
    ])
    return np.log1p(counts.reshape(nd, BUCKETS)).astype(np.float32), shares.astype(np.float32)


class Space:
    """The latent space of a sample: weights, centre and directions, and the sample's unit vectors with their labels."""

    def __init__(self, counts: np.ndarray, shares: np.ndarray, labels: np.ndarray, prior: float, dimensions: int = DIMENSIONS):
        n = len(counts)
        self.idf = np.log((1 + n) / (1 + (counts > 0).sum(0))).astype(np.float32) + 0.1
        self.low, self.spread = shares.mean(0), shares.std(0) + 1e-3
        x = self._rows(counts, shares)
        self.centre = x.mean(0)
        x = x - self.centre
        # Randomised range finder with power steps; the seed is fixed, so reruns agree.
        q = np.random.default_rng(7).standard_normal((x.shape[1], dimensions + 16)).astype(np.float32)
        for _ in range(4):
            q, _ = np.linalg.qr(x.T @ (x @ q))
        _, _, v = np.linalg.svd(x @ q, full_matrices=False)
        self.axes = (q @ v[:dimensions].T).astype(np.float32)
        self.vectors, self.labels = self._unit(x @ self.axes), labels.astype(np.float32)
        # Votes count as if the labels came in their true shares.
        ones = max(float(labels.mean()), 1e-9) if n else 1.0
        self.weight = np.where(labels > 0, prior / ones, (1 - prior) / max(1 - ones, 1e-9)).astype(np.float32)
        self.prior = prior

    def _rows(self, counts, shares):
        x = counts * self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        return np.hstack([x, SHARE_WEIGHT / np.sqrt(shares.shape[1]) * np.tanh((shares - self.low) / self.spread / 2)]).astype(np.float32)

    @staticmethod
    def _unit(x):
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray, shares: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """Weighted share of label 1 among the k nearest of the sample; the prior where there is none."""
        if not len(self.vectors):
            return np.full(len(counts), self.prior)
        z = self._unit((self._rows(counts, shares) - self.centre) @ self.axes)
        out = np.empty(len(z))
        k = min(k, len(self.vectors))
        for a in range(0, len(z), 256):
            sim = z[a : a + 256] @ self.vectors.T
            near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            s = np.take_along_axis(sim, near, 1)
            w = (np.maximum(s, 0) ** SHARPNESS + 1e-9) * self.weight[near]
            out[a : a + 256] = (w * self.labels[near]).sum(1) / w.sum(1)
        return np.clip(out, 0, 1)


def held_out(doc_id) -> object:
    """crc32 of the id as text, modulo 5, is 0; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Space:
    """Fits on at most ``per_label`` documents of each quality label that aren't held out. Null labels and texts are left out; of rows of one id the smallest text is taken, and an id with both labels stands for both."""
    known = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", (F.col("quality") > 0).cast("int").alias("quality"))
    shares = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    picked = None
    for q in (0, 1):
        part = known.where(F.col("quality") == q).distinct().orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fit")), "doc_id").limit(per_label)
        picked = part if picked is None else picked.unionByName(part)
    # At most 2 * per_label ids; of rows of one id the smallest text, so that reruns agree.
    sample = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(picked.distinct()), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def run(batches):
        for batch in batches:
            for rows, data, offs in chunks(batch):
                c, s = features(data, offs)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array([x.astype(np.float16).tobytes() for x in c], pa.binary()), pa.array([x.tobytes() for x in s], pa.binary())], ["doc_id", "quality", "counts", "shares"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sample.select("doc_id", "text", "quality").mapInArrow(run, f"doc_id {kind}, quality int, counts binary, shares binary").toPandas()
    got = got.sort_values(["doc_id", "quality"], kind="stable")
    matrix = lambda c, t: np.frombuffer(b"".join(got[c]), t).reshape(len(got), -1).astype(np.float32) if len(got) else np.zeros((0, BUCKETS if c == "counts" else 10), np.float32)
    total = sum(shares.values())
    prior = shares.get(1, 0) / total if total else 0.5
    if not len(got):
        return _empty(prior)
    return Space(matrix("counts", np.float16), matrix("shares", np.float32), got["quality"].to_numpy(), prior)


def _empty(prior: float) -> Space:
    out = Space.__new__(Space)
    out.vectors, out.prior = np.zeros((0, DIMENSIONS), np.float32), prior
    return out


def score(docs: DataFrame, space: Space) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs (doc_id, text)``.

    Null and empty texts have zero counts and are scored like any other by their nearest labelled documents. Repeated
    rows get equal scores up to rounding. Further columns are ignored, so clashing names do no harm. Without labels
    every score is 0.5. An empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches):
        for batch in batches:
            for rows, data, offs in chunks(batch):
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(shared.value.score(*features(data, offs)).astype(np.float64))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    docs = documents.select("doc_id", "text")
    return score(docs, fit(docs, labels))
