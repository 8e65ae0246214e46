"""Near-duplicate documents by SetSketch registers.

A document is its set of distinct word shingles. Documents with equal sets form a class by a digest; one representative
of each goes on. A sketch has M registers, each the truncated, exponentially spaced minimum of a hash of the set
(``floor(1 - log_b x)`` of the smallest of exponentially distributed values, b close to 1), so sketches of parts of a
set merge by maximum. Runs of ROWS registers are band keys; documents that share a key are compared by the likelihood
of their registers given both set sizes, and what may reach the threshold is confirmed on the full sets.

All pairs of a bucket are never emitted: first each member is compared with the bucket's smallest one; members that
are linked are merged, and then only buckets that still hold several components are compared across them, in
blocks, where for each member and foreign component the likeliest partners are tried first until one is linked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.llm.arrays import ADD, LOWER, MULT, U, Spans, buffers, byte_spans, chunks, distinct_sorted, first_of, i64, mix, words
from velum.llm.graph import components
from velum.llm.shared import cut, drop

#: A pair at similarity 0.85 shares no band with probability (1 - 0.85**5)**26 = 2.4e-7.
BANDS, ROWS = 26, 5
M = BANDS * ROWS
#: SetSketch parameters: base, rate, largest register value.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
#: Pairs go to the exact check unless the likelihood's estimate is this far below the threshold (over five standard deviations of 130 registers).
SLACK = 0.17
BLOCK = 400
#: Stands for the id of rows without one: they come last.
NO_ID = (1 << 63) - 1


def shingles(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct k-word shingles of each text of a chunk, A-Z lower-cased, and their bounds. A text of fewer words is one shingle; one without words has none."""
    data = LOWER[data]
    s, e, doc = words(data, offs)
    nd = len(offs) - 1
    w = Spans(byte_spans(data).of(s, e), 1)
    first = first_of(doc, nd)
    many = np.diff(first)
    take = np.where(many >= k, many - k + 1, np.minimum(many, 1))
    bounds = np.concatenate([[0], np.cumsum(take)])
    at = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], take)
    h = w.of(at, at + np.repeat(np.minimum(many, k), take))
    return distinct_sorted(h, bounds)


def registers(h: np.ndarray, bounds: np.ndarray, m: int = M) -> np.ndarray:
    """The sketch of each nonempty set: one row of m registers."""
    lows = np.empty((m, len(bounds) - 1), np.uint64)
    for j in range(m):
        lows[j] = np.minimum.reduceat(h * MULT[j] + ADD[j], bounds[:-1])
    x = -np.log1p(-(lows.T.astype(np.float64) + 1) / 2.0**64 * (1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def likely(more: np.ndarray, less: np.ndarray, m: int, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs with sizes na and nb of which ``more`` registers are larger in the first, ``less`` in the second."""
    u = na / (na + nb)
    v = 1 - u
    step = lambda x: -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)

    def score(j):
        p, q = step(np.maximum(u - v * j, 1e-12)), step(np.maximum(v - u * j, 1e-12))
        return more * np.log(p) + less * np.log(q) + (m - more - less) * np.log(np.maximum(1 - p - q, 1e-12))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(26):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        right = score(a) < score(b)
        lo, hi = np.where(right, a, lo), np.where(right, hi, b)
    return (lo + hi) / 2


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, t, n, d1, d2, regs, bands`` of ``docs (doc_id, t, text)``: set size, digest of the set, registers, band keys (null for empty sets)."""

    def run(batches):
        for batch in batches:
            for rows, data, offs in chunks(batch):
                h, bounds = shingles(data, offs, k)
                n = np.diff(bounds)
                some = np.flatnonzero(n)
                sums = [np.zeros(len(n), np.uint64) for _ in range(2)]
                if len(some):
                    at = bounds[:-1][some]
                    regs = registers(h, np.concatenate([at, [len(h)]]))
                    sums[0][some] = np.add.reduceat(mix(h ^ U(0x5851F42D4C957F2D)), at)
                    sums[1][some] = np.add.reduceat(mix(h + U(0x14057B7EF767814F)), at)
                    keys = np.zeros((len(some), BANDS), np.uint64)
                    for b in range(BANDS):
                        for r in range(ROWS):
                            keys[:, b] = mix(keys[:, b] + regs[:, b * ROWS + r].astype(np.uint64) + MULT[b * ROWS + r])
                else:
                    regs, keys = np.zeros((0, M), np.uint16), np.zeros((0, BANDS), np.uint64)
                raw = np.full(len(n), None, object)
                raw[some] = [r.tobytes() for r in regs]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n > 0)]) * BANDS, pa.int32()), i64(keys.ravel()))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), i64(n), i64(sums[0]), i64(sums[1]), pa.array(raw, pa.binary()), lists], ["doc_id", "t", "n", "d1", "d2", "regs", "bands"])

    return docs.select("doc_id", "t", "text").mapInArrow(run, "doc_id long, t long, n long, d1 long, d2 long, regs binary, bands array<long>")


def _regs(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, M)


def estimated(pairs: DataFrame, reps: DataFrame, floor: float) -> DataFrame:
    """Of ``pairs (a, b)``, those whose estimate reaches ``floor``."""
    side = lambda x: reps.select(F.col("rid").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))

    def run(batches):
        for t in batches:
            if t.num_rows:
                a, b = _regs(t.column(4)), _regs(t.column(5))
                na, nb = (t.column(i).to_numpy().astype(float) for i in (2, 3))
                good = (np.minimum(na, nb) >= floor * np.maximum(na, nb)) & (likely((a > b).sum(1), (a < b).sum(1), M, na, nb) >= floor)
                yield pa.RecordBatch.from_arrays([t.column(0).filter(pa.array(good)), t.column(1).filter(pa.array(good))], ["a", "b"])

    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, texts_of: Callable[[DataFrame], DataFrame], k: int, percent: int) -> DataFrame:
    """Of ``pairs (a, b)``, those with ``100 * |A and B| >= percent * |A or B|`` on full sets; ``texts_of`` turns ``rid`` into ``rid, text``."""
    texts = cut(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct()))
    side = lambda x: texts.select(F.col("rid").alias(x), F.col("text").alias(f"t{x}"))

    def run(batches):
        for t in batches:
            at = 0
            size = np.diff(buffers(t.column(2))[1]) + np.diff(buffers(t.column(3))[1])
            while at < t.num_rows:
                to = max(at + 1, at + int(np.searchsorted(np.cumsum(size[at:]), 1 << 21)))
                part = t.slice(at, to - at)
                (ha, ba), (hb, bb) = (shingles(*buffers(part.column(i)), k) for i in (2, 3))
                pair = np.repeat(np.arange(part.num_rows), np.diff(ba)), np.repeat(np.arange(part.num_rows), np.diff(bb))
                x = np.concatenate([ha ^ mix(pair[0].astype(U)), hb ^ mix(pair[1].astype(U))])
                who = np.concatenate(pair)
                by = np.argsort(x, kind="stable")
                hit = by[1:][x[by][1:] == x[by][:-1]]
                both = np.bincount(who[hit], minlength=part.num_rows)
                good = pa.array(100 * both >= percent * (np.diff(ba) + np.diff(bb) - both))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(good), part.column(1).filter(good)], ["a", "b"])
                at = to

    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def set_table(texts: DataFrame, k: int) -> DataFrame:
    """``rid, set``: the sorted hashes of each text's shingles."""

    def run(batches):
        for batch in batches:
            for rows, data, offs in chunks(batch):
                h, bounds = shingles(data, offs, k)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([h[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["rid", "set"])

    return texts.select("rid", "text").mapInArrow(run, "rid long, set binary")


def across(members: DataFrame, floor: float, percent: int) -> DataFrame:
    """Links ``a, b`` between different labels within buckets, confirmed on full sets.

    ``members`` has ``key, blk, other, band, side, rid, label, n, regs, set``. A group (key, blk, other) holds a block's rows
    (side 0) and, if other > blk, another block's (side 1). A pair is compared only in the first band that it shares,
    its likeliest partners of a label first, and one link to each foreign label is enough, as it joins the components.
    """

    def linked(x: bytes, y: bytes) -> bool:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        if len(x) > len(y):
            x, y = y, x
        both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
        return 100 * both >= percent * (len(x) + len(y) - both)

    def compare(g: dict, lo: int, hi: int) -> Iterator[tuple[int, int]]:
        side, label, n, regs, band = (g[c][lo:hi] for c in ("side", "label", "n", "regs", "band"))
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1)
        alone = not len(right)
        if alone:
            right = left
        pairs = []
        for i in left:
            j = right[(label[right] != label[i]) & (np.minimum(n[right], n[i]) >= floor * np.maximum(n[right], n[i]))]
            if alone:
                j = j[j > i]
            if len(j):
                same = regs[j] == regs[i]
                j, same = (x[same.sum(1) >= (floor - 0.02) * M] for x in (j, same))
                b = int(band[i])
                if len(j) and b:  # met in an earlier band
                    j = j[~same.reshape(len(j), BANDS, ROWS)[:, :b].all(2).any(1)]
                if len(j):
                    pairs.append(np.stack([np.full(len(j), i), j]))
        if not pairs:
            return
        i, j = np.concatenate(pairs, 1)
        more, less = np.empty(len(i), np.int64), np.empty(len(i), np.int64)
        for a in range(0, len(i), 10_000):
            x, y = regs[i[a : a + 10_000]], regs[j[a : a + 10_000]]
            more[a : a + 10_000], less[a : a + 10_000] = (x > y).sum(1), (x < y).sum(1)
        est = likely(more, less, M, n[i].astype(float), n[j].astype(float))
        done = set()
        for q in np.lexsort((j, i, -est)):
            if est[q] < floor:
                break
            x, y = int(i[q]), int(j[q])
            if (x, label[y]) in done or (y, label[x]) in done:
                continue
            if linked(g["set"][lo + x], g["set"][lo + y]):
                done |= {(x, label[y]), (y, label[x])}
                yield int(g["rid"][lo + x]), int(g["rid"][lo + y])

    names = ("key", "blk", "other", "side", "rid", "label", "n", "band")

    def run(batches):
        rest: list[pa.RecordBatch] = []
        for batch in _groups(batches, rest):
            g = {c: batch.column(batch.schema.get_field_index(c)).to_numpy() for c in names}
            g["regs"] = _regs(batch.column(batch.schema.get_field_index("regs")))
            g["set"] = batch.column(batch.schema.get_field_index("set")).to_pylist()
            got = [x for a, b in zip(rest[0][:-1], rest[0][1:], strict=True) if b - a > 1 for x in compare(g, a, b)]
            a, b = zip(*got, strict=True) if got else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def _groups(batches, out):
        """Batches of whole groups; their bounds are put into ``out``."""
        held: list[pa.RecordBatch] = []
        source = iter(batches)
        while True:
            t = next(source, None)
            if t is not None:
                held.append(t)
            if not held:
                return
            x = pa.Table.from_batches(held).combine_chunks()
            whole = x.to_batches()[0] if x.num_rows else t
            new = np.zeros(max(whole.num_rows - 1, 0), bool)
            for c in ("key", "blk", "other"):
                v = whole.column(whole.schema.get_field_index(c)).to_numpy()
                new |= v[1:] != v[:-1]
            cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [whole.num_rows]])
            held = []
            if t is not None:  # the last group may go on
                held = [whole.slice(int(cuts[-2]))] if len(cuts) > 1 else []
                whole, cuts = whole.slice(0, int(cuts[-2])), cuts[:-1]
            if whole.num_rows:
                out[:] = [cuts.tolist()]
                yield whole
            if t is None:
                return

    cols = [*names, "regs", "set"]
    # A task's share of rows grows with no bucket: a group has at most two blocks.
    return members.select(*cols).repartition("key", "blk", "other").sortWithinPartitions("key", "blk", "other", "side", "rid").mapInArrow(run, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def mixed_buckets(keys: DataFrame, labels: DataFrame, reps: DataFrame) -> DataFrame:
    """Members of the buckets that hold several labels, dealt out in pairs of blocks of about BLOCK members."""
    named = keys.join(labels, "rid", "left").withColumn("label", F.coalesce("label", "rid"))
    mixed = named.groupBy("key").agg(F.count("*").alias("m"), F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 < l1").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")
    dealt = named.join(mixed, "key").withColumn("own", own).withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "band", F.least("own", "mate").alias("blk"), F.greatest("own", "mate").alias("other"), (F.col("own") > F.col("mate")).cast("int").alias("side"), "rid", "label")
    return dealt.join(reps.select("rid", "n", "regs"), "rid")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, leader, t`` for each row of ``docs (doc_id, text)``; ids are integers.

    Null and empty texts have the empty set and are linked with nothing. Rows of one id with different texts (told apart by
    the text's digest ``t``) are documents of their own; rows without an id are compared too, and a component of such rows only has
    a null ``component_id``. ``leader`` marks the rows of the component's smallest id and, of its texts, the smallest digest,
    and every row with the empty set. Repeated rows are returned as often as they come. Further columns are ignored.
    An empty table gives an empty table.
    """
    floor = percent / 100 - SLACK
    kind = docs.schema["doc_id"].dataType
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    sketches = cut(sketch(docs, k))
    place = F.coalesce(F.col("doc_id"), F.lit(NO_ID))
    reps = sketches.where("n > 0").groupBy("d1", "d2", "n").agg(F.min(F.struct(place.alias("lead"), "t", "regs", "bands")).alias("x"))
    # Written with its numbers, which so stay the same.
    reps = cut(reps.select("d1", "d2", "n", "x.lead", F.col("x.t").alias("lead_t"), "x.regs", "x.bands").withColumn("rid", F.monotonically_increasing_id()))
    keys = reps.select("rid", F.posexplode("bands").alias("band", "key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("m"), F.min("rid").alias("hub")).where("m > 1").select("key", "hub")
    keys = cut(keys.join(buckets, "key").select("key", "band", "rid", "hub"))

    def texts_of(rids: DataFrame) -> DataFrame:
        asked = reps.select("rid", "lead", "lead_t").join(rids, "rid")
        return docs.join(asked, (place == F.col("lead")) & (F.col("t") == F.col("lead_t"))).select("rid", "text")

    star = keys.where("rid > hub").select(F.col("hub").alias("a"), F.col("rid").alias("b")).distinct()
    likely_ = cut(estimated(star, reps, floor))
    edges = cut(confirmed(likely_, texts_of, k, percent))
    labels = cut(components(edges).withColumnRenamed("node", "rid"))
    members = cut(mixed_buckets(keys, labels, reps))
    drop(keys, likely_, labels)
    sets = set_table(texts_of(members.select("rid").distinct()), k).dropDuplicates(["rid", "set"])
    labels = cut(components(edges.union(across(members.join(sets, "rid"), floor, percent))).withColumnRenamed("node", "rid"))
    drop(members, edges)
    classes = reps.select("d1", "d2", "n", "rid", "lead", "lead_t").join(labels, "rid", "left").withColumn("label", F.coalesce("label", "rid"))
    first = classes.groupBy("label").agg(F.min(F.struct("lead", "lead_t")).alias("first"))
    classes = classes.join(first, "label").select(F.col("d1").alias("c1"), F.col("d2").alias("c2"), F.col("n").alias("cn"), "first")
    out = sketches.join(classes, (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")) & (F.col("n") == F.col("cn")), "left")
    component = F.when(F.col("first").isNull(), F.col("doc_id")).when(F.col("first.lead") < NO_ID, F.col("first.lead"))
    leader = F.col("first").isNull() | ((place == F.col("first.lead")) & (F.col("t") == F.col("first.lead_t")))
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("n").alias("n_shingles"), component.cast(kind).alias("component_id"), leader.alias("leader"), "t")


def query(documents: DataFrame) -> DataFrame:
    found = near_duplicates(documents, k=3, percent=85)
    # A row without an id stays unless its component has one.
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
