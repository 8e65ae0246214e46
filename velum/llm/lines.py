"""Line deduplication by a deletion-neighbourhood join.

Lines are compared as sequences of words. A line goes if an earlier one (by doc_id, then line number) is equal or, for lines of
at least NEAR_WORDS words, within one inserted, deleted or replaced word. Lines of fewer than MIN_WORDS words stay.

Equal lines are brought together by a hash first. Two lines within one edit agree in their first or in their
second half (for the shorter one's length), so only distinct lines that share a half with another one go on: each emits
the hashes of all its variants with up to one word left out. Lines with an equal variant, left out at the same place, or
one of them being the variant itself, are within the bound. Each line is only paired with the earliest of such a
group, which decides as well as all pairs would, and the edit distance of the pair is verified on the words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.llm.arrays import Spans, U, byte_spans, chunks, first_of, i64, mix, words
from velum.llm.shared import cut, drop

MIN_WORDS = 5
NEAR_WORDS = 10
#: What the registered query and the pipeline ask for: every line with a word, and near ones where one edit is at most a fifth of the line.
SHORTEST, NEAR_SHORTEST = 1, 5


def line_table(docs: DataFrame, min_words: int) -> DataFrame:
    """``doc_id, t, line, h1, h2, n, halves`` of each line of ``docs (doc_id, t, text)``: those of at least ``min_words`` words: its number, its digest, its number of words and the hashes of its halves."""

    def run(batches):
        for batch in batches:
            for rows, data, offs in chunks(batch):
                s, e, doc = words(data, offs)
                if not len(s):
                    continue
                v0, v1 = byte_spans(data, 0).of(s, e), byte_spans(data, 1).of(s, e)
                breaks = np.concatenate([[0], np.cumsum(data == 10)])
                line = breaks[s] - breaks[offs[doc]]
                new = np.ones(len(s), bool)
                new[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
                a = np.flatnonzero(new)
                b = np.concatenate([a[1:], [len(s)]])
                long = b - a >= min_words
                a, b = a[long], b[long]
                n = b - a
                s0, s1 = Spans(v0, 0), Spans(v1, 1)
                halves = np.zeros((len(a), 4), np.uint64)
                for j, base in enumerate((n, n - 1)):
                    h = base // 2
                    tag = mix(base.astype(U) * U(2))
                    halves[:, 2 * j] = mix(s0.of(a, a + h) ^ tag)
                    halves[:, 2 * j + 1] = mix(s0.of(b - (base - h), b) ^ tag ^ U(1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * 4), i64(halves.ravel()))
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(doc[a])), rows.column(1).take(pa.array(doc[a])), pa.array(line[a].astype(np.int32)), i64(s0.of(a, b)), i64(s1.of(a, b)), pa.array(n.astype(np.int32)), lists], ["doc_id", "t", "line", "h1", "h2", "n", "halves"])

    return docs.select("doc_id", "t", "text").mapInArrow(run, "doc_id long, t long, line int, h1 long, h2 long, n int, halves array<long>")


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc, t, line, early, late, words`` for ``wanted (doc, t, line, early, late)``: the words of these lines, joined by a space."""
    per_doc = wanted.groupBy("doc", "t").agg(F.collect_list(F.struct("line", "early", "late")).alias("lines"))

    def run(batches):
        for batch in batches:
            out = []
            for doc, t, text, lines in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = text.encode().split(b"\n")
                for x in lines:
                    out.append((doc, t, x["line"], x["early"], x["late"], b" ".join(parts[x["line"]].split()).decode()))
            if not out:
                continue
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.string()), strict=True)], ["doc", "t", "line", "early", "late", "words"])

    lines = docs.select(F.col("doc_id").alias("doc"), "t", "text").join(per_doc, ["doc", "t"])
    return lines.mapInArrow(run, "doc long, t long, line int, early boolean, late boolean, words string").dropDuplicates(["doc", "t", "line"])


def variants(lines: DataFrame) -> DataFrame:
    """``v, place, doc, t, line``: hashes of each line (place -1) and of it without the word at each place; ``early`` asks for places in the first half, ``late`` for those in the second."""

    def run(batches):
        for batch in batches:
            for rows, data, offs in chunks(batch, "words", 1 << 19):
                s, e, at = words(data, offs)
                bounds = first_of(at, rows.num_rows)
                spans = Spans(byte_spans(data, 0).of(s, e), 0)
                a, b = bounds[at], bounds[at + 1]
                i = np.arange(len(s))
                half = (b - a) // 2 + 1
                early, late = (rows.column(c).to_numpy(zero_copy_only=False)[at] for c in (3, 4))
                use = early & (i - a <= half) | late & (i - a >= half - 2)
                i, a, b, own = i[use], a[use], b[use], at[use]
                p, inv = spans.sums, spans.inv
                v = mix(((p[i] - p[a]) + (p[b] - p[i + 1]) * inv[1]) * inv[a] + (b - a - 1).astype(U) * U(0xA24BAED4963EE407))
                full = spans.of(bounds[:-1], bounds[1:])
                own = np.concatenate([own, np.arange(rows.num_rows)])
                place = np.concatenate([i - a, np.full(rows.num_rows, -1)]).astype(np.int32)
                take = pa.array(own)
                yield pa.RecordBatch.from_arrays([i64(np.concatenate([v, full])), pa.array(place), *(rows.column(c).take(take) for c in range(3))], ["v", "place", "doc", "t", "line"])

    return lines.select("doc", "t", "line", "early", "late", "words").mapInArrow(run, "v long, place int, doc long, t long, line int")


def within_one(a: list, b: list) -> bool:
    """Whether one inserted, deleted or replaced word turns a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return max(len(a), len(b)) - i - j <= 1


def near_lines(docs: DataFrame, distinct: DataFrame, near_words: int) -> DataFrame:
    """``doc, t, line`` of the first places of those ``distinct`` lines that have an earlier line within one edit."""
    some = distinct.where(F.col("n") >= near_words)
    halves = some.select("doc", "t", "line", F.posexplode("halves").alias("j", "half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("m")).where("m > 1").select("half")
    asked = halves.join(shared, "half").groupBy("doc", "t", "line").agg(F.max(F.col("j") % 2 == 1).alias("early"), F.max(F.col("j") % 2 == 0).alias("late"))
    lines = cut(line_texts(docs, asked))
    every = cut(variants(lines))
    often = every.groupBy("v").agg(F.count("*").alias("m")).where("m > 1").select("v")
    kin = cut(every.join(often, "v"))
    drop(every)
    first = F.min(F.struct("doc", "t", "line")).alias("p")
    groups = [
        (kin.where("place >= 0"), ["v", "place"], kin.where("place >= 0").groupBy("v", "place").agg(first)),
        (kin.where("place >= 0"), ["v"], kin.where("place = -1").groupBy("v").agg(first)),
        (kin.where("place = -1"), ["v"], kin.where("place >= 0").groupBy("v").agg(first)),
    ]
    pairs = None
    for rows, on, earliest in groups:
        own = rows.join(earliest, on).where(F.col("p") < F.struct("doc", "t", "line")).select("doc", "t", "line", F.col("p.doc").alias("pdoc"), F.col("p.t").alias("pt"), F.col("p.line").alias("pline"))
        pairs = own if pairs is None else pairs.union(own)
    other = lines.select(F.col("doc").alias("pdoc"), F.col("t").alias("pt"), F.col("line").alias("pline"), F.col("words").alias("pwords"))

    def run(batches):
        for t in batches:
            good = pa.array([within_one(a.split(" "), b.split(" ")) for a, b in zip(t.column(3).to_pylist(), t.column(4).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column(c).filter(good) for c in range(3)], ["doc", "t", "line"])

    pairs = pairs.distinct().join(lines.select("doc", "t", "line", "words"), ["doc", "t", "line"]).join(other, ["pdoc", "pt", "pline"])
    return pairs.select("doc", "t", "line", "words", "pwords").mapInArrow(run, "doc long, t long, line int").distinct()


def deduplicate(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS, *, keep_text: bool = True) -> DataFrame:
    """``docs`` with its kept lines as ``text``, plus ``n_lines, n_removed, kept_sha256``; integer ids.

    Lines end at \\n; their order and white space stay. Null texts stay null and count one line, as empty ones do.
    Rows without an id are returned as they are and not compared. Repeated rows are one document and keep the same lines;
    rows of one id with different texts are documents of their own, in the order of their texts' digests. Columns of ``docs`` with the names of the new ones are replaced. An empty table gives an empty table.
    Without ``keep_text`` only doc_id and the new columns are returned.
    """
    new = ["n_lines", "n_removed", "kept_sha256"]
    docs = docs.drop(*new, "__gone", "__t")
    text_key = F.xxhash64("text")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key.alias("t"), "text").where("doc_id is not null and text is not null")
    lines = cut(line_table(plain, min_words))
    first = F.min(F.struct(F.col("doc_id").alias("doc"), "t", "line")).alias("p")
    distinct = cut(lines.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.first("n").alias("n"), F.first("halves").alias("halves"), first).select("h1", "h2", "copies", "n", "halves", "p.doc", "p.t", "p.line"))
    near = cut(near_lines(plain, distinct, near_words))
    judged = distinct.select("h1", "h2", "copies", "doc", "t", "line").join(near.withColumn("near", F.lit(True)), ["doc", "t", "line"], "left").where("copies > 1 or near")
    judged = judged.select("h1", "h2", "doc", F.col("t").alias("first_t"), F.col("line").alias("first_line"), F.coalesce("near", F.lit(False)).alias("near"))
    gone = lines.select("doc_id", "t", "line", "h1", "h2").join(judged, ["h1", "h2"]).where("near or doc_id <> doc or t <> first_t or line <> first_line")
    gone = gone.groupBy(F.col("doc_id").alias("__doc"), F.col("t").alias("__t")).agg(F.collect_set("line").alias("__gone"))
    keyed = docs.join(gone, (docs["doc_id"].cast("long") == gone["__doc"]) & (text_key == gone["__t"]), "left").drop("__doc", "__t")
    out = docs.columns if keep_text else ["doc_id"]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches):
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            texts, n, removed, digest = [], [], [], []
            for text, lost in zip(get("text").to_pylist(), get("__gone").to_pylist(), strict=True):
                parts = (text or "").split("\n")
                n.append(len(parts))
                if lost:
                    lost = set(lost)
                    parts = [x for i, x in enumerate(parts) if i not in lost]
                removed.append(n[-1] - len(parts))
                kept = "\n".join(parts)
                digest.append(hashlib.sha256(kept.encode()).hexdigest())
                texts.append(None if text is None else kept)
            cols = [pa.array(texts, pa.string()) if c == "text" else get(c) for c in out]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], [*out, *new])

    return keyed.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in out] + ["n_lines long", "n_removed long", "kept_sha256 string"]))


def query(documents: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    return deduplicate(documents.select("doc_id", "text"), min_words, near_words, keep_text=False)
