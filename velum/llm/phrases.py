"""Collocations: phrases of two to five words that occur more often than their parts would by chance, per language (null: ``und``).

1. Words are counted, then pairs of frequent words, then triples of two frequent pairs, by 40 bits of their hash. A shard's counts
   travel as one row a bucket (the upper 16 bits). What is frequent sets a bit of its hash in one bitmap of a fixed size
   (:data:`BITS`). A phrase can't be more frequent than what it holds, so what the bitmap leaves out is in no candidate; bits
   that hashes share only let more through.
2. Every shard (a few million words of a task) makes a count trie of at most five words' depth over what is left: a level is
   the sorted distinct pairs of a node of the level before and a next word. The tries are serialised sorted, in rows of some
   hundred nodes, and cut at the bounds of at most :data:`RANGES` ranges of whole paths, taken from a sample of the rows. The
   runs of a range are merged and equal paths added up. A range may begin anywhere in a subtree, so neither a frequent word
   nor a frequent prefix lands in one task.

In the merged order a walk down the trie knows the counts of the left parts of every phrase (those of ancestors that stand
in the range before are looked up); the right parts are the phrase's suffix links, looked up by a join with the frequent
phrases. Counts are 64-bit, products decimals of 38 digits.

Null and empty texts have no words. Repeated rows count as often as they come. Texts of any length are read whole, in pieces of
whole rows. Ties are broken by the phrase's bytes. Other columns than ``text`` and ``lang`` are not read. An empty table
gives an empty one. What the tries count is told apart by its bytes.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velum.llm.arrays import LOWER, U, byte_spans, chunks, mix, split
from velum.llm.shared import cut

MOST_WORDS = 5
#: A phrase is a candidate from this count on, goes if a longer one around it has PERCENT % of its count, and TOP of each language are listed.
LEAST, PERCENT, TOP = 100, 100, 2000
#: Words of a shard, which a task holds at once (about 100 bytes each).
SHARD_WORDS = 2_000_000
#: Bits of a bitmap, as a power of two: 32 MB.
BITS = 28
#: Nodes of a row, ranges of paths at most, and nodes of a range that are held before equal ones are added up.
ROW_NODES, RANGES, HELD = 512, 1024, 2_000_000
#: Parts in which a language's ranking begins.
SALTS = 64

PIECE = np.zeros(256, bool)
PIECE[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
GAP = PIECE.copy()
GAP[[0x20, 9]] = True


def words(batch: pa.RecordBatch):
    """For slices of a batch: bytes in lower case, begins and ends of words, their keys (hashes with the language's), rows, and whether a word begins a piece."""
    for rows, data, offs in chunks(batch):
        low = LOWER[data]
        s, e, row = split(low, offs, GAP)
        if not len(s):
            continue
        lang = rows.column(rows.schema.get_field_index("__lang")).to_numpy().view(U)
        keys = mix(byte_spans(low).of(s, e) ^ lang[row])
        piece = np.cumsum(PIECE[low])[s]
        begins = np.ones(len(s), bool)
        begins[1:] = (row[1:] != row[:-1]) | (piece[1:] != piece[:-1])
        yield rows, low, s, e, keys, row, begins


def pairs(keys: np.ndarray) -> np.ndarray:
    return mix(keys[:-1] * U(0x9E3779B97F4A7C15) + keys[1:])


def has(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return (bitmap[(keys >> U(6) & U((1 << BITS - 6) - 1)).astype(np.int64)] >> (keys & U(63)) & U(1)) == 1


def links(keys: np.ndarray, begins: np.ndarray, bitmap: np.ndarray, level: int) -> tuple[np.ndarray, ...]:
    """Which words are frequent (level 1), begin a frequent pair in their piece (2) and begin a frequent triple (3), and the hashes of the next level."""
    ok = has(bitmap, keys)
    two = ok.copy()
    two[-1] = False
    two[:-1] &= ok[1:] & ~begins[1:]
    of_two = np.append(pairs(keys), U(0))
    if level == 1:
        return ok, two, of_two
    two &= has(bitmap, of_two)
    three = two.copy()
    three[-1] = False
    three[:-1] &= two[1:]
    of_three = np.zeros(len(keys), U)
    of_three[:-2] = mix(of_two[:-2] * U(0xD1342543DE82EF95) + keys[2:])
    if level == 2:
        return ok, two, three, of_three
    return ok, two, three & has(bitmap, of_three)


#: Lower bits of a hash within its bucket.
LOW = 24


def tally(docs: DataFrame, bitmap=None, level: int = 0) -> tuple[DataFrame, DataFrame]:
    """Counts ``h, n`` of 40 bits of the hashes of words (``level`` 0), or of what is one word longer than the frequent things of ``level``; for words also ``lang, n`` of all words."""
    kept, names = U((1 << 16 + LOW) - 1), ["lang", "total", "bucket", "low", "n"]

    def run(batches):
        held, size, totals = [], 0, {}
        for b in batches:
            for rows, _, _, _, keys, row, begins in words(b):
                if level:
                    *_, next_ones, keys = links(keys, begins, bitmap.value, level)
                    keys = keys[next_ones]
                else:
                    for lang, n in zip(rows.column(rows.schema.get_field_index("lang")).to_pylist(), np.bincount(row, minlength=rows.num_rows).tolist(), strict=True):
                        totals[lang] = totals.get(lang, 0) + n
                held.append(keys & kept)
                size += len(keys)
                if size > SHARD_WORDS:
                    yield from flush(held)
                    held, size = [], 0
        yield from flush(held)
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64()), *(pa.nulls(len(totals), k) for k in (pa.int32(), pa.binary(), pa.binary()))], names)

    def flush(held):
        h, n = np.unique(np.concatenate(held), return_counts=True) if held else ([], [])
        if not len(h):
            return
        bucket = (h >> U(LOW)).astype(np.int32)
        at = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(h))
        low = np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :3])
        cells = [pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * wide).astype(np.int32)), pa.py_buffer(x)]) for x, wide in ((low, 3), (n.astype(np.uint32), 4))]
        whole = pa.RecordBatch.from_arrays([pa.nulls(len(at) - 1, pa.string()), pa.nulls(len(at) - 1, pa.int64()), pa.array(bucket[at[:-1]]), *cells], names)
        for a in range(0, whole.num_rows, 10_000):
            yield whole.slice(a, 10_000)

    def join(batches):
        held, last, size = [], None, 0
        for b in batches:
            h, n, bucket = unpack(b)
            held.append((h, n))
            size += len(h)
            if b.num_rows and (last is None or bucket[-1] != last or size > SHARD_WORDS):
                h, n = added(held)
                mine = h >> U(LOW) == U(bucket[-1])  # its other rows may come in the next batch
                yield out(h[~mine], n[~mine])
                held, last, size = [(h[mine], n[mine])], bucket[-1], 0
        if held:
            yield out(*added(held))

    def unpack(b):
        bucket, lows, ns = b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(2).to_pylist()
        h = np.zeros((sum(map(len, lows)) // 3, 8), np.uint8)
        h[:, :3] = np.frombuffer(b"".join(lows), np.uint8).reshape(-1, 3)
        many = np.fromiter(map(len, lows), np.int64, len(lows)) // 3
        return h.view(U).ravel() | np.repeat(bucket.astype(U), many) << U(LOW), np.frombuffer(b"".join(ns), np.uint32).astype(np.int64), bucket

    def added(held):
        h, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        return h, np.bincount(at, np.concatenate([x for _, x in held]), len(h)).astype(np.int64)

    def out(h, n):
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    found = docs.mapInArrow(run, "lang string, total long, bucket int, low binary, n binary")
    found = found if level else cut(found)  # read twice
    counts = found.where("bucket is not null").select("bucket", "low", "n").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(join, "h long, n long")
    return counts, found.where("lang is not null").groupBy("lang").agg(F.sum("total").alias("n"))


def marked(counts: DataFrame, least: int, before=None):
    """The broadcast bits of the hashes counted ``least`` times, added to those of ``before``; Spark joins equal words of the bitmap, of which there are 2**22 at most."""
    at = counts.where(F.col("n") >= least).select(F.col("h").bitwiseAND((1 << BITS) - 1).alias("p"))
    got = at.groupBy(F.shiftright("p", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << BITS - 6, U) if before is None else before.value.copy()
    out[got["word"].to_numpy()] |= got["bits"].to_numpy().view(U)
    return counts.sparkSession.sparkContext.broadcast(out)


def trie(ids: np.ndarray, two: np.ndarray, three: np.ndarray, n_words: int, depth: int):
    """Levels of the count trie over a sequence of word ids: parents (positions in the level before), words and counts, sorted by path.

    ``two`` and ``three`` say which positions begin a frequent pair and a frequent triple.
    """
    node, at = ids, np.arange(len(ids))
    yield None, np.arange(n_words), np.bincount(ids, minlength=n_words)
    for d in range(1, depth):
        goes = two[at + d - 1]
        if d > 1:
            goes = goes & three[at + d - 2]
        node, at = node[goes], at[goes]
        found, node, n = np.unique(node * n_words + ids[at + d], return_inverse=True, return_counts=True)
        if not len(found):
            return
        yield found // n_words, found % n_words, n


def tries(docs: DataFrame, bitmap, depth: int) -> DataFrame:
    """The nodes of all shards' tries, sorted, in rows of lists ``lang, phrase, n``."""

    def run(batches):
        names, held, size = {}, [], 0
        for b in batches:
            for rows, low, s, e, keys, row, begins in words(b):
                ok, two, three = links(keys, begins, bitmap.value, 3)
                found, first = np.unique(keys[ok], return_index=True)
                raw, lang, own = low.tobytes(), rows.column(rows.schema.get_field_index("lang")), np.flatnonzero(ok)
                for k, i in zip(found.tolist(), own[first].tolist(), strict=True):
                    if k not in names:
                        names[k] = (lang[int(row[i])].as_py(), raw[s[i] : e[i]].decode("utf-8", "replace"))
                held.append((keys[ok], two[ok], three[ok]))
                size += len(own)
                if size > SHARD_WORDS:
                    yield from flush(names, held)
                    names, held, size = {}, [], 0
        if held:
            yield from flush(names, held)

    def flush(names, held):
        if not names:
            return
        known = np.asarray(sorted(names, key=names.__getitem__), np.uint64)
        by = np.argsort(known)
        keys, two, three = (np.concatenate([x[c] for x in held]) for c in range(3))
        ids = by[np.searchsorted(known[by], keys)]
        lang, word = (pa.array([names[k][c] for k in known.tolist()], pa.string()) for c in (0, 1))
        levels, above = [], None
        for parent, last, n in trie(ids, two, three, len(known), depth):
            if parent is None:
                phrase, own = word, lang
            else:
                p = pa.array(parent)
                phrase, own = pc.binary_join_element_wise(above[0].take(p), word.take(pa.array(last)), " "), above[1].take(p)
            above = (phrase, own)
            levels.append(pa.Table.from_arrays([own, phrase, pa.array(n.astype(np.int64))], NODE))
        yield rows_of(in_order(pa.concat_tables(levels)), None)

    return docs.mapInArrow(run, LISTS)


NODE = ["lang", "phrase", "n"]
LISTS = "lang array<string>, phrase array<string>, n array<long>"


def in_order(nodes: pa.Table) -> pa.Table:
    return nodes.sort_by([("lang", "ascending"), ("phrase", "ascending")]).combine_chunks()


def rows_of(nodes: pa.Table, edges: np.ndarray | None) -> pa.RecordBatch:
    """Sorted nodes as rows of lists, cut at ``edges`` or after every :data:`ROW_NODES`."""
    if edges is None:
        edges = np.append(np.arange(0, nodes.num_rows, ROW_NODES), nodes.num_rows)
    edges = pa.array(edges.astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(edges, nodes[c].combine_chunks()) for c in NODE], NODE)


def flat(batch: pa.RecordBatch) -> pa.Table:
    return pa.Table.from_arrays([batch.column(batch.schema.get_field_index(c)).flatten() for c in NODE], NODE)


def dealt(rows: DataFrame) -> DataFrame:
    """Rows cut at the bounds of ranges of paths: ``part`` and lists."""
    many = rows.count()
    parts = max(1, min(RANGES, many // 8))
    first = rows.select(F.col("lang")[0].alias("lang"), F.col("phrase")[0].alias("phrase"))
    firsts = sorted(tuple(r) for r in first.sample(min(1.0, 20 * parts / max(many, 1)), seed=7).collect())  # some 20,000 at most
    bounds = sorted({firsts[len(firsts) * i // parts] for i in range(1, parts)}) if firsts else []

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                t = flat(b.slice(i, 1))
                keys = list(zip(t["lang"].to_pylist(), t["phrase"].to_pylist(), strict=True))
                low, high = bisect_right(bounds, keys[0]), bisect_right(bounds, keys[-1])
                edges = np.asarray([0, *(bisect_left(keys, bounds[k]) for k in range(low, high)), len(keys)])
                cut_up = rows_of(t, edges)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, high + 1), pa.int32()), *cut_up.columns], ["part", *NODE])

    return rows.mapInArrow(run, f"part int, {LISTS}").repartition(parts, "part").sortWithinPartitions("part")


def merge(runs: DataFrame, least: int) -> DataFrame:
    """Frequent phrases ``lang, phrase, size, a, lefts`` of the runs of each range: equal paths added, counts of ancestors from the walk (0: not in this range)."""

    def run(batches):
        held, part, size = [], None, 0
        for b in batches:
            parts = b.column(0).to_numpy()
            for a, z in zip(*(x.tolist() for x in stretches(parts)), strict=True):
                if part is not None and parts[a] != part:
                    yield from walk(added(held))
                    held, size = [], 0
                part = parts[a]
                held.append(flat(b.slice(a, z - a)))
                size += held[-1].num_rows
                if size > HELD:
                    held = [added(held)]
                    size = held[0].num_rows // 2
        if held:
            yield from walk(added(held))

    def stretches(parts):
        new = np.flatnonzero(np.append(True, parts[1:] != parts[:-1])) if len(parts) else np.zeros(0, np.int64)
        return new, np.append(new[1:], len(parts)) if len(new) else new

    def added(held):
        t = in_order(pa.concat_tables(held))
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for c in NODE[:2]:
            x = t[c].combine_chunks()
            new[1:] |= pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(new)
        n = np.add.reduceat(t["n"].to_numpy(), at) if len(at) else at
        return pa.Table.from_arrays([*(t[c].take(pa.array(at)) for c in NODE[:2]), pa.array(n)], NODE)

    def walk(t):
        rows, path = [], []
        t = t.filter(pc.greater_equal(t["n"], least))
        for lang, phrase, n in zip(*(t[c].to_pylist() for c in NODE), strict=True):
            while path and not (path[-1][0] == lang and phrase.startswith(path[-1][1] + " ")):
                path.pop()
            size = phrase.count(" ") + 1
            lefts = [0] * (size - 1)
            for _, _, many, count in path:
                lefts[many - 1] = count
            path.append((lang, phrase, size, n))
            rows.append((lang, phrase, size, n, lefts))
        if rows:
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["lang", "phrase", "size", "a", "lefts"])

    return runs.mapInArrow(run, "lang string, phrase string, size int, a long, lefts array<long>")


def frequent_phrases(docs: DataFrame, least: int = LEAST, depth: int = MOST_WORDS) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to ``depth`` words with ``least`` occurrences, and the number of words of each language."""
    lang = F.coalesce("lang", F.lit("und"))
    docs = docs.select("text", lang.alias("lang"), F.xxhash64(lang).alias("__lang"))
    counts, totals = tally(docs)
    bitmap = marked(counts, least)
    for level in (1, 2):
        bitmap = marked(tally(docs, bitmap, level)[0], least, bitmap)
    nodes = cut(tries(docs, bitmap, depth))
    return cut(merge(dealt(nodes), least)), totals


def scored(frequent: DataFrame, totals: DataFrame, least_percent: int = PERCENT) -> DataFrame:
    """Candidates that no longer one covers, with the parts ``l, r`` and ``score`` of their weakest cut."""
    split_up = frequent.where("size > 1").withColumn("w", F.split("phrase", " "))
    cuts = split_up.select("lang", "phrase", "a", "size", "w", F.posexplode("lefts").alias("k", "l"))
    part = lambda begin, many: F.array_join(F.slice("w", begin, many), " ")
    k = F.col("k") + 1
    right = F.struct(F.lit("r").alias("side"), part(k + 1, F.col("size") - k).alias("part"))
    left = F.struct(F.lit("l").alias("side"), part(F.lit(1), k).alias("part"))
    asked = cuts.select("lang", "phrase", "a", "k", "l", F.inline(F.when(F.col("l") > 0, F.array(right)).otherwise(F.array(right, left))))
    met = asked.join(frequent.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")), ["lang", "part"])
    known = met.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == "l", F.col("f")).otherwise(F.col("l"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    value = known.join(totals, "lang").withColumn("score", F.expr("(cast(a as decimal(19,0)) * cast(n as decimal(19,0)) * 1000BD) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    weakest = value.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "n", "x.score", "x.l", "x.r")
    inner = [F.struct(part(F.lit(i + 1), F.lit(m)).alias("phrase"), (F.col("size") >= i + m).alias("there"), (F.col("size") > m).alias("longer")) for m in range(2, MOST_WORDS) for i in range(MOST_WORDS - m + 1)]
    inside = split_up.where("size > 2").select("lang", "a", F.inline(F.array(*inner))).where("there and longer").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = weakest.join(inside, ["lang", "phrase"], "left").where(F.col("around").isNull() | (whole("around") * 100 < whole("a") * least_percent))
    return kept.drop("around")


def mine(docs: DataFrame, least: int = LEAST, percent: int = PERCENT, top: int = TOP) -> DataFrame:
    """The best ``top`` phrases of each language; a language's ranking begins in :data:`SALTS` parts, so one task gets only the best of each."""
    frequent, totals = frequent_phrases(docs, least)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    found = scored(frequent, totals, percent).withColumn("__salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__salt").orderBy(*order))).where(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(documents: DataFrame) -> DataFrame:
    return mine(documents.select("lang", "text"))


def oracle(least: int = LEAST, percent: int = PERCENT, top: int = TOP) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
lists as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]'), lambda x: x <> '') as w from pieces),
places as (select lang, w, unnest(range(1, len(w) + 1)) as i from lists),
totals as (select lang, count(*) as n from places group by 1),
grams as (select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase from places, range(1, {MOST_WORDS + 1}) t(m) where i + m - 1 <= len(w)),
f as (select lang, phrase, m, count(*) as a from grams group by 1, 2, 3 having count(*) >= {least}),
long as (select *, string_split(phrase, ' ') as w from f where m > 1),
cuts as (select lang, phrase, a, m, k, array_to_string(w[1:k], ' ') as x, array_to_string(w[k + 1:], ' ') as y from long, range(1, {MOST_WORDS}) t(k) where k < m),
scores as (select c.lang, c.phrase, c.a, c.m, k, p.a as l, q.a as r, n, (1000::hugeint * c.a * n) // (p.a::hugeint * q.a) as score from cuts c join f p on p.lang = c.lang and p.phrase = c.x join f q on q.lang = c.lang and q.phrase = c.y join totals t on t.lang = c.lang),
weakest as (select * from scores qualify row_number() over (partition by lang, phrase order by score, k) = 1),
kept as (select * from weakest s where not exists (select 1 from f g where g.lang = s.lang and g.m > s.m and contains(' ' || g.phrase || ' ', ' ' || s.phrase || ' ') and 100 * g.a >= {percent} * s.a))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase)::bigint as "rank", phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from kept
qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= {top}"""
