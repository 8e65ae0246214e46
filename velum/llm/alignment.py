"""Alignment of two tokenizers' tokens over whole texts, each distinct segment tokenised and aligned once.

A text is cut before runs of white space, where neither vocabulary can merge across: a byte-level BPE splits there by its
pattern, and :func:`breaks` reads from both vocabularies which white space no entry has after another character (in the piece
vocabulary a carriage return follows ``;``, so no cut is made before one). Both tokenizers end a token at every cut, so a
document's tokens, groups and links are those of its segments, one after another.

1. Tasks cut their documents, number the distinct segments of a shard (some megabytes of text) and write them with their
   counts, and the documents as sequences of these numbers.
2. Equal segments of all shards meet, and each is tokenised and aligned once, in batches of arrays: with the ends of both
   tokenizers' tokens as byte offsets, links are the intervals between any ends, groups those between common ends.
3. Links are counted over the corpus (segments weighted by their occurrences); the counts are broadcast to the segments if
   there are at most :data:`BROADCAST_LINKS`, and joined to them if there are more.
4. Alignments go back to the shards, where the documents are put together: a shard gets each of its distinct segments once,
   so no segment is frequent there. A segment's row names the shards that have it (12 bytes each).

A document with a segment whose tokens don't give back its bytes has no tokens at all; its other segments' counts are
taken back before links are counted. Null and empty texts have no tokens either: zeros, and an empty string. Rows come back as
often as they came, null ids too. Texts are read whole; one beyond the size of a shard is a shard. Other columns than
``doc_id`` and ``text`` are not read. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velum.llm.arrays import buffers, byte_spans, chunks, expand, ranges, squeeze
from velum.llm.shared import cut
from velum.llm.tokens import Encoder

#: Bytes of text in a shard.
SHARD_BYTES = 16 << 20
#: Counts of links (17 bytes each) up to this number are broadcast.
BROADCAST_LINKS = 2_000_000
#: Segments aligned at once.
BLOCK = 20_000
ASCII_WHITE = " \t\n\x0b\x0c\r"
MARK = "▁"
AT = "array<struct<shard:bigint,local:int>>"
#: What is said of a segment whose tokens don't give its bytes back.
NOTHING = "-1 0 0 0 0 0 "
STATS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
#: Bytes of groups that a task puts together at once.
TEXT_BYTES = 2 << 20
COMPOSED = pa.schema([*((c, pa.int64()) for c in ("doc_id", *STATS)), ("groups", pa.string()), ("groups_sha256", pa.string())])


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def breaks(a_tokens: list[bytes], b_pieces: list[str]) -> bytes:
    """The ASCII white space before which both vocabularies can be cut, if other characters stand before it.

    No entry may have it after a character that is not white. And as the second tokenizer puts a space before what it is given,
    no piece may have it after a space, unless it is one itself and can be left away for that.
    """
    followed = {y for t in chain((x.decode("utf-8", "replace") for x in a_tokens), b_pieces) for x, y in zip(t, t[1:], strict=False) if not x.isspace() and y in ASCII_WHITE}
    followed |= {y for t in b_pieces for x, y in zip(t, t[1:], strict=False) if x == " " and y in ASCII_WHITE and y != " "}
    return "".join(c for c in ASCII_WHITE if c not in followed).encode()


def after_white(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place is white space of any script (or a control character that some call so)."""
    p1 = data[at - 1]
    out = (p1 == 32) | (p1 >= 9) & (p1 <= 13) | (p1 >= 28) & (p1 <= 31)
    wide = np.flatnonzero(p1 >= 0x80)
    at, p1 = at[wide], p1[wide]
    p2, p3 = (data[np.maximum(at - i, 0)] for i in (2, 3))
    found = (p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0)) & (at > 1)
    three = at > 2
    found |= three & (p3 == 0xE1) & ((p2 == 0x9A) & (p1 == 0x80) | (p2 == 0xA0) & (p1 == 0x8E))
    found |= three & (p3 == 0xE2) & ((p2 == 0x80) & ((p1 <= 0x8A) | (p1 == 0xA8) | (p1 == 0xA9) | (p1 == 0xAF)) | (p2 == 0x81) & (p1 == 0x9F))
    out[wide] = found | three & (p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x80)
    return out


def segments(data: np.ndarray, offs: np.ndarray, breaking: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with a space before each that is not empty, and where their segments begin: bytes, new offsets of the texts, begins."""
    some = np.diff(offs) > 0
    data = np.insert(data, offs[:-1][some], 32)
    offs = offs + np.concatenate([[0], np.cumsum(some)])
    can = np.zeros(256, bool)
    can[list(breaking)] = True
    begins = can[data]
    begins[:1] = False
    at = np.flatnonzero(begins)
    begins[at[after_white(data, at)]] = False
    begins[offs[:-1][some]] = True
    return data, offs, np.flatnonzero(begins)


def distinct(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and number of each value of two hashes together; the second one is sorted only if the first one fails."""
    if not len(h1):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, first, number = np.unique(h1, return_index=True, return_inverse=True)
    if not (h2[first][number] == h2).all():
        _, first, number = np.unique(np.stack([h1, h2], 1), axis=0, return_index=True, return_inverse=True)
    return first, number.ravel()


def shards(docs: DataFrame, breaking: bytes, shard_bytes: int) -> DataFrame:
    """Rows ``shard, local, segment, n`` of each shard's distinct segments and a row ``shard, docs`` of its documents."""
    names = ["shard", "local", "segment", "n", "docs"]

    def run(batches):
        task, made = TaskContext.get().partitionId() << 32, 0
        held, size = [], 0
        for b in batches:
            for rows, data, offs in chunks(b):
                data, offs, begin = segments(data, offs, breaking)
                end = np.append(begin[1:], len(data))
                h = [byte_spans(data, w).of(begin, end) for w in (0, 1)]
                first, number = distinct(*h)
                sizes = end[first] - begin[first]
                texts = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.py_buffer(data[ranges(begin[first], sizes)])])
                held.append((rows.column(0), np.diff(np.searchsorted(begin, offs)), h[0][first], h[1][first], texts, number, np.bincount(number, minlength=len(first))))
                size += len(data)
                if size >= shard_bytes:
                    yield from flush(task + made, held)
                    made, held, size = made + 1, [], 0
        if held:
            yield from flush(task + made, held)

    def flush(shard, held):
        """Numbers of pieces of the shard become those of the whole shard."""
        first, of = distinct(*(np.concatenate([x[c] for x in held]) for c in (2, 3)))
        n = np.bincount(of, np.concatenate([x[6] for x in held]), len(first)).astype(np.int64)
        at = np.append(0, np.cumsum([len(x[2]) for x in held]))
        number = np.concatenate([of[a:z][x[5]] for a, z, x in zip(at, at[1:], held, strict=False)])
        own = pa.concat_arrays([x[4] for x in held]).take(pa.array(first)).cast(pa.string())
        for a in range(0, len(own), BLOCK):
            part = own.slice(a, BLOCK)
            yield out([shard] * len(part), np.arange(a, a + len(part)), part, n[a : a + BLOCK], None)
        ids = pa.chunked_array([x[0] for x in held]).combine_chunks()
        parts = [squeeze(ids.fill_null(0).to_numpy()), squeeze(ids.is_null().to_numpy(zero_copy_only=False).view(np.uint8)), squeeze(np.concatenate([x[1] for x in held]).astype(np.int32)), squeeze(number.astype(np.int32))]
        yield out([shard], None, None, None, pa.array([parts], pa.list_(pa.binary())))

    def out(shard, local, segment, n, docs):
        many = len(shard)
        cells = (local, segment, n, docs)
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.list_(pa.binary()))
        cells = [pa.nulls(many, k) if c is None else c.cast(k) if isinstance(c, pa.Array) else pa.array(c.astype(np.int64)).cast(k) for c, k in zip(cells, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), *cells], names)

    return docs.select("doc_id", "text").mapInArrow(run, "shard long, local int, segment string, n long, docs array<binary>")


class Aligner:
    """Tokens of segments under both tokenizers, and what they have to do with each other."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = Encoder(a_path, keep=200_000)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        with open(a_path, encoding="utf-8") as f:
            said = json.load(f)
        vocabulary = said["model"]["vocab"]
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.a_tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_tokens[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_tokens = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id(MARK)
        splits = (said.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and said["pre_tokenizer"].get("use_regex", True) and not said.get("normalizer")
        normal = [p.replace(MARK, " ") for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.breaks = breaks(self.a_tokens, normal) if splits else b""
        self.flat = [(np.frombuffer(b"".join(t), np.uint8), np.cumsum([0, *map(len, t)])[:-1], np.asarray([len(x) for x in t], np.int64)) for t in (self.a_tokens, self.b_tokens)]

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each tokenizer: ids of all segments and how many each has. The second one puts a space before what it gets, so a first space is left away, and where there is none its token goes."""
        raw = [t.encode() for t in texts]
        a_ids, at = self.a.encode(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))))
        spaced = [t.startswith(" ") for t in texts]
        second = self.b.encode([t[1:] if s else t for t, s in zip(texts, spaced, strict=True)], num_threads=1)
        second = [ids if s and len(t) > 1 else [self.space] if s else ids[1:] if ids[:1] == [self.space] else [] for ids, s, t in zip(second, spaced, texts, strict=True)]
        return [(a_ids.astype(np.int64), np.diff(at)), (np.fromiter(chain.from_iterable(second), np.int64), np.fromiter(map(len, second), np.int64, len(second)))]

    def align(self, texts: list[str]) -> dict:
        """Per segment: ``ok`` (both give its bytes), ``n_a, n_b, n_groups``, the links as ``a << 32 | b``, and the groups as text."""
        raw = [t.encode() for t in texts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        both = self.tokens(texts)
        ok = np.ones(len(texts), bool)
        spelt = []
        for (ids, many), (_, _, length) in zip(both, self.flat, strict=True):
            of = np.repeat(np.arange(len(texts)), many)
            ok &= np.bincount(of, length[ids], len(texts)).astype(np.int64) == sizes
            spelt.append(of)
        source = np.frombuffer(b"".join(x for x, good in zip(raw, ok.tolist(), strict=True) if good), np.uint8)
        row = np.repeat(np.flatnonzero(ok), sizes[ok])
        wrong = np.zeros(len(source), bool)
        for (ids, _), of, (flat, start, length) in zip(both, spelt, self.flat, strict=True):
            own = ids[ok[of]]
            wrong |= flat[ranges(start[own], length[own])] != source
        ok[row[wrong]] = False
        own = [ids[ok[of]] for (ids, _), of in zip(both, spelt, strict=True)]
        ends = [np.cumsum(length[ids]) for ids, (_, _, length) in zip(own, self.flat, strict=True)]
        whole = np.cumsum(sizes[ok])
        every, common = np.union1d(*ends), np.intersect1d(*ends, assume_unique=True)
        link = own[0][np.searchsorted(ends[0], every)] << 32 | own[1][np.searchsorted(ends[1], every)]
        n_links, n_groups = (np.bincount(np.searchsorted(whole, x), minlength=len(whole)) for x in (every, common))
        said = [list(map(str, ids.tolist())) for ids in own]
        edges = [np.append(0, np.searchsorted(e, common) + 1).tolist() for e in ends]
        groups = [",".join(said[0][i:j]) + "|" + ",".join(said[1][k:m]) for i, j, k, m in zip(edges[0], edges[0][1:], edges[1], edges[1][1:], strict=False)]
        at = np.append(0, np.cumsum(n_groups)).tolist()
        text = iter([";".join(groups[i:j]) for i, j in zip(at, at[1:], strict=False)])
        n = np.zeros((4, len(texts)), np.int64)  # zero where not ok
        n[:, ok] = both[0][1][ok], both[1][1][ok], n_groups, n_links
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n[3])).astype(np.int32)), pa.array(link))
        said = pa.array([next(text) if good else "" for good in ok.tolist()], pa.string())
        return {"ok": pa.array(ok), "n_a": pa.array(n[0]), "n_b": pa.array(n[1]), "n_groups": pa.array(n[2]), "links": lists, "groups": said}


def aligned(met: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Adds to distinct segments ``segment, n, at`` what :meth:`Aligner.align` says."""

    def run(batches):
        aligner = None
        for b in batches:
            aligner = aligner or Aligner(*paths)
            for a in range(0, b.num_rows, BLOCK):
                part = b.slice(a, BLOCK)
                got = aligner.align(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *got.values()], [*part.schema.names, *got])

    return met.mapInArrow(run, f"segment string, n long, at {AT}, ok boolean, n_a long, n_b long, n_groups long, links array<long>, groups string")


def taken_back(parts: DataFrame, bad: DataFrame) -> DataFrame:
    """``segment, less``: occurrences of segments in documents that have a bad segment, from the shards that have one."""
    hit = bad.select(F.inline("at")).groupBy("shard").agg(F.collect_set("local").alias("bad"))

    def run(batches):
        for b in batches:
            for shard, docs, bad in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                sizes, number = expand(docs[2], np.int32), expand(docs[3], np.int32)
                hits = np.append(0, np.cumsum(np.isin(number, bad)))
                edge = np.append(0, np.cumsum(sizes))
                local, n = np.unique(number[np.repeat(np.diff(hits[edge]) > 0, sizes)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(local), pa.int64()), pa.array(local, pa.int32()), pa.array(n, pa.int64())], ["shard", "local", "less"])

    less = parts.where("docs is not null").select("shard", "docs").join(hit, "shard").mapInArrow(run, "shard long, local int, less long")
    return less.join(parts.where("segment is not null"), ["shard", "local"]).groupBy("segment").agg(F.sum("less").alias("less"))


def link_counts(weighted: DataFrame) -> DataFrame:
    """``link, count, best``: occurrences of each pair of ids as a link, and whether no other link of its second id has more."""
    links = weighted.where("ok and n > 0").select("n", F.explode("links").alias("link")).groupBy("link").agg(F.sum("n").alias("count"))
    b_id = F.col("link").bitwiseAND((1 << 32) - 1)
    return links.withColumn("best", F.max("count").over(Window.partitionBy(b_id)) == F.col("count"))


def sent(found: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """``shard, local, said`` for every shard of every segment: the numbers of :data:`STATS` and the groups in one text, :data:`NOTHING` where tokens don't give the bytes back."""
    known = None
    if links.count() <= most:
        got = links.orderBy("link").toArrow()
        known = found.sparkSession.sparkContext.broadcast([got[c].to_numpy() for c in ("link", "count", "best")])
    else:
        asked = found.where("ok").select("segment", F.explode("links").alias("link"))
        counts = asked.join(links, "link").groupBy("segment").agg(F.count_if("best").alias("n_best"), F.sum("count").alias("count_sum"))
        found = found.join(counts, "segment", "left").na.fill(0, ["n_best", "count_sum"])

    def run(batches):
        for b in batches:
            get = lambda c, b=b: b.column(b.schema.get_field_index(c))
            lists, at = get("links"), get("at")
            edge = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            if known is None:
                best, count = get("n_best").to_numpy(), get("count_sum").to_numpy()
            elif len(known.value[0]):
                links, counts, bests = known.value
                flat = lists.flatten().to_numpy()
                place = np.minimum(np.searchsorted(links, flat), len(links) - 1)
                there = links[place] == flat  # a link of none but documents without tokens isn't counted
                best, count = (np.diff(np.append(0, np.cumsum(np.where(there, x[place], 0)))[edge]) for x in (bests, counts))
            else:
                best = count = np.zeros(b.num_rows, np.int64)
            numbers = zip(*(x.tolist() for x in (get("n_a"), get("n_b"), get("n_groups"), np.diff(edge), best, count)), strict=True)
            said = [f"{' '.join(map(str, n))} {g}" if ok else NOTHING for ok, n, g in zip(get("ok").to_pylist(), numbers, get("groups").to_pylist(), strict=True)]
            row = np.repeat(np.arange(b.num_rows), np.diff(at.offsets.to_numpy()))
            places = at.flatten()
            for a in range(0, len(row), BLOCK):
                part = places.slice(a, BLOCK).flatten()
                yield pa.RecordBatch.from_arrays([*part, pa.array(said, pa.string()).take(pa.array(row[a : a + BLOCK]))], ["shard", "local", "said"])

    columns = ["at", "ok", "n_a", "n_b", "n_groups", "links", "groups", *(["n_best", "count_sum"] if known is None else [])]
    return found.select(*columns).mapInArrow(run, "shard long, local int, said string")


def put_together(left: pa.Table, right: pa.Table, limit: int = TEXT_BYTES) -> pa.Table:
    """Documents of a shard (``docs`` of ``right``) from its segments' ``local, said``, in chunks of about ``limit`` bytes of groups.

    Groups stay bytes where they came in and are copied once, to the text of a document; no string is made for a segment.
    """
    ids, null, sizes, number = (expand(x, k) for x, k in zip(right["docs"][0].as_py(), (np.int64, np.uint8, np.int32, np.int32), strict=True))
    row = np.empty(left.num_rows, np.int64)
    row[left["local"].to_numpy()] = np.arange(left.num_rows)
    number = row[number].astype(np.int32)
    said = left["said"].combine_chunks()
    stats, length = [], []
    for a in range(0, len(said), BLOCK):
        fields = pc.split_pattern(said.slice(a, BLOCK), " ").flatten()
        column = lambda c, f=fields: f.take(pa.array(np.arange(c, len(f), len(STATS) + 1)))
        stats.append(np.stack([column(c).cast(pa.int64()).to_numpy() for c in range(len(STATS))]))
        length.append(pc.binary_length(column(len(STATS))).to_numpy())
    stats, length = np.concatenate([np.zeros((len(STATS), 0), np.int64), *stats], 1), np.concatenate([np.zeros(0, np.int64), *length])
    data, begin = buffers(said)
    begin = begin[1:] - length
    edge = np.append(0, np.cumsum(sizes))
    total = lambda x: np.diff(np.append(0, np.cumsum(x[number]))[edge])
    whole = (total(stats[0] < 0) == 0) & (sizes > 0)
    sums = [np.where(whole, total(x), 0) for x in stats]
    many = np.where(whole, total(length) + sizes - 1, 0)  # with what stands between groups of segments
    at = np.append(0, np.cumsum(many))
    out, a = [], 0
    while a < len(ids):
        z = max(a + 1, int(np.searchsorted(at, at[a] + limit, "right")) - 1)
        own = number[edge[a] : edge[z]][np.repeat(whole[a:z], sizes[a:z])]
        room = length[own] + 1
        room[np.cumsum(sizes[a:z][whole[a:z]]) - 1] -= 1
        text = np.full(at[z] - at[a], ord(";"), np.uint8)
        text[ranges(np.cumsum(room) - room, length[own])] = data[ranges(begin[own], length[own])]
        offs = at[a : z + 1] - at[a]
        view = memoryview(text)
        digest = [hashlib.sha256(view[i:j]).hexdigest() if j > i else "" for i, j in zip(offs.tolist(), offs[1:].tolist(), strict=False)]
        texts = pa.LargeStringArray.from_buffers(z - a, pa.py_buffer(offs), pa.py_buffer(text)).cast(pa.string())
        out.append(pa.RecordBatch.from_arrays([pa.array(ids[a:z], mask=null[a:z] == 1), *(pa.array(x[a:z]) for x in sums), texts, pa.array(digest, pa.string())], ["doc_id", *STATS, "groups", "groups_sha256"]))
        a = z
    return pa.Table.from_batches(out, COMPOSED)


def compose(alignments: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents of shards from their segments' alignments."""
    schema = f"doc_id long, {', '.join(f'{c} long' for c in STATS)}, groups string, groups_sha256 string"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return put_together(left, right)

    return alignments.groupBy("shard").cogroup(docs.groupBy("of_shard")).applyInArrow(run, schema)


def align(docs: DataFrame, paths: tuple[str, str] | None = None, shard_bytes: int = SHARD_BYTES, broadcast_links: int = BROADCAST_LINKS) -> DataFrame:
    """One row a document: ``doc_id``, the counts of :data:`STATS`, its ``groups`` as text and their digest."""
    paths = paths or default_paths()
    parts = cut(shards(docs, Aligner(*paths).breaks, shard_bytes))
    own = parts.where("segment is not null").select("segment", "n", "shard", "local").repartition("segment")
    met = own.groupBy("segment").agg(F.sum("n").alias("n"), F.collect_list(F.struct("shard", "local")).alias("at"))
    found = cut(aligned(met, paths))
    bad = found.where("not ok")
    weighted = found.select("segment", "n", "ok", "links")
    if not bad.isEmpty():
        weighted = weighted.join(taken_back(parts, bad), "segment", "left").withColumn("n", F.col("n") - F.coalesce("less", F.lit(0)))
    links = cut(link_counts(weighted))
    return compose(sent(found, links, broadcast_links), parts.where("docs is not null").select(F.col("shard").alias("of_shard"), "docs"))


def query(documents: DataFrame) -> DataFrame:
    return align(documents).drop("groups")
