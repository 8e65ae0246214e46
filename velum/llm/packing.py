"""Best-fit packing of token sequences by minimum bin slack.

Documents become pieces of at most ``size`` tokens. Only the number of pieces of each length matters for the packing, so
the search runs on a histogram of at most ``size`` numbers: for each bin, which starts with the longest piece left, a
subset-sum over the available lengths, as bit sets of reachable fills, finds the fullest combination; it is taken as
often as the histogram allows. Pieces then find their place by their rank among pieces of their length. Full-length pieces fill a sequence alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velum.llm.arrays import chunks, i64
from velum.llm.shared import cut

SIZE = 1024
END_ID = 2
#: Ranks are counted within (length, slot): slots have about SLOT_PIECES pieces, more only where there would be over MOST_SLOTS of them.
SLOT_PIECES, MOST_SLOTS = 500, 100_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def fullest(have: dict[int, int], size: int) -> dict[int, int]:
    """The multiset of available lengths (``length: count``) with the largest sum up to ``size``, preferring long ones.

    Bit i of a mask says that a fill of i can be reached with the lengths seen so far; a length that occurs n times adds
    1, 2, 4, ... copies and a rest, so that any number up to n can be made.
    """
    limit, reach, steps = (1 << size + 1) - 1, 1, []
    for length in sorted(have, reverse=True):
        left, power = min(have[length], size // length), 1
        while left:
            k = min(power, left)
            steps.append((length, k, reach))
            reach |= reach << length * k & limit
            left, power = left - k, power * 2
        if reach >> size:
            break
    fill = reach.bit_length() - 1
    out: dict[int, int] = {}
    for length, k, before in reversed(steps):
        if not before >> fill & 1:
            out[length] = out.get(length, 0) + k
            fill -= length * k
    return out


def plan(histogram: dict[int, int], size: int = SIZE) -> tuple[np.ndarray, int]:
    """Minimum bin slack over a histogram of lengths below or at ``size``.

    Returns rows ``length, first rank, pieces of it in a bin, first bin, offset in the bin``, by length and first rank,
    and the number of bins. Each row stands for all bins of one repeated combination; a combination is repeated until
    one of its lengths runs out, so there are at most as many combinations as lengths times a few.
    """
    left, used, rows, bins = {k: v for k, v in histogram.items() if v and k}, dict.fromkeys(histogram, 0), [], 0
    while left:
        top = max(left)  # the longest is the hardest to place, so each bin starts with it
        others = {k: v - (k == top) for k, v in left.items() if k <= size - top and v > (k == top)}
        combo = fullest(others, size - top)
        combo[top] = combo.get(top, 0) + 1
        times = min(left[k] // n for k, n in combo.items())
        offset = 0
        for length, n in sorted(combo.items(), reverse=True):
            rows.append((length, used[length], n, bins, offset))
            used[length] += n * times
            left[length] -= n * times
            if not left[length]:
                del left[length]
            offset += length * n
        bins += times
    rows.sort()
    return np.asarray(rows, np.int64).reshape(-1, 5), bins


def place(lengths: np.ndarray, ranks: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by length and rank among their length (from 0)."""
    top = int(ranks.max(initial=0)) + int(rows[:, 1].max(initial=0)) + 1
    at = np.searchsorted(rows[:, 0] * top + rows[:, 1], lengths * top + ranks, "right") - 1
    length, first, n, bin0, offset = rows[at].T
    r = ranks - first
    return bin0 + r // n, offset + r % n * length


def cut_pieces(docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = END_ID, *, keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of each document's tokens with the end id.

    A longer document is cut so that the rest that doesn't fill a piece comes first. Null and empty texts are one piece
    with the end id alone.
    """

    def run(batches: Iterable[pa.RecordBatch]):
        from velum.llm.tokens import Encoder

        encoder = Encoder(vocabulary)
        for batch in batches:
            for rows, data, offs in chunks(batch, limit=1 << 22):
                ids, at = encoder.encode(data, offs)
                n = np.diff(at) + 1
                ids = np.insert(ids, at[1:], end_id).astype(np.uint32)
                begin = np.concatenate([[0], np.cumsum(n)])[:-1]
                count = -(-n // size)
                doc = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                rest = n - (count - 1) * size
                start = np.where(piece, rest[doc] + (piece - 1) * size, 0)
                length = np.where(piece, size, rest[doc])
                lo = begin[doc] + start
                crc = np.fromiter((zlib.crc32(ids[a:b].tobytes()) for a, b in zip(lo, lo + length, strict=True)), np.int64, len(lo))
                out = [rows.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), i64(start), i64(length), i64(crc)]
                if keep_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([lo, [len(ids)]]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` (a written table with ``doc_id, piece, length``) plus ``sequence_id`` and ``offset``.

    Ties between pieces of one length go by id and piece; repeated rows are pieces of their own. Pieces of the full length
    need no rank: their sequences have negative numbers.
    """
    total = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect() if r["length"] < size}  # below size numbers
    rows, _ = plan(total, size)
    each = max(SLOT_PIECES, sum(total.values()) // MOST_SLOTS)
    slots = np.asarray([1 + total.get(i, 0) // each for i in range(size + 1)])
    first = np.cumsum(slots) - slots
    slot = F.pmod(F.xxhash64("doc_id", "piece"), F.element_at(F.lit(slots.tolist()), F.col("length").cast("int") + 1)).cast("int")
    slotted = pieces.where(F.col("length") < size).withColumn("__slot", slot)
    before = np.zeros(slots.sum(), np.int64)
    for r in slotted.groupBy("length", "__slot").agg(F.count("*").alias("n")).collect():  # at most MOST_SLOTS + 2 * size numbers
        before[first[r["length"]] + r["__slot"]] = r["n"]
    before = np.cumsum(before) - before
    before -= np.repeat(before[first], slots)
    rank = F.row_number().over(Window.partitionBy("length", "__slot").orderBy("doc_id", "piece")).cast("long")
    fields = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}
    schema = ", ".join([f"`{c}` {t}" for c, t in fields.items()] + ["sequence_id long", "offset long"])

    def run(batches):
        for b in batches:
            if b.num_rows:
                get = lambda c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                lengths = get("length")
                sequence, offset = place(lengths, before[first[lengths] + get("__slot")] + get("__rank") - 1, rows)
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in fields] + [i64(sequence), i64(offset)], [*fields, "sequence_id", "offset"])

    alone = pieces.where(F.col("length") == size).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return slotted.withColumn("__rank", rank).mapInArrow(run, schema).unionByName(alone)


def query(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    return pack(cut(cut_pieces(documents, vocabulary or default_vocabulary())))
