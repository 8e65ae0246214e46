"""Substring deduplication over bytes by a distributed merge sort of suffixes.

The suffixes that are sorted begin at anchors (see anchors): every long enough repeat has one, with the same text around
it, in all its places. Each task sorts the suffixes of its blocks into runs, which are exchanged front-coded: the
number of bytes shared with the suffix before, and the rest. A loser tree merges the runs of a part; it keeps each head's
common prefix with the last output, so it never compares known prefixes again, and its output has the common
prefix of all neighbours. With those, and the same for the bytes before the anchors, the windows of a block are equal to
others exactly where both sides agree far enough. Windows are judged on the input, not on what is left.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from velum.llm.anchors import byte_tokens, finish, repeats
from velum.llm.arrays import i64, mix

WINDOW = 400
K = 64
#: Distinct blocks in a part, on average: about 10 MB.
PART_BLOCKS = 10_000
#: Bytes of blocks in a task's run.
RUN_BYTES = 12 << 20
#: Anchors with more distinct blocks are dealt out in slices of so many windows.
BIG_GROUP, WIDTH = 8_000, 64


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, of which ``at`` bytes are known."""
    end = min(len(a), len(b))
    step = 32
    while at < end:
        to = min(end, at + step)
        x, y = a[at:to], b[at:to]
        if x != y:
            differ = int.from_bytes(x, "little") ^ int.from_bytes(y, "little")
            return at + ((differ & -differ).bit_length() - 1) // 8
        at, step = to, step * 4
    return end


def front_code(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Of sorted strings: bytes shared with the one before, and the rest."""
    shared, rest, before = [], [], b""
    for s in strings:
        n = common(before, s)
        shared.append(n)
        rest.append(s[n:])
        before = s
    return shared, rest


def merge(runs: list[Iterable[tuple[int, bytes]]]) -> Iterator[tuple[int, int]]:
    """Merges front-coded runs; yields the run of each string in order and its common prefix with the one before."""
    sources = [iter(r) for r in runs]
    k = max(1, len(sources))
    head: list[bytes | None] = [b""] * k
    shared = [0] * k

    def advance(r: int) -> None:
        step = next(sources[r], None) if r < len(sources) else None
        if step is None:
            head[r] = None
        else:
            n, rest = step
            head[r] = head[r][:n] + rest
            shared[r] = n

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's shared prefix then is with the winner."""
        x, y = head[a], head[b]
        if x is None:
            return b, a
        if y is None or shared[a] > shared[b]:
            return a, b
        if shared[a] < shared[b]:
            return b, a
        n = common(x, y, shared[a])
        if x[n : n + 1] <= y[n : n + 1]:
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    for r in range(k):
        advance(r)
    losers = [0] * k  # losers[i] lost at node i; the leaf of run r is node k + r
    winners = [0] * k + list(range(k))
    for i in range(k - 1, 0, -1):
        winners[i], losers[i] = play(winners[2 * i], winners[2 * i + 1])
    top = winners[1] if k > 1 else 0
    while head[top] is not None:
        yield top, shared[top]
        advance(top)
        i = (k + top) // 2
        while i:
            top, losers[i] = play(top, losers[i])
            i //= 2


def judge(shared: np.ndarray, backs: list[bytes], nwin: np.ndarray, weight: np.ndarray, length: int) -> np.ndarray:
    """For blocks in the order of their suffixes: which of their windows (columns, from the first) occur at least twice.

    A window that begins d bytes before the anchor is told apart by the class of its last ``length - d`` bytes among the
    sorted suffixes and by the class of its first d bytes among the sorted reversed backs.
    """
    n = len(backs)
    back = np.fromiter(map(len, backs), np.int64, n)
    turned = [b[::-1] for b in backs]
    order = sorted(range(n), key=turned.__getitem__)
    shared_back = np.fromiter((common(turned[a], turned[b]) for a, b in zip(order[:-1], order[1:], strict=True)), np.int64, n - 1)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    flags = np.zeros((n, int(nwin.max(initial=1))), bool)
    for d in range(int((back - nwin).min()) + 1, int(back.max()) + 1):
        own = np.flatnonzero((d <= back) & (d > back - nwin))
        if not len(own):
            continue
        ahead = np.cumsum(shared < length - d)[own]
        behind = np.concatenate([[0], np.cumsum(shared_back < d)])[rank[own]]
        _, which = np.unique(ahead * n + behind, return_inverse=True)
        twice = np.bincount(which, weight[own])[which] > 1
        own = own[twice]
        flags[own, back[own] - d] = True
    return flags


def resolve(length: int):
    fields = "part int, shared array<int>, rest array<binary>, back array<binary>, b1 array<long>, b2 array<long>, weight array<long>, origin array<int>, nwin array<int>"
    names = [f.split()[0] for f in fields.split(", ")]
    kinds = [pa.int32(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def run(wide: DataFrame, blocks, n_blocks: int) -> DataFrame:
        parts = max(1, n_blocks // PART_BLOCKS)

        def make_runs(batches):
            held, size = [], 0
            for batch in blocks(batches):
                held.append(batch)
                size += batch.nbytes
                if size > RUN_BYTES:
                    yield from sort(held)
                    held, size = [], 0
            if held:
                yield from sort(held)

        def sort(held):
            t = pa.Table.from_batches(held)
            if not t.num_rows:
                return
            part = (mix(t["shard"].to_numpy().view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            content, back = t["content"].to_pylist(), t["back"].to_pylist()
            b1, b2, weight, origin, nwin = (t[c].to_pylist() for c in ("b1", "b2", "weight", "origin", "nwin"))
            suffix = [c[b:] for c, b in zip(content, back, strict=True)]
            by = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[by], np.arange(parts + 1))
            for p in range(parts):
                own = sorted(by[edges[p] : edges[p + 1]].tolist(), key=suffix.__getitem__)
                if own:
                    shared, rest = front_code([suffix[i] for i in own])
                    row = [p, shared, rest, [content[i][: back[i]] for i in own], *([x[i] for i in own] for x in (b1, b2, weight, origin, nwin))]
                    yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, kinds, strict=True)], names)

        def merge_parts(batches):
            held, last = [], None
            for batch in batches:
                for i in range(batch.num_rows):
                    part = batch.column(0)[i].as_py()
                    if part != last and held:
                        yield decide(held)
                        held = []
                    last = part
                    held.append([batch.column(c)[i].as_py() for c in range(1, len(names))])
            if held:
                yield decide(held)

        def decide(runs):
            at, order, shared = [0] * len(runs), [], []
            for r, n in merge([zip(x[0], x[1], strict=True) for x in runs]):
                order.append((r, at[r]))
                shared.append(n)
                at[r] += 1
            pick = lambda c: [runs[r][c][i] for r, i in order]
            backs, b1, b2, weight, origin, nwin = (pick(c) for c in range(2, 8))
            nwin, origin = np.asarray(nwin, np.int64), np.asarray(origin, np.int64)
            flags = judge(np.asarray(shared, np.int64), backs, nwin, np.asarray(weight, np.float64), length)
            step = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            row, first = np.nonzero(step == 1)
            end = np.nonzero(step == -1)[1]
            some, begin = np.unique(row, return_index=True)
            pairs = np.stack([first + origin[row], end + origin[row]], 1).astype(np.int32).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([begin, [len(row)]]).astype(np.int32) * 2), pa.array(pairs))
            return pa.RecordBatch.from_arrays([i64(np.asarray(b1, np.int64)[some]), i64(np.asarray(b2, np.int64)[some]), lists], ["b1", "b2", "runs"])

        return wide.mapInArrow(make_runs, fields).repartition(parts, "part").sortWithinPartitions("part").mapInArrow(merge_parts, "b1 long, b2 long, runs array<int>")

    return run


def deduplicate(docs: DataFrame, length: int = WINDOW, k: int = K, *, keep_text: bool = True) -> DataFrame:
    """``docs`` plus ``n_bytes, n_removed, n_spans, kept, kept_sha256``; ``kept`` is the remaining bytes.

    Null and empty texts have no bytes. Repeated rows are copies: all their windows are repeats. Rows come back as often
    as they came, ids may be null. An empty table gives an empty table. Columns of ``docs`` with the names of the
    new ones are dropped.
    """
    new = ["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
    docs = docs.drop(*[c for c in docs.columns if c in {*new, "t1", "t2", "n"}])
    keyed, texts, spans = repeats(docs, byte_tokens, length, k, resolve(length), BIG_GROUP, WIDTH)
    done = finish(texts, spans, length, by_word=False, keep_text=keep_text).withColumnRenamed("n", "n_bytes")
    return keyed.join(done, ["t1", "t2"]).select(*docs.columns, *new)


def query(documents: DataFrame) -> DataFrame:
    return deduplicate(documents.select("doc_id", "text"), keep_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
