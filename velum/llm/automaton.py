"""Substring deduplication over words with suffix automata.

The corpus is its own reference: its repeated passages are cut into blocks (see anchors), dealt to shards by anchor, and a
shard's distinct blocks make one suffix automaton whose states know how often their strings occur in the corpus. The
shard's blocks are then streamed through it: the matching statistics, cut back to the threshold, tell at each word
whether the window that ends there occurs at least twice. Windows are judged on the input, not on what is left.

An automaton is sent to the one task that holds its shard rather than to every executor: streaming every document
through every shard's automaton would make the work grow with the square of the corpus, while a passage can only match
in the shard of its anchor.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from velum.llm.anchors import CONTENTS, finish, repeats, word_tokens

WINDOW = 35
K = 8
#: Words of distinct blocks in one automaton, besides a last group.
SHARD_WORDS = 50_000
#: Anchors with more distinct blocks are dealt out in slices of so many windows.
BIG_GROUP, WIDTH = 30_000, 4


class Automaton:
    """Suffix automaton of several word sequences, with the occurrences of each state's strings that are at least ``least`` long."""

    def __init__(self, least: int):
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        self.least = least

    def add(self, seq: Sequence, weight: int) -> None:
        nxt, link, length, count, last = self.next, self.link, self.length, self.count, 0
        for i, c in enumerate(seq, 1):
            q = nxt[last].get(c)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._clone(last, q, c)
            else:
                cur = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                count.append(0)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
                last = cur
            if i >= self.least:
                count[last] += weight

    def _clone(self, p: int, q: int, c) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(nxt[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        self.count.append(0)
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def close(self) -> None:
        """Add up the occurrences of longer strings into those of their suffixes."""
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.length[v] > self.least and self.length[self.link[v]] >= self.least:
                self.count[self.link[v]] += self.count[v]

    def often(self, seq: Sequence) -> list[int]:
        """For each position from ``least`` words on: occurrences of the ``least`` words that end there (0 if none)."""
        nxt, link, length, count, least = self.next, self.link, self.length, self.count, self.least
        out, v, matched = [], 0, 0
        for i, c in enumerate(seq, 1):
            while v and c not in nxt[v]:
                v = link[v]
                matched = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                matched += 1
            while matched >= least and length[link[v]] >= least:
                v = link[v]
                matched = length[v]
            if i >= least:
                out.append(count[v] if matched >= least else 0)
        return out


def runs(flags: list[bool]) -> list[int]:
    """First and end of each run of true flags, one after another."""
    out: list[int] = []
    for i, x in enumerate(flags):
        if x:
            if out and out[-1] == i:
                out[-1] = i + 1
            else:
                out += (i, i + 1)
    return out


def decide(held: list[tuple], length: int) -> pa.RecordBatch:
    """``b1, b2, runs`` of a shard's blocks ``(b1, b2, weight, origin, words)``, as the matching statistics of its automaton tell."""
    # Equal blocks of several slices or anchors are one sequence with the sum of their occurrences.
    number: dict[bytes, int] = {}
    sequences: dict[tuple, list] = {}
    for b1, b2, weight, origin, seq in held:
        found = sequences.setdefault(tuple(number.setdefault(w, len(number)) for w in seq), [0, []])
        found[0] += weight
        found[1].append((b1, b2, origin))
    machine = Automaton(length)
    for seq, (weight, _) in sequences.items():
        machine.add(seq, int(weight))
    machine.close()
    out = []
    for seq, (_, places) in sequences.items():
        found = runs([n > 1 for n in machine.often(seq)])
        if found:
            out += [(b1, b2, [x + origin for x in found]) for b1, b2, origin in places]
    b1, b2, lists = zip(*out, strict=True) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b1, pa.int64()), pa.array(b2, pa.int64()), pa.array(lists, pa.list_(pa.int32()))], ["b1", "b2", "runs"])


def resolve(length: int):
    def shards(batches):
        held, words_, last = [], 0, None
        for batch in batches:
            for shard, b1, b2, weight, origin, content in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("shard", "b1", "b2", "weight", "origin", "content")), strict=True):
                if shard != last and words_ > SHARD_WORDS:
                    yield decide(held, length)
                    held, words_ = [], 0
                last = shard
                seq = content.split()
                held.append((b1, b2, weight, origin, seq))
                words_ += len(seq)
        if held:
            yield decide(held, length)

    def run(wide: DataFrame, blocks, _: int) -> DataFrame:
        return wide.mapInArrow(blocks, CONTENTS).repartition("shard").sortWithinPartitions("shard").mapInArrow(shards, "b1 long, b2 long, runs array<int>")

    return run


def deduplicate(docs: DataFrame, length: int = WINDOW, k: int = K, *, keep_text: bool = True) -> DataFrame:
    """``docs`` plus ``n_words, n_removed, kept, kept_sha256``; ``kept`` is the UTF-8 text of the kept words, joined by one space.

    Null and empty texts have no words and keep the empty text. Repeated rows are copies: all their windows are
    repeats. Rows come back as often as they came, ids may be null. An empty table gives an empty table. Columns
    of ``docs`` with the names of the new ones are dropped.
    """
    new = ["n_words", "n_removed", "kept", "kept_sha256"]
    docs = docs.drop(*[c for c in docs.columns if c in {*new, "t1", "t2", "n", "n_spans"}])
    keyed, texts, spans = repeats(docs, word_tokens, length, k, resolve(length), BIG_GROUP, WIDTH)
    done = finish(texts, spans, length, by_word=True, keep_text=keep_text).withColumnRenamed("n", "n_words").drop("n_spans")
    return keyed.join(done, ["t1", "t2"]).select(*docs.columns, *new)


def query(documents: DataFrame) -> DataFrame:
    return deduplicate(documents.select("doc_id", "text"), keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
