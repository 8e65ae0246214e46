"""Aligned tokens of whole documents, composed of segments, against tokenising every document whole."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import corpus
from velum.llm import alignment

ODD = ["a▁b", "x ▁ y", "▁", " ", "  ", "\n", "a\r\nb;\r\nc; \r\n", ";\r", "tab\tand\t\ttabs ", "end  ", "  start", "\n\n start \n\ny   　z  \nq", "x \ny“ \n”", "a\x00b \x1c c", "<s>hi</s> <0x0A> <unk> <|endoftext|>", "ﬁ １ é é \U0001f600 中文 字", "don't we'll 'tis  'S", "﻿bom x", "{\r\n  }\r\n\t\t);\r\n", "word\u0085  x   y᠎ z"]


@pytest.fixture(scope="module")
def tools():
    return alignment.Aligner(*alignment.default_paths())


def brute(rows, tools):
    whole = []
    for i, text in rows:
        spaced = (" " + text).encode() if text else b""
        a = tools.a.tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tools.b.encode(text) if text else []
        at = [tools.a_tokens[x] for x in a], [tools.b_tokens[x] for x in b]
        if b"".join(at[0]) != spaced or b"".join(at[1]) != spaced:
            a = b = []
            at = [], []
        ends = []
        for side in at:
            n, out = 0, []
            for t in side:
                out.append(n := n + len(t))
            ends.append(out)
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, links, p, q = [], [], 0, 0
        for c in common:
            pa, qa = p, q
            while p < len(a) and ends[0][p] <= c:
                p += 1
            while q < len(b) and ends[1][q] <= c:
                q += 1
            groups.append(",".join(map(str, a[pa:p])) + "|" + ",".join(map(str, b[qa:q])))
            links += [(a[x], b[y]) for x in range(pa, p) for y in range(qa, q) if max(ends[0][x] - len(at[0][x]), ends[1][y] - len(at[1][y])) < min(ends[0][x], ends[1][y])]
        whole.append((i, len(a), len(b), len(groups), links, ";".join(groups)))
    count = collections.Counter(x for w in whole for x in w[4])
    top = collections.Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [(i, na, nb, ng, len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), said, hashlib.sha256(said.encode()).hexdigest() if said else "") for i, na, nb, ng, links, said in whole]


@pytest.mark.parametrize(("size", "odd", "links"), [(1 << 20, True, 10**6), (3000, True, 0), (1 << 20, False, 0)])
def test_documents_equal_whole_tokenisation(spark, tools, size, odd, links):
    """With characters that only one tokenizer keeps, and without; large shards and small ones; counts of links broadcast and joined."""
    rows = [r[:2] for r in corpus.rows() if odd or "中" not in (r[1] or "")] + [(1000 + i, t) for i, t in enumerate(ODD if odd else ODD[3:12])]
    got = alignment.align(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, segment string, n int").repartition(3), shard_bytes=size, broadcast_links=links).collect()
    want = brute(rows, tools)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert (sum(w[1] == 0 and bool(t) for w, (_, t) in zip(want, rows, strict=True)) > 0) == odd


def test_random_texts_cut_where_both_tokenizers_do(spark, tools):
    rng = random.Random(2)
    alphabet = [" ", " ", "\t", "\n", "\r", "\x0b", "\x0c", " ", " ", "a", "b", "the", "s", "'", ";", ")", "1", "é", "▁", "中", "ing", "\x1f", "　"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 25)))) for i in range(3000)]
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), shard_bytes=5000).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, tools))


def test_breaks_follow_from_the_vocabularies():
    assert alignment.breaks([b"a", b" b", b"\n\n"], [" a", "  ", "x"]) == alignment.ASCII_WHITE.encode()
    assert alignment.breaks([b"a\n", b" b"], [" a", ";\r", " \t"]) == b" \x0b\x0c"
    assert alignment.breaks([b"a b"], []) == b"\t\n\x0b\x0c\r"


def test_no_documents(spark):
    assert alignment.align(corpus.empty(spark)).collect() == []
    got = alignment.align(spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")).collect()
    assert sorted(tuple(r)[1:] for r in got) == [(0, 0, 0, 0, 0, 0, "", "")] * 2


def test_documents_are_put_together_in_chunks():
    """Groups of a shard are never all strings at once: chunks hold about as many bytes as asked for, a longer text stands alone."""
    said = pa.table({"local": pa.array([2, 0, 3, 1], pa.int32()), "said": ["1 1 1 1 0 5 7|8", "2 1 1 2 1 9 1,2|3", alignment.NOTHING, "1 1 1 1 1 4 é|6"]})
    parts = [np.array([7, 8, 9, 10, 11]), np.array([0, 0, 1, 0, 0], np.uint8), np.array([2, 0, 1, 2, 3], np.int32), np.array([0, 1, 2, 3, 0, 2, 2, 0], np.int32)]
    docs = pa.table({"docs": pa.array([[alignment.squeeze(x) for x in parts]], pa.list_(pa.binary()))})
    texts = ["1,2|3;é|6", "", "7|8", "", "7|8;7|8;1,2|3"]
    want = [(i, *n, t, hashlib.sha256(t.encode()).hexdigest() if t else "") for i, n, t in zip([7, 8, None, 10, 11], [(3, 2, 2, 3, 2, 13), (0,) * 6, (1, 1, 1, 1, 0, 5), (0,) * 6, (4, 3, 3, 4, 1, 19)], texts, strict=True)]
    for limit, chunks in ((1, 5), (14, 2), (1 << 20, 1)):
        got = alignment.put_together(said, docs, limit)
        assert [tuple(r.values()) for r in got.to_pylist()] == want
        assert len(got.to_batches()) == chunks
