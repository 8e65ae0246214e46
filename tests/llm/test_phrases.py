"""Collocations from merged count tries against counting everything in memory."""

import collections
import random
import re

import numpy as np
import pytest

from velum.llm import phrases

SCHEMA = "lang string, text string, a long, rank string"


def brute(rows, least, percent, top):
    f, n = collections.Counter(), collections.Counter()
    for lang, text, *_ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, 6) for i in range(len(w) - m + 1))
    out = []
    for (lang, w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        if any(100 * b >= percent * a for (other, v), b in f.items() if other == lang and len(v) > len(w) and b >= least and any(v[i : i + len(w)] == w for i in range(len(v)))):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    out.sort()
    found, place = [], collections.Counter()
    for lang, score, a, phrase, left, right in out:
        place[lang] += 1
        if place[lang] <= top:
            found.append((lang, place[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return found


def rows():
    rng = random.Random(9)
    words = ["the", "of", "é", "The", "a\x01", "a", "中", "OF", "x-y", "b'c"] + [f"w{i}" for i in range(30)]
    weights = [1 / (i + 1) for i in range(len(words))]
    some = lambda n: "".join(rng.choices(words, weights)[0] + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "! "]) for _ in range(n))
    texts = [some(rng.randint(0, 120)) for _ in range(60)] + [some(4000), None, "", " \t", ".,;", "the " * 500, "of the a of the " * 40]
    out = [((None, "en", "fr", "und", "en")[i % 5], t, 1, "x") for i, t in enumerate(texts)]
    return [*out, out[3], out[3], *[("en", "one fine passage of the day", 1, "x")] * 40]


@pytest.mark.parametrize(("least", "percent", "top", "shard"), [(5, 100, 2000, 10**6), (3, 60, 7, 300), (12, 100, 40, 50)])
def test_phrases_equal_brute_force(spark, monkeypatch, least, percent, top, shard):
    for name, value in (("SHARD_WORDS", shard), ("ROW_NODES", 16 if shard < 10**6 else 512), ("HELD", shard)):
        monkeypatch.setattr(phrases, name, value)
    frame = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = [tuple(r) for r in phrases.mine(frame, least, percent, top).orderBy("lang", "rank").collect()]
    want = brute(rows(), least, percent, top)
    assert got == want
    assert len(want) > 20


def test_trie_levels():
    ids = np.asarray([0, 1, 0, 1, 2, 0, 1])
    link = np.asarray([True, True, True, True, False, True, False])
    levels = list(phrases.trie(ids, link, np.ones(7, bool), 3, 5))
    assert levels[0][2].tolist() == [3, 3, 1]
    assert [list(map(tuple, zip(*map(np.ndarray.tolist, x), strict=True))) for x in levels[1:]] == [[(0, 1, 3), (1, 0, 1), (1, 2, 1)], [(0, 0, 1), (0, 2, 1), (1, 1, 1)], [(0, 1, 1), (2, 2, 1)], [(0, 2, 1)]]


def test_products_beyond_64_bits(spark):
    """Counts as of a very large corpus: 1000 * a * n has 33 digits."""
    a, n = 10**14 + 7, 3 * 10**15 + 1
    frequent = spark.createDataFrame([("en", "x", 1, 2 * a, []), ("en", "y", 1, 3 * a + 1, []), ("en", "x y", 2, a, [0])], "lang string, phrase string, size int, a long, lefts array<long>")
    got = phrases.scored(frequent, spark.createDataFrame([("en", n)], "lang string, n long")).collect()
    assert [(r.phrase, r.score, r.l, r.r) for r in got] == [("x y", 1000 * a * n // (2 * a * (3 * a + 1)), 2 * a, 3 * a + 1)]


def test_no_documents(spark):
    assert phrases.mine(spark.createDataFrame([], SCHEMA)).collect() == []
    assert phrases.mine(spark.createDataFrame([(None, None, 1, "x"), ("en", "", 1, "x")], SCHEMA)).collect() == []
