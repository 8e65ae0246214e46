import collections
import math
import random
import re
import sys

import pyarrow as pa
from pyspark.sql import functions as F

from velum.functions import text
from velum.operators import content, terms

LETTERS = ["la", "mar", "el", "sol", "x", "río", "ﬁn", "two", "Ωmega", "9a", "of"]


def loop(rows, min_df, max_df, most):
    """The text block of (movieId, text) by counting; texts hold words of letters and digits between spaces."""
    tf = collections.Counter()
    for movie, t in rows:
        w = [x for x in re.split(r"\W+", (t or "").lower().replace("í", "i").replace("ﬁ", "fi")) if len(x) > 1]
        tf.update((movie, x) for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))])
    df, total = collections.Counter(f for _, f in tf), collections.Counter()
    for (_, f), n in tf.items():
        total[f] += n
    kept = sorted((f for f in df if min_df <= df[f] <= max_df * len(rows)), key=lambda f: (-total[f], f.encode()))[:most]
    idf = {f: math.log((1 + len(rows)) / (1 + df[f])) + 1 for f in kept}
    return {(m, f"text:{f}"): (1 + math.log(n)) * idf[f] for (m, f), n in tf.items() if f in idf}


def check(spark, rows, **how):
    full = {"min_df": 2, "max_df": 0.65, "most": 5000} | how
    block = content.text_block(spark.createDataFrame(rows, "movieId long, overview string"), **full)
    got = {(r["movieId"], r["feature"]): r["weight"] for r in block.collect()}
    want = loop(rows, **full)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    return block, got


def texts(n, seed):
    r = random.Random(seed)
    return [(i, " ".join(r.choices(LETTERS, weights=range(1, 12), k=r.randrange(0, 30)))) for i in range(n)]


def test_text_block_equals_counting_and_shuffles_no_term_of_a_text(spark, monkeypatch):
    rows = [*texts(60, 1), (100, None), (101, ""), (102, "of"), (103, "x y z")]
    for how in ({}, {"most": 12}, {"most": 1}, {"max_df": 1.0, "most": 20}, {"min_df": 1}):
        block, got = check(spark, rows, **how)
        assert got
        assert "Exchange" not in block._jdf.queryExecution().toString()
    monkeypatch.setattr(terms, "FEW", 3)  # too many frequent words to send: all pairs are counted
    check(spark, rows, most=12)


def test_text_block_of_texts_in_several_rows_and_of_none(spark):
    rows = texts(30, 2) + texts(12, 3) + [(5, "la la la mar"), (5, None)]
    check(spark, rows)
    check(spark, rows, most=10)
    check(spark, [(1, None), (2, "")])


def test_slices_of_a_batch_hold_whole_texts_in_order(monkeypatch):
    monkeypatch.setattr(terms, "BLOCK", 5)
    lists = [["a1", "b1"], [], ["a1"] * 12, ["c1", "", "b1"], ["b1"], []]
    batch = pa.record_batch([pa.array(range(6)), pa.array(lists, pa.list_(pa.string()))], names=["movieId", "w"])
    parts, got = list(terms._blocks([batch, batch.slice(6)])), []
    for movies, row, code, words in parts:
        met = [[] for _ in movies]
        for r, c in zip(row, code, strict=True):
            met[r].append(words[int(c)].as_py())
        got += zip(movies.to_pylist(), met, strict=True)
    assert len(parts) > 2 and got == list(enumerate(lists))


def test_spelt_class_holds_the_spelt_characters(spark):
    points = spark.range(0x80, sys.maxunicode + 1).where("id < 55296 or id > 57343")
    met = points.where(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").rlike(text.SPELT_CLASS))
    assert {r[0] for r in met.collect()} == {ord(c) for c, t in text.FOLDS.items() if len(t) > 1}
