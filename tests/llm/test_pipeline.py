"""The pipeline's stages on small tables: each works on what the last kept, and its decisions show."""

import corpus_pipeline

from tests.llm import corpus
from velum.llm import mixing


def test_stages(spark):
    docs = corpus.docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    from velum.llm.shared import cut

    names, kept = [], {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, ""))
        names.append(name)
        kept[name] = docs
        if name != "pack":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name in ("quality_rules", "line_dedup", "near_dedup"):
            assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
    assert names == ["quality_rules", "line_dedup", "near_dedup", "source_mix", "pack"]
    assert kept["quality_rules"].where("text is null or text = 'one'").count() == 0
    near = kept["near_dedup"]
    assert near.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").count() == 0
    taken = mixing.query(near).selectExpr("sum(taken)").first()[0]
    assert kept["source_mix"].select(mixing.n_words(kept["source_mix"]["text"]).alias("n")).selectExpr("sum(n)").first()[0] == taken
    assert kept["pack"].where("offset + length > 1024").count() == 0


def test_stages_on_an_empty_table(spark):
    docs = corpus.empty(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_middle_stages_equal_brute_force(spark):
    """Line dedup and near dedup, one after the other, against plain loops on documents with unique ids."""
    import random
    import re

    from velum.llm.shared import cut

    rng = random.Random(3)
    some = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    base = [some(80) for _ in range(6)]
    texts = [f"{t}\n{some(30)}" for t in base] + [base[0], f"{some(40)}\n{base[1]}", re.sub(r"^\w+", "zzz", base[2]), some(90), ""]
    texts += [texts[9] + " more", texts[9].replace(" ", "  ", 1) + f"\n{some(3)}"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    got = cut(corpus_pipeline.line_dedup(spark, docs, ""))
    seen, want = [], {}
    for i, t in enumerate(texts):
        keep = []
        for x in t.split("\n"):
            w = x.split()
            earlier = any(w == v or (min(len(w), len(v)) >= 5 and _edits_within_one(w, v)) for v in seen)
            if w:
                seen.append(w)
            if not (w and earlier):
                keep.append(x)
        if "\n".join(keep).split():
            want[i] = "\n".join(keep)
    assert {r.doc_id: r.text for r in got.collect()} == want
    grams = lambda t: {tuple(w[j : j + 5]) for w in [t.lower().split()] for j in range(len(w) - 4)} or {tuple(t.lower().split())}
    sets, label = {i: grams(t) for i, t in want.items()}, {i: i for i in want}
    for _ in want:
        for i in want:
            for j in want:
                if len(sets[i] & sets[j]) * 100 >= 80 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, got, "").collect()} == {i for i in want if label[i] == i}


def _edits_within_one(a: list, b: list) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))
