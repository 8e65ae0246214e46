"""A small corpus with every awkward case: nulls, empty and long texts, ties, repeated rows, copies, shared passages."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, t1 string, n int, shard int, label int"


def rows():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghiéß") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [some(rng.randint(60, 160)) for _ in range(24)]
    passage = some(90)
    for i in range(6):  # near copies of one text: a word or two changed
        w = texts[0].split(" ")
        for _ in range(i):
            w[rng.randrange(len(w))] = f"new{i}"
        texts.append(" ".join(w))
    texts += [texts[1], texts[1].upper(), texts[2]]
    texts += [f"{some(40)} {passage} {some(30)}" for _ in range(4)] + [passage]
    line = some(14)
    texts += [f"{some(20)}\n{line}\n{some(9)}", f"{line}\n{some(25)}", f"{line.replace(' ', '  ', 2)}\nend", " ".join(["x", *line.split(" ")[1:]]) + "\nother", " ".join(line.split(" ")[1:]) + "\nmore", "a b\na b\na b c d e\na b c d e"]
    texts += [None, "", " \n\t ", "one", "two words", "same same same same", "ab " * 400, "".join("ab" for _ in range(900)), some(6000), "中文 text — 'tis the \U0001d54f ²³ don't we'll", "#*$%&|<> <|endoftext|>"]
    out = [(i * 25, t, (None, "en", "fr")[i % 3], (None, "a", "b", "c")[i % 4], None if t is None else len(t), "x", "y", 1, 2, 3) for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, some(70), "en", "a", 1, "x", "y", 1, 2, 3), (None, None, None, None, None, None, None, None, None, None)]


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()
