"""Every text operator against brute force on a corpus of awkward cases, and on an empty table."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm import corpus
from velum.llm import automaton, lines, mixing, neighbours, packing, perplexity, queries, search, sketch, suffixes, templates, wordgrams


@pytest.fixture(scope="module")
def docs(spark):
    return corpus.docs(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return corpus.empty(spark)


def by_text(frame, docs_rows):
    return sorted(map(tuple, frame.collect()), key=str)


# 1


def scored(rows):
    """Brute force: for each query document, every document's rounded score with all terms of the query, best first."""
    rows = [(i, collections.Counter(re.findall(rb"[0-9A-Za-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())))) for i, t in rows if i is not None]
    n, mean = len(rows), sum(sum(c.values()) for _, c in rows) / len(rows)
    df = collections.Counter(t for _, c in rows for t in c)
    asked = collections.defaultdict(set)
    for i, c in rows:
        if i % 50 == 0:
            asked[i] |= set(c)
    out = {}
    for q, c in asked.items():
        scores = [(sum(math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * d[t] * 2.2 / (d[t] + 1.2 * (0.25 + 0.75 * sum(d.values()) / mean)) for t in sorted(c) if d[t]), i) for i, d in rows if any(d[t] for t in c)]
        if scores:
            out[q] = sorted((-round(s, 7), i) for s, i in scores)[:10]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_scoring_every_document(docs, spark, tmp_path, monkeypatch, small):
    """All terms, ties by id, repeated ids (also with different texts); with many shards, query blocks and document blocks too."""
    if small:
        for name, value in (("SHARD_BYTES", 2000), ("QUERY_BLOCK", 300), ("RUN", 64)):
            monkeypatch.setattr(search, name, value)
        monkeypatch.setattr(search.build, "__defaults__", (2000,))
    frame = docs.select("doc_id", "text").union(spark.createDataFrame([(50, "other words of one id"), (100, None)], "doc_id long, text string"))
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = collections.defaultdict(list)
    for r in queries.QUERIES["op1_block_max_wand"](spark, str(tmp_path)).collect():
        got[r.query_id].append((r["rank"], r.doc_id, r.score))
    want = scored([tuple(r) for r in frame.collect()])
    assert set(got) == set(want)
    for q, rows in want.items():
        own = sorted(got[q])
        assert [x[0] for x in own] == list(range(1, len(rows) + 1))
        assert np.allclose([x[2] for x in own], [-s for s, _ in rows], rtol=0, atol=1e-6), q
        if np.diff([s for s, _ in rows]).min(initial=1) > 1e-6:
            assert [x[1] for x in own] == [i for _, i in rows], q


def test_bounds_prune_without_loss():
    """Documents that the bounds leave out are many, and none of them is among the best."""
    rng = np.random.default_rng(3)
    lengths = np.sort(rng.integers(5, 60, 2000)).astype(np.int32)
    lists = [np.flatnonzero(rng.random(2000) < share) for share in (0.01, 0.02, 0.3, 0.5, 0.8)]
    counts = [rng.integers(1, 5, len(d)) for d in lists]
    wanted = np.arange(10, 15, dtype=np.uint64)
    row = {"ids": np.arange(2000) * 3, "lengths": lengths, "term": np.diff(wanted, prepend=np.uint64(0)), "df": np.asarray([len(d) for d in lists], np.int32), "docs": np.concatenate([np.diff(d, prepend=0) for d in lists]).astype(np.int32), "counts": np.concatenate(counts).astype(np.int32)}
    shard = search.Shard({k: search.squeeze(v) for k, v in row.items()}, wanted, 30.0)
    weights = np.asarray([4.0, 3.5, 1.0, 0.7, 0.2])
    score = np.zeros(2000)
    for d, c, w in zip(lists, counts, weights, strict=True):
        score[d] += w * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * lengths[d] / 30.0))
    ids, scores, full = search.answer(shard, np.arange(5), weights, 10, shard.bounds([np.arange(5)], weights)[0])
    want = np.lexsort((np.arange(2000), -score.round(9)))[:10]
    assert ids.tolist() == (want * 3).tolist() and np.allclose(scores, score[want])
    assert (shard.column[2:] >= 0).all() and full < 400
    assert not len(search.answer(shard, np.arange(5), weights, 10, shard.bounds([np.arange(5)], weights)[0], 100.0)[0])


# 2


def base(text):
    ws = corpus.words(text)
    raw = (text or "").encode()
    grams = collections.Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    hit = {i + j for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for x in raw.split(b"\n"):
        if x.split():
            dup += x in seen
            seen.add(x)
    return len(ws), sum(len(w.decode()) for w in ws), sum(c in b"#*$%&|<>" for c in raw), dup, len(hit)


def test_quality_rules_base_counts(docs):
    got = perplexity.query(docs).collect()
    assert len(got) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    for r in got:
        if r.doc_id is not None:
            want = base(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.kept and r.base_failed)
    assert any(r.kept for r in got)


def test_kneser_ney_sums_to_one():
    data = np.frombuffer(b"abracadabra abba cab bad cad abracadabra", np.uint8)
    k, n = np.unique(perplexity.keys(data, np.asarray([0, len(data)])), return_counts=True)
    model = perplexity.Model(k, n)
    for context in (*(k >> np.uint32(6))[:5], np.uint32(12345)):
        every = (np.uint32(context) << np.uint32(6)) + np.arange(64, dtype=np.uint32)
        assert math.isclose(float(np.exp(model.logp(every).astype(float)).sum()), 1.0, rel_tol=1e-4)


def test_words_count_under_all_other_rows(spark, monkeypatch):
    """Salad of known words and shouted text are as likely as prose to the byte model, which drops case and sees four bytes."""
    rng = random.Random(9)
    phrases = [" ".join("".join(rng.choice("abcdefghi") for _ in range(5)) for _ in range(6)) for _ in range(30)]
    texts = [" ".join(rng.choice(phrases) for _ in range(12)) for _ in range(60)]
    salad = texts[0].split(" ") + texts[1].split(" ")
    rng.shuffle(salad)
    texts += [" ".join(salad), texts[2].upper(), "", None, texts[3]]
    frame = spark.createDataFrame([(i, t, "en" if i % 7 else None) for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    monkeypatch.setattr(wordgrams, "SHARD_BYTES", 4000)
    got = {r.doc_id: r for r in perplexity.query(frame).collect()}
    assert len(got) == len(texts)
    clean = [got[i].log_perplexity for i in range(60)]
    assert got[60].log_perplexity > max(clean) and got[61].log_perplexity > max(clean)

    # Brute force, with counts of pairs and histories taken over the other rows; only the spelling of a word that no other row has is left to the byte model.
    rows = [(i, "en" if i % 7 else None, (t or "").split()) for i, t in enumerate(texts)]

    def pairs_of(ws):
        raw = np.frombuffer(" ".join(ws).encode(), np.uint8)
        return list(zip(wordgrams.events(raw, np.asarray([0, len(raw)]))[4].tolist(), ws, strict=True))

    discount = lambda c: wordgrams.DISCOUNTS[min(c, 3)]
    checked = 0
    for lang in ("en", None):
        every = collections.Counter(p for _, other, ws in rows if other == lang for p in pairs_of(ws))
        totals = np.zeros(wordgrams.CLASSES)
        for (h, _), c in every.items():
            totals[h] += c
        group = wordgrams.groups(totals)
        left, mass = np.zeros(wordgrams.GROUPS), np.bincount(group, totals, minlength=wordgrams.GROUPS)
        for (h, _), c in every.items():
            left[group[h]] += discount(c)
        for i, other, ws in rows:
            if other != lang:
                continue
            rest = every - collections.Counter(pairs_of(ws))
            before = collections.Counter(w for _, w in rest)
            if not ws or any(not before[w] for w in ws):
                continue
            total = 0.0
            for h, w in pairs_of(ws):
                c = rest[h, w]
                total += math.log((c - discount(c)) / totals[h]) if c else math.log(left[group[h]] / mass[group[h]] * (before[w] - wordgrams.DISCOUNT) / len(every))
            checked += 1
            assert math.isclose(got[i].log_perplexity, -total / len(texts[i].encode()), rel_tol=1e-5), i
    assert checked > 50


def test_bands_follow_the_spread(spark):
    """Quartiles of the documents that pass the base rules, widened by the spread alone: junk just outside goes, whatever the scale."""
    rng = np.random.default_rng(4)
    clean = [(float(a), float(b)) for a, b in zip(1.4 + 0.2 * rng.standard_normal(200), 1.3 + 0.02 * rng.standard_normal(200), strict=True)]
    junk = [(1.4, 1.3 + 0.12), (1.4, 1.3 - 0.12), (1.4 + 2.0, 1.3), (1.4 - 3.0, 1.3)]
    rows = [(i, "en", 100, 0, a, b) for i, (a, b) in enumerate(clean + junk)]
    got = {r.doc_id: r.kept for r in perplexity.judge(spark.createDataFrame(rows, "doc_id long, lang string, n_words long, n_repeat_words long, log_perplexity double, spelling_perplexity double")).collect()}
    want = np.ones(len(rows), bool)
    for place, (low, high) in ((4, (6, 4)), (5, (2, 2.5))):
        x = np.asarray([r[place] for r in rows])
        q1, q3 = np.quantile(x, [0.25, 0.75], method="inverted_cdf")
        want &= (x >= q1 - low * (q3 - q1)) & (x <= q3 + high * (q3 - q1))
    assert [got[i] for i in range(len(rows))] == want.tolist()
    assert not any(want[200:]) and want[:200].mean() > 0.97


# 3


def test_mixing(docs, spark):
    import duckdb

    got = mixing.query(docs).toPandas()
    documents = docs.toPandas()
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    c = duckdb.connect()
    c.register("documents", documents)
    want = c.sql(mixing.oracle()).df()
    tidy = lambda f: sorted(map(str, f[["doc_id", "size", "source_size", "target", "taken"]].astype({"doc_id": "Int64"}).itertuples(index=False)))
    assert tidy(got) == tidy(want)
    assert (got.taken <= 3 * got["size"]).all()
    out = mixing.emit(docs)
    assert out.columns == docs.columns and out.selectExpr("sum(regexp_count(coalesce(text, ''), '[^\\\\x20\\\\x09-\\\\x0D]+'))").first()[0] == got.taken.sum()


def test_mixing_ceiling(spark):
    rows = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 10), ("d", 0)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert got["b"] == 30 and got["c"] == 30 and got["d"] == 0 and math.isclose(got["a"], 960)


# 4


def test_line_dedup(docs):
    got = {r.doc_id: r for r in lines.query(docs).collect() if r.doc_id is not None}
    seen, subs, dels = set(), set(), set()
    near = 0
    for i, text in sorted({r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}.items()):
        keep = []
        for x in (text or "").split("\n"):
            w = tuple(x.encode().split())
            cuts = [(w[:j] + w[j + 1 :], j) for j in range(len(w))] if len(w) >= 10 else []
            close = w in dels or any(c in subs or (len(c[0]) >= 10 and c[0] in seen) for c in cuts)
            if len(w) >= 5 and (w in seen or close):
                near += close and w not in seen
                continue
            keep.append(x)
        for x in (text or "").split("\n"):  # every line counts as earlier, kept or not
            w = tuple(x.encode().split())
            if len(w) >= 5:
                seen.add(w)
                if len(w) >= 10:
                    subs.update((w[:j] + w[j + 1 :], j) for j in range(len(w)))
                    dels.update(w[:j] + w[j + 1 :] for j in range(len(w)))
        if i not in (None,) and len(set((text or "").split("\n"))) == len((text or "").split("\n")):
            assert got[i].kept_sha256 == hashlib.sha256("\n".join(keep).encode()).hexdigest(), i
    assert near >= 2


def test_registered_line_dedup_takes_short_lines(spark, tmp_path):
    texts = ["Les.\none two three four five six", "Les.\n\n\nother words", "one two three four five seven\nand four words here", "and four words there\nand four words here"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in queries.QUERIES["op4_line_dedup"](spark, str(tmp_path)).collect()}
    want = [texts[0], "\n\nother words", "and four words here", "and four words there"]
    assert got == {i: (len(texts[i].split("\n")) - len(x.split("\n")), hashlib.sha256(x.encode()).hexdigest()) for i, x in enumerate(want)}


def test_within_one():
    a = "a b c d".split()
    assert lines.within_one(a, "a b x d".split()) and lines.within_one(a, "a b d".split()) and lines.within_one(a, "a b c c d".split()) and lines.within_one(a, a)
    assert not lines.within_one(a, "b a c d".split()) and not lines.within_one(a, "a d".split())


# 5

PAGE = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><header><a href=/>Site</a></header><nav><ul><li>Menu</ul></nav><div class=ad>Buy</div><article><h1>Head &amp; line</h1><p>One\n <b>bold</b>&nbsp;x<br><p>Two &lt;3<aside>side</aside><form>f<input></form></article><div class='comments'><article>No</article></div><footer>&copy; f</footer>"


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_templates(spark, monkeypatch, most):
    monkeypatch.setattr(templates, "BROADCAST_TEMPLATES", most)
    plain = "<html><body><div><div>Share with friends now</div><p>Text number {i} of this page.</p></div><p>Legal words of the site</p></body>"
    rows = [(1, "http://a.example/1", PAGE), (2, None, None), (3, "http://[bad", ""), (4, "http://a.example/1", PAGE)] + [(10 + i, f"http://b.example/{i}", plain.replace("{i}", str(i))) for i in range(8)]
    got = {r.page_id: r for r in templates.query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == got[4].text == "Head & line\nOne bold x\nTwo <3" and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and got[13].text == "Text number 3 of this page."
    assert templates.extract(spark.createDataFrame([], "page_id long, url string, html string, text int")).count() == 0


def test_templates_decide_and_class_names_do_not(spark):
    """Boxes that recur on a host go, in the content element too; own text stays under any class name, and so do copies of one article."""
    page = "<html><body><div class='top'>Site bar</div><article><div class='notice'>Subscribe to our letter today</div><p class='share promo'>Own words {i} about sharing.</p><div class='social related'>Own box {i} of the article with more text</div><p>A licence line that many articles have.</p><div class='comments'>Someone said {i}</div></article><div>Legal words</div></body></html>"
    plain = "<html><body><div>Site bar</div><p>Text {i}</p><div>Legal words</div></body></html>"
    copy = "<html><body><main><div>First part of a copied article, long enough</div><div>Second part of a copied article, also long</div><p>End.</p></main></body></html>"
    rows = [(i, f"http://a.example/{i}", page.replace("{i}", str(i))) for i in range(8)] + [(100 + i, f"http://b.example/{i}", plain.replace("{i}", str(i))) for i in range(8)] + [(200 + i, f"http://c.example/{i}", copy) for i in range(6)]
    got = {r.page_id: r.text for r in templates.query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        assert got[i] == f"Own words {i} about sharing.\nOwn box {i} of the article with more text\nA licence line that many articles have."
        assert got[100 + i] == f"Text {i}"
        assert templates.main_text(templates.parse(rows[i][2]), set()) != got[i] and templates.main_text(templates.parse(rows[8 + i][2]), set()) != got[100 + i]
    assert {got[200 + i] for i in range(6)} == {"First part of a copied article, long enough\nSecond part of a copied article, also long\nEnd."}


# 6, 7


@pytest.mark.parametrize("which", ["words", "bytes"])
def test_substring_dedup(docs, which, monkeypatch):
    module, length = (automaton, 35) if which == "words" else (suffixes, 400)
    parts = lambda t: corpus.words(t) if which == "words" else (t or "").encode()
    key = tuple if which == "words" else bytes
    rows = [(r.doc_id, parts(r.text)) for r in docs.collect()]
    seen = collections.Counter(key(u[p : p + length]) for _, u in rows for p in range(len(u) - length + 1))
    want = []
    for i, u in rows:
        gone = np.zeros(len(u), bool)
        for p in range(len(u) - length + 1):
            if seen[key(u[p : p + length])] > 1:
                gone[p : p + length] = True
        kept = b" ".join(x for x, g in zip(u, gone, strict=True) if not g) if which == "words" else bytes(x for x, g in zip(u, gone, strict=True) if not g)
        want.append((i, len(u), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    for big in (module.BIG_GROUP, 1):  # also with every group cut into slices
        monkeypatch.setattr(module, "BIG_GROUP", big)
        frame = module.query(docs)
        got = [(r[0], r[1], r[2], r.kept_sha256) for r in frame.collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert any(w[2] for w in want)


def test_repeated_passages_go_from_400_bytes_on(spark):
    """A passage that repeats across documents is judged by its bytes, not by its words: one of 399 stays whole, of 400 all goes; all columns."""
    rng = random.Random(11)
    some = lambda n, k, letters: " ".join("".join(rng.choice(letters) for _ in range(k)) for _ in range(n))
    short, long, wide = some(70, 5, "abcdefghij")[:399], some(70, 5, "abcdefghij")[:400], some(58, 3, "äéßü")
    assert all(len(x.split()) > 50 for x in (short, long, wide)) and len(wide.encode()) == 405
    texts = [f"A{short}A", f"B{short}B", f"C{long}C{some(90, 5, 'klm')}C{wide}C", f"D{long}D", f"E{wide}E", f"F{some(90, 5, 'nop')}F"]
    got = sorted(map(tuple, suffixes.query(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()))
    removed = [(0, 0), (0, 0), (805, 2), (400, 1), (405, 1), (0, 0)]
    assert got == [(i, len(t.encode()), *r, hashlib.sha256(t.replace(long, "").replace(wide, "").encode()).hexdigest()) for i, (t, r) in enumerate(zip(texts, removed, strict=True))]


def test_loser_tree_merges_with_common_prefixes():
    rng = np.random.default_rng(1)
    runs = [sorted(bytes(rng.integers(97, 99, rng.integers(0, 9)).tolist()) for _ in range(n)) for n in (5, 0, 17, 1, 30)]
    coded = [list(zip(*suffixes.front_code(r), strict=True)) if r else [] for r in runs]
    at, out, shared = [0] * len(runs), [], []
    for r, n in suffixes.merge(coded):
        out.append(runs[r][at[r]])
        shared.append(n)
        at[r] += 1
    assert out == sorted(x for r in runs for x in r)
    assert shared[1:] == [suffixes.common(a, b) for a, b in zip(out[:-1], out[1:], strict=True)]


def test_automaton_counts():
    text = "a b a b a c a b a".split()
    m = automaton.Automaton(3)
    m.add(text, 1)
    m.add("a b a".split(), 5)
    m.close()
    assert m.often(text) == [8, 1, 8, 1, 1, 1, 8]
    assert m.often("b a b a x a b".split()) == [1, 8, 0, 0, 0]


def test_automaton_decides(monkeypatch):
    """A shard's runs are those of the matching statistics, and another automaton gives others."""
    w = [b"w%d" % i for i in range(12)]
    held = [(1, 1, 1, 0, w[:8]), (2, 2, 1, 5, [b"x", *w[1:6], b"y"]), (3, 3, 2, 0, [b"z", b"a", b"b", b"c"]), (4, 4, 1, 0, [b"p", b"q", b"r", b"s"])]
    found = lambda: {r["b1"]: r["runs"] for r in automaton.decide(held, 4).to_pylist()}
    assert found() == {1: [1, 3], 2: [6, 8], 3: [0, 1]}
    for often, want in ((2, {1: [0, 5], 2: [5, 9], 3: [0, 1], 4: [0, 1]}), (0, {})):
        monkeypatch.setattr(automaton.Automaton, "often", lambda self, seq, often=often: [often] * max(len(seq) - self.least + 1, 0))
        assert found() == want


# 8


def test_packing(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    tokenizer.encode_special_tokens = True
    got = packing.query(docs).toPandas()
    want = []
    for r in docs.collect():
        ids = np.asarray([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        for piece, start in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[start : first if not piece else start + 1024]
            want.append((r.doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
    have = [(None if x.doc_id != x.doc_id else int(x.doc_id), x.piece, x.start, x.length, x.ids_crc32) for x in got.itertuples()]
    assert sorted(have, key=str) == sorted(want, key=str)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 1024


def test_fullest_combination():
    assert packing.fullest({5: 2, 3: 1}, 9) == {5: 1, 3: 1} and packing.fullest({4: 9}, 17) == {4: 4} and packing.fullest({}, 10) == {}
    rows, bins = packing.plan({700: 3, 324: 3, 1024: 2, 100: 4}, 1024)
    assert bins == 6 and rows[:, 2].min() >= 1


# 9


def test_classifier(spark):
    import random

    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["river", "stone", "mountain", "forest", "little", "walked", "the", "of"]) for _ in range(80))
    bad = lambda: " ".join(rng.choice(["BUY!!", "NOW!!", "$$$", "CLICK###"]) for _ in range(80))
    rows = [(i, good() if i % 3 else bad()) for i in range(300)] + [(1000, None), (1001, ""), (None, good()), (5, good())]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = neighbours.query(frame, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held) and np.mean([r.predicted == (r.doc_id % 3 > 0) for r in held]) > 0.95
    assert neighbours.query(frame, labels.where("quality = 9")).where("score <> 0.5").count() == 0


# 10


def test_near_duplicates(docs):
    got = {r.doc_id: r for r in sketch.query(docs).collect() if r.doc_id is not None}
    sets = {}
    for r in docs.collect():
        if r.doc_id is not None:
            w = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (r.text or "").encode()).split()
            sets[r.doc_id] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {i: (len(s), find(i)) for i, s in sets.items()} == {i: (r.n_shingles, r.component_id) for i, r in got.items()}
    assert sum(r.kept for r in got.values()) < len(got)


def test_sketch_estimates():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.85):
        n = 2000
        both = int(2 * n * share / (1 + share))
        x = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        a, b = x[:n], x[n - both : 2 * n - both]
        ra, rb = (sketch.registers(np.ascontiguousarray(s), np.asarray([0, n])) for s in (a, b))
        est = sketch.likely((ra > rb).sum(1), (ra < rb).sum(1), sketch.M, np.asarray([n], float), np.asarray([n], float))[0]
        assert abs(est - share) < 0.15
        assert (sketch.merge(ra, rb) == sketch.registers(np.unique(np.concatenate([a, b])), np.asarray([0, 2 * n - both]))).all()


# All


@pytest.mark.parametrize("run", [search.query, perplexity.query, mixing.query, lines.query, automaton.query, suffixes.query, packing.query, sketch.query], ids=lambda f: f.__module__.split(".")[-1])
def test_empty_table(empty, run):
    assert run(empty).count() == 0


def test_rows_of_one_id_are_told_apart_by_their_texts(spark):
    """Different texts under one id are documents of their own, also near rows without an id; nothing is lost or mixed up."""
    rng = random.Random(8)
    some = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(6)) for _ in range(n))
    a, b, c = some(60), some(60), some(60)
    rows = [(1, a), (1, b), (2, a), (3, b + " tail"), (None, c), (None, c), (None, a), (4, c + " end"), (4, c + " end")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = collections.Counter((r.doc_id, r.component_id, r.leader) for r in sketch.near_duplicates(frame, 3, 85).collect())
    assert got == {(1, 1, True): 2, (2, 1, False): 1, (3, 1, False): 1, (None, 4, False): 2, (None, 1, False): 1, (4, 4, True): 2}
    import corpus_pipeline

    kept = [tuple(r) for r in corpus_pipeline.near_dedup(spark, frame.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "1 as n_chars"), "").select("doc_id", "text").collect()]
    assert sorted(kept) == sorted([(1, a), (1, b), (4, c + " end")])
    texts = [(7, "one two three four\nsecond line of the first"), (7, "other words here\none two three four"), (8, "one two three four\nlast")]
    removed = {r.kept_sha256: r.n_removed for r in lines.query(spark.createDataFrame(texts, "doc_id long, text string"), 1, 5).collect()}
    # Of the two texts under id 7 the one of the smaller digest is the earlier.
    first, second = texts[:2] if spark.createDataFrame(texts[:2], "doc_id long, text string").selectExpr("text", "xxhash64(text) as t").orderBy("t").first().text == texts[0][1] else texts[1::-1]
    want = [first[1], "\n".join(x for x in second[1].split("\n") if x != "one two three four"), "last"]
    assert removed == {hashlib.sha256(x.encode()).hexdigest(): n for x, n in zip(want, (0, 1, 1), strict=True)}


def test_classifier_on_empty_tables(empty, spark):
    assert neighbours.query(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
