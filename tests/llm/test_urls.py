"""URL rules by Bloom cascades against a loop over all rules."""

import random

import pytest

from velum.llm import cascade

FIXED = [None, "", "net/", "://", "http://net", "http://net/", "HTTP://A.NET/x?y#z", "http://blog.x.example.net/en/1", "http://example.net/en", "http://example.net/en/", "http://myexample.net/en/x", "http://EXAMPLE.com/de/ä?b", "http://example.com/DE/", "https://a.org/fr/x://y.net/", "http://org/fr/", "http://x.net:80/a", "http://x.net./a", "http://..net/", "http://a.net?x=/", "http://a.net#/", "x" * 200_000 + "://a.net/" + "y" * 200_000]


def loop(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3 :] if url and at >= 0 else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:end].translate(str.maketrans(cascade.UPPER, cascade.LOWER)), rest[end:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [r for r in rules if (host == (h := r.partition("/")[0]) or host.endswith("." + h)) and path.startswith(r[len(h) :])]
    best = max(fits, key=lambda r: (len(r), len(r.partition("/")[0])), default=None)
    return host, path, best, rules[best] if best else cascade.UNLISTED


def frames(spark, n=400):
    rng = random.Random(4)
    part = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 2)))
    urls = FIXED + [f"http://{'.'.join(part() for _ in range(rng.randint(1, 4)))}/{'/'.join(part() for _ in range(rng.randint(0, 3)))}" for _ in range(n)]
    rules = {f"{'.'.join(part() for _ in range(rng.randint(1, 2)))}/{part() if rng.random() < 0.7 else ''}": rng.choice(["allow", "block"]) for _ in range(60)}
    rows = [(i, u, "h") for i, u in enumerate(urls)] + [(None, "http://a.net/", "h"), (3, "http://net/", "h"), (3, "http://net/", "h")]
    return spark.createDataFrame(rows, "page_id long, url string, host string").repartition(3), rows, rules


@pytest.mark.parametrize("most", [cascade.BROADCAST_BYTES, 0])
def test_verdicts_equal_a_loop(spark, most):
    """By filters and, where none may be broadcast, by the join; the given host column gives way."""
    pages, rows, rules = frames(spark)
    for these in (cascade.RULES, rules):
        got = cascade.judge(pages, these, most)
        assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted([(i, u, *loop(u, these)) for i, u, _ in rows], key=str)
    assert any(loop(u, rules)[2] for _, u, _ in rows)


def test_cascade_is_exact_over_its_universe(spark):
    """Several levels, no listed key lost and none of the other keys taken for one."""
    keys = cascade.hashed(spark.createDataFrame([(f"in{i}",) for i in range(300)], "key string"))
    others = cascade.hashed(spark.createDataFrame([(f"out{i % 20000}",) for i in range(20300)] + [("in7",)], "key string"))
    levels = cascade.build(keys, others, 20000)
    assert len(levels) > 2 and sum(level.bits for level in levels) < 300 * 24
    hashes = lambda f: [f.toArrow()[c].to_numpy().view("uint64") for c in ("h1", "h2")]
    assert cascade.listed(levels, *hashes(keys)).all()
    assert not cascade.listed(levels, *hashes(others.where("key like 'out%'"))).any()


def test_no_rules_no_pages(spark):
    pages, rows, _ = frames(spark, 5)
    assert {r.verdict for r in cascade.judge(pages, {}).collect()} == {cascade.UNLISTED}
    assert cascade.judge(pages.limit(0)).collect() == []
    assert cascade.judge(pages, {"q.zz/": "block"}).where("rule is not null").count() == 0
    with pytest.raises(ValueError):
        cascade.judge(pages, {"/x": "block"})
