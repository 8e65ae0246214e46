"""Evidence of content explanations against a plain loop, and the profile's signals."""

import re

from velum.functions import constants as K
from velum.operators import content, content_evidence

STOP = None


def score(text, kind, contribution):
    words = re.findall("[a-záéíóúüñ0-9]+", text)
    telling = [w for w in words if w not in STOP and not w.isdigit() and len(w) >= 2]
    idle = len(words) - len(telling)
    if text in K.SILENT_SIGNALS or text.isdigit() or len(text) < 3 or not telling or words[0] in STOP or words[-1] in STOP:
        return 0.0
    if (idle >= len(telling) and len(words) > 1) or (len(words) >= 5 and len(telling) <= 2):
        return 0.0
    out = contribution * K.SIGNAL_WEIGHTS.get(kind, K.SIGNAL_OTHER)
    out *= 0.72 if text in K.GENERIC_SIGNALS else 1
    out *= 1.18 if len(words) >= 2 and len(telling) >= 2 else 1
    out *= {"tag": 1.08, "keyword": 1.08, "genre": 0.92}.get(kind, 1)
    out *= max(0.45, 1 - idle / len(words) * 0.4)
    return out * (0.74 if len(words) >= 5 else 0.88 if len(words) == 4 else 1.05 if len(words) == 3 and len(telling) >= 2 else 1)


def plain(signals, genres, positive, negative):
    text = lambda s: " ".join(re.sub("^(genre|tag|keyword|text):", "", s).replace("_", " ").replace('"', " ").lower().split())
    kind = lambda s: m.group(1) if (m := re.match("(genre|tag|keyword|text):", s)) else "unknown"
    bad, good, best = {text(s) for s in negative}, {text(s) for s in positive}, {}
    rows = [(s, max(0.15, 1 - i * 0.08)) for i, s in enumerate(signals)] + [(f"genre:{g}", 0.65 if text(g) in good else 0.45) for g in genres]
    for s, c in rows:
        t = text(s)
        x = score(t, kind(s), c)
        if t and t not in bad and x > 0 and (t not in best or round(x, 9) > round(best[t][0], 9)):
            best[t] = (x, kind(s))
    found = sorted(((t, k, x) for t, (x, k) in best.items()), key=lambda r: (-round(r[2], 9), r[0]))[:6]
    own, avoided = {text(s) for s in signals}, []
    for t in map(text, negative):
        if t and t not in own and t not in avoided:
            avoided.append(t)
    return found, avoided[:2]


CASES = {
    1: (["tag:space_opera", "keyword:robot", "genre:action", "tag:robot", "text:of_the_ring", "keyword:sequel", "text:a", "tag:42"], ["Action", "Science Fiction"], ["genre:science_fiction"], ["tag:slow", "tag:slow", "keyword:gore", "text:dull plot"]),
    2: (["tag:robot", "keyword:time travel", "text:long walk home tonight", "text:five whole words stand here"], ["Drama"], [], ["keyword:time_travel"]),
    3: ([], ["Comedy", ""], ["genre:comedy"], []),
    4: (["other", "tag:Big_City"] + [f"tag:thing{i}" for i in range(14)], [], [], []),
}


def test_evidence_equals_a_loop(spark):
    global STOP
    STOP = set(content_evidence.stop_words())
    rows = spark.createDataFrame([(k, 10 + k, c[0], c[1]) for k, c in CASES.items()] + [(9, 1, None, None)], "requestId long, movieId long, signals array<string>, genres array<string>")
    profiles = spark.createDataFrame([(k, c[2], c[3]) for k, c in CASES.items()], "requestId long, positive array<string>, negative array<string>")
    found, avoided = content_evidence.evidence(rows, profiles)
    got, left = {}, {r.requestId: r.avoided for r in avoided.collect()}
    for r in sorted(found.collect(), key=lambda r: (r.requestId, r.place)):
        got.setdefault(r.requestId, []).append((r.display, r.source, round(r.score, 9)))
    for k, c in CASES.items():
        want, spared = plain(*c)
        assert got.get(k, []) == [(t, s, round(x, 9)) for t, s, x in want]
        assert left[k] == spared
    assert 9 not in got and left[9] == []


def test_profile_signals_show_each_text_once(spark):
    rows = [(1, "positive", "userTags:robot", 0.5), (1, "positive", "keywords:robot", 0.6), (1, "positive", "context:1990s", 0.9), (1, "negative", "genres:War", 0.4), (1, "combined", "genres:War", 0.7), (1, "positive", "genres:Drama", -0.2)]
    got = content.signals(spark.createDataFrame(rows, "requestId long, kind string, feature string, weight double")).collect()
    assert sorted((r.kind, r.rank, r.display, r.feature) for r in got) == [("negative", 1, "War", "genres:War"), ("positive", 1, "robot", "keywords:robot"), ("positive", 2, "1990s", "context:1990s")]
