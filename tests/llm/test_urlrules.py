import random

import pytest

from panelwise.llm import urlrules

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("b.example.org", "", "block"), ("com", "/de/", "block"), ("com", "/de/", "allow"), ("Big.NET", "/é", "block")]
URLS = [
    None, "", "no scheme", "http://example.org/es/1", "HTTP://EXAMPLE.ORG/es", "x://b.example.org?q", "x://a.b.example.org/es/9", "x://notexample.org/es/1",
    "x://a.com/de/1", "x://com/de/", "x://com/DE/", "x://big.net/éa", "x://org", "x://org#f", "x://org/://com/de/", "x://a\n.org/\nx", "://org/",
]


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        tail = rest[end:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len((h + p).encode()), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda f: (f[0], f[1], f[3] == "block"), default=None)
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("shard", [2_000_000, 2])
def test_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(urlrules, "SHARD_RULES", shard)
    rng = random.Random(1)
    parts = ["a", "org", "com", "example.org", "b.example.org", "big.net"]
    urls = URLS + [f"http://{rng.choice(['', 'w.', 'B.'])}{rng.choice(parts)}{rng.choice(['/', '/es/', '/de/x', '', '?a/de/'])}" for _ in range(300)]
    lower = [(h.lower(), p, v) for h, p, v in RULES]
    index = urlrules.build(spark.createDataFrame(RULES + [(None, "/", "block"), ("", "/", "block"), ("org", None, "block")], "host string, path string, verdict string"))
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id bigint, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.judge(pages, index).collect()}
    assert got == {i: brute(u, lower) for i, u in enumerate(urls)}


def test_collisions_are_confirmed(spark, monkeypatch):
    index = urlrules.build(spark.createDataFrame(RULES, "host string, path string, verdict string"))
    d = urlrules.Digests(index)
    assert [r for r, _ in d.match(["org", "org"], ["/", "x"])] == ["org/", None]
    monkeypatch.setattr(urlrules.xxhash, "xxh64_intdigest", lambda p, seed: int(d.shards[0][0][0]) % 2**64)
    assert sum(r is not None for r, _ in d.match(["zzz", "yyy"], ["/", "/es/"])) == 0


def test_no_rules_and_no_rows(spark):
    index = urlrules.build(spark.createDataFrame([], "host string, path string, verdict string"))
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id bigint, url string")
    assert [tuple(r) for r in urlrules.judge(pages, index).collect()] == [(1, "a.org", "/", None, "allow")]
    assert urlrules.judge(pages.where("false"), index).count() == 0
