"""Verdicts against a loop over all rules."""

import random
import re

from relata.llm import url_rules as u


def plain(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest).group()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
        path = re.match(r"[^?#]*", rest[len(raw) :]).group()
    fit = [(-len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *((min(fit)[1:]) if fit else (None, default)))


URLS = [None, "", "net/", "http://net", "http://net/", "http://a.net/x?y=/en/", "https://example.net/en/", "http://x.EXAMPLE.net/en/1#a", "http://example.net/en", "http://badexample.net/en/", "http://example.net.org/fr/", "http://example.com/de/1", "http://example.com/de", "http://É.example.com/de/x", "http://org/fr/", "://org/fr/x", "http://a://net/", "http://example.com:80/de/", "http://u@example.com/de/\n", "http://example.com?/de/", "http://x.io/p.q(r)/s", "http://x.io/p_q(r)/s", "http://x.io/p.q(r)st"]
RULES = [*u.RULES, ("block", "x.io", "/p.q(r)"), ("allow", "x.io", "/p.q(r)/"), ("block", "io", "/p"), ("allow", "once.org", ""), ("block", "net", "/a/b/c/d/")]


def test_against_a_loop(spark):
    rng = random.Random(1)
    urls = URLS + [f"{rng.choice(['http', 'ftp'])}://{rng.choice(['', 'a.', 'b.example.'])}{rng.choice(['net', 'example.net', 'org', 'once.org', 'io', 'x.io', 'Example.COM'])}{rng.choice(['', '/', '/en/', '/de/z', '/fr/', '/a/b/c/d/e', '/p.q(r)/', '/pp'])}{rng.choice(['', '?q', '#f'])}" for _ in range(200)]
    pages = [(i, x) for i, x in enumerate(urls)] + [(0, "http://net/"), (None, "http://net/")]
    for rules, default in ((RULES, "allow"), (list(u.RULES), "block"), ([("block", "", "")], "allow")):
        got = u.verdicts(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(rules, u.RULE_SCHEMA), default=default).collect()
        key = lambda r: tuple((x is not None, x) for x in r)
        if rules == [("block", "", "")]:
            assert not [r for r in got if r.host == "" and (r.verdict == "block") == (r.page_id == 0 and r.rule is None)]
            continue
        assert sorted(map(key, got)) == sorted(key((i, *plain(x, rules, default))) for i, x in pages)


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://net/", "x")], "page_id long, url string, verdict string")
    rules = spark.createDataFrame(list(u.RULES), u.RULE_SCHEMA)
    assert [r.verdict for r in u.verdicts(pages, rules.limit(0)).collect()] == ["allow"]
    assert u.verdicts(pages.limit(0), rules).count() == 0
