"""URL rules against a plain reading of every rule."""

import re

from loadcurve.llm.url_rules import judge_urls

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
         ("com", "/de/", "block"), ("a.b.c.com", "/de/x", "allow")]
URLS = [
    "https://example.org/es/1", "HTTP://WWW.Example.ORG/en/17?x=/en/1", "https://badexample.org/es/", "http://x.com/de/#a", None, "", "no scheme",
    "https://example.org", "https://example.org?/es/", "https://a.b.c.com/de/xyz", "https://z.a.b.c.com/de/x", "https://a.com/fr/://b.org/", "x://",
    "https://com/fr/", "https://example.org/ES/", "ftp://ü.example.org/en/1", "https://.org/", "https://example.org/es/1",
    "https://" + "l." * 3000 + "org/" + "p" * 50_000,
]


def plain(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_rules(spark):
    rows = [(i, u, "h", "p") for i, u in enumerate(URLS)] + [(None, URLS[0], None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    for chosen in (RULES, RULES[:1], []):
        rules = spark.createDataFrame(chosen, "host string, path string, action string")
        got = sorted(map(tuple, judge_urls(pages, rules).collect()), key=repr)
        assert got == sorted([(r[0], *plain(r[1], chosen)) for r in rows], key=repr)


def test_empty_table(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0


def test_hot_urls_and_many_rule_shapes(spark):
    urls = [None] * 300 + ["no scheme"] * 300 + ["https://www.example.org/es/1"] * 400 + URLS
    rows = list(enumerate(urls))
    rules = RULES + [(".".join("abcdefgh"[-k:]) + ".com", "/" + "p" * n, "block") for k in range(1, 9) for n in range(120)]
    pages = spark.createDataFrame(rows + [(None, "https://h.com/pppp/x")] * 50, "page_id long, url string")
    out = judge_urls(pages, spark.createDataFrame(rules, "host string, path string, action string"))
    got = sorted(map(tuple, out.collect()), key=repr)
    assert got == sorted([(i, *plain(u, rules)) for i, u in rows + [(None, "https://h.com/pppp/x")] * 50], key=repr)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("substring_index") < 5, "one expression for all shapes of rules"
    assert plan.count("__salt") > 0
