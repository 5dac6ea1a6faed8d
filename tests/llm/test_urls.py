import random

import pytest

from salesloom.llm import urls

RULES = urls.RULES + [("a.b.example.org", "/", "block"), ("example.org", "/es/x", "allow"), ("example.org", "/es/", "allow"),
                      ("b,c.org", "/q", "block"), ("com", "", "allow"), (None, "/", "block"), ("net", None, "block"),
                      ("Example.NET", "/en/", "block"), ("org", "/é", "block")]


def brute(url, rules, otherwise="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    stop = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    host, path = fold(rest[:stop]), rest[stop:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h, p, v) for h, p, v in ((fold(h), p, v) for h, p, v in rules if h is not None and p is not None)
            if (host == h or host.endswith("." + h)) and path.startswith(p) and host]
    best = max(fits, default=None)
    return host, path, best[1] + best[2] if best else None, best[3] if best else otherwise


def given():
    rng = random.Random(8)
    hosts = ["org", "example.org", "EXAMPLE.org", "a.b.example.org", "x.a.b.example.org", "notexample.org", "com", "x.com",
             "xcom", "b,c.org", "y.b,c.org", "c.org", "example.net", "a..org", "", "example.org.", "x.com:80", "é.org", "host"]
    paths = ["", "/", "/es/", "/es/x", "/es", "/en/1", "/en/12", "/en/2", "/fr/a", "/de/", "/é/1", "/q", "//", "/es/?a=/en/1",
             "?x", "#y", "/es/x#/fr/", "/fr", "/a b", "/x\ny?"]
    out = [rng.choice(["http", "HTTPS", ""]) + "://" + h + p for h in hosts for p in paths]
    return out + [None, "", "nothing", "example.org/es/", "http:/example.org/", "http://a://b/", "://"] + ["http://example.org/es/"] * 300


@pytest.mark.parametrize("rules", [RULES, urls.RULES, RULES[:1], []])
def test_judge_equals_brute_force(spark, rules):
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(given())], "page_id long, url string, _key string").repartition(3)
    table = spark.createDataFrame(rules + rules[:2], "host string, path string, verdict string")
    got = urls.judge(pages, table).collect()
    assert len(got) == len(given())
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(r.url, rules)


def test_empty_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string")).count() == 0


def test_plan_has_no_python(spark):
    from salesloom.llm.queries import op4_chat_formatting, op8_url_filters
    for query in (op4_chat_formatting, op8_url_filters):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
