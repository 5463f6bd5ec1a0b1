"""URL rules against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from caderneta.llm import url_filter as U


def brute(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    stop = next((i for i, c in enumerate(rest[end:]) if c in "?#"), len(rest) - end)
    path = rest[end : end + stop]
    fit = [(len(h), len(p), v, h + p) for v, h, p in rules if h and host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fit:
        return host, path, None, "allow"
    best = max(fit)
    return host, path, best[3], best[2]


URLS = [
    None, "", "no scheme", "http://", "http:///x", "http://a.net", "http://a.net/", "HTTP://A.B.NET/en?x", "https://x.example.net/en/1", "https://example.net/en",
    "ftp://notexample.com/de/", "http://example.com/de/?q=://b/", "http://example.com/de#f", "http://u@example.com:80/de/", "http://org/fr/", "http://x.org/fr/é",
    "http://..com/de/", "http://example..com/de/", "a\nb://x.net/\n", "http://community/de/", "http://com.example/de/",
]


@pytest.mark.parametrize("seed", range(3))
def test_judge(spark, seed):
    r = random.Random(seed)
    labels, parts = ["a", "b", "com", "net", "example", "co"], ["/", "/de/", "/de", "/d", "/en/x/", ""]
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    if seed:
        rules = list({(h, p): (r.choice(["allow", "block"]), h, p) for h, p in ((".".join(r.choices(labels, k=r.randint(1, 3))), r.choice(parts)) for _ in range(60))}.values())
    urls = URLS + [f"http://{'.'.join(r.choices(labels, k=r.randint(1, 4)))}{r.choice(parts)}{r.choice(['', '1', '/x?y', '#z'])}" for _ in range(300)]
    df = spark.createDataFrame([(i, u, "z", "y") for i, u in enumerate([*urls, *urls[:30]])], "page_id long, url string, rule string, host string")
    got = {r["page_id"]: tuple(r)[1:] for r in U.judge(df, spark.createDataFrame(rules, U.RULE_SCHEMA)).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate([*urls, *urls[:30]])}


def test_odd_rules_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "http://a.b/c"), (1, "http://a.b/c"), (None, None)], "page_id long, url string")
    rules = spark.createDataFrame([("block", "b", "/c"), ("allow", "B", "/c"), (None, "a.b", None), ("block", None, "/"), ("block", "", "/")], U.RULE_SCHEMA)
    assert sorted((str(r["page_id"]), str(r["rule"]), r["verdict"]) for r in U.judge(df, rules).collect()) == [
        ("1", "b/c", "block"), ("1", "b/c", "block"), ("None", "None", "allow"),
    ]
    assert U.judge(df.limit(0), rules).count() == 0
    assert U.judge(df, rules.limit(0)).filter(F.col("verdict") == "allow").count() == 3


def test_long_urls_and_hosts_of_many_labels(spark):
    urls = ["http://x.example.com/de/" + "a" * 200_000 + str(i) for i in range(30)] + ["http://" + "a." * 20_000 + "net/x", "http://example.com/de/" + "b/" * 50_000]
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: tuple(r)[1:] for r in U.judge(df, spark.createDataFrame(rules, U.RULE_SCHEMA)).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}
