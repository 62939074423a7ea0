import random

from loomspark.llm import url_filter as U
from loomspark.llm.queries import URL_RULES


def plain(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url is not None and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best.host + best.path if best else None, best.verdict if best else default


def test_against_plain_version(spark):
    r = random.Random(1)
    hosts = ["example.org", "WWW.Example.ORG", "org", "a.b.c.example.com", "com", "xorg", "example.org:80", "", "..", "é.com", "net"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12/x", "/fr/1", "/de/", "/de", "/DE/x"]
    urls = [f"{r.choice(['http://', 'https://', '://', 'no-scheme/', 'a://b://'])}{r.choice(hosts)}{r.choice(paths)}{r.choice(['', '?q=/x', '#f?', '?'])}" for _ in range(400)]
    urls += [None, "", "://", "http://" + "x." * 3000 + "org/", "http://org/" + "y" * 5000]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {x["page_id"]: (x["__host"], x["__path"], x["__rule"], x["__verdict"]) for x in U.judge_urls(pages, U.rule_table(spark, URL_RULES)).collect()}
    assert got == {i: plain(u, URL_RULES) for i, u in enumerate(urls)}


def test_precedence_repeats_and_no_rules(spark):
    rules = [U.Rule("b.org", "/x", "allow"), U.Rule("org", "/xyz/", "block"), U.Rule("b.org", "/x", "block"), U.Rule(None, "/", "block")]
    pages = spark.createDataFrame([(1, "http://a.b.org/xyz/1"), (1, "http://a.b.org/xyz/1"), (2, "http://b.org/x")], "page_id long, url string")
    got = sorted((x["page_id"], x["__rule"], x["__verdict"]) for x in U.judge_urls(pages, U.rule_table(spark, rules)).collect())
    assert got == [(1, "org/xyz/", "block"), (1, "org/xyz/", "block"), (2, "b.org/x", "block")]
    assert {x["__verdict"] for x in U.judge_urls(pages, U.rule_table(spark, []), default="block").collect()} == {"block"}
    assert U.judge_urls(pages.where("false"), U.rule_table(spark, rules)).count() == 0


def test_plan_has_no_python(spark, sf_dir):
    from loomspark.llm.queries import op3_url_filter

    plan = op3_url_filter(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
