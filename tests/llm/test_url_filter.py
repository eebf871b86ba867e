import random

import pytest
from pyspark.sql import functions as F

from stratalake.llm import url_filter

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:end]


def expected(url, rules, otherwise="allow"):
    host, path = parts(url)
    fitting = []
    for rule, verdict in rules:
        rule_host, slash, rest = rule.partition("/")
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(slash + rest):
            fitting.append((len(rule), len(rule_host), verdict, rule))
    if not fitting:
        return host, path, None, otherwise
    _, _, verdict, rule = max(fitting)
    return host, path, rule, verdict


ODD_URLS = [
    None, "", "example.org/es/", "://", "http://", "http://org", "http://org/", "https://EXAMPLE.Org/es/x?y#z", "http://example.org/en/12", "http://example.org/en/2",
    "http://notexample.org/es/", "http://a.b.example.org/es/", "http://x.com/fr/", "http://x.com/de/1", "http://com/de/", "http://.org/", "http://org./", "http://ÄÖ.org/É?",
    "a://b://org/", "http://x.net#org/", "http://x.net?://org/", "http://example.org:80/es/", "http://x\ny.org/\n/z", "http://" + "a." * 5000 + "org/" + "x" * 50_000, "http://x.com/de", "http://😀.org/😀",
]


@pytest.mark.parametrize("blocks", [None, 1])
def test_against_every_rule(spark, blocks):
    rng = random.Random(3)
    labels = ["a", "b", "org", "com", "example", "x-1"]
    hosts = [".".join(rng.choices(labels, k=rng.randint(1, 4))) for _ in range(60)]
    paths = ["", "/", "/e", "/es/", "/en/1", "/en/12", "/de/", "/de/x/y", "/é/"]
    more = list({f"{rng.choice(hosts)}{rng.choice(paths)}": rng.choice(["allow", "block"]) for _ in range(80)}.items())
    rules = [*RULES, *(r for r in more if r[0] not in dict(RULES))]
    urls = [*ODD_URLS, *(f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q', '#f', 'more'])}" for _ in range(600))]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.judge(pages, spark.createDataFrame(rules, "rule string, verdict string"), blocks=blocks).collect()
    assert len(got) == len(urls)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: expected(u, rules) for i, u in enumerate(urls)}


def test_repeats_nulls_clashes_and_empty_tables(spark):
    rules = spark.createDataFrame([("ORG/", "allow"), ("org/", "block"), (None, "block"), ("com/", None), ("b.c", "block"), ("c/d", "allow")], "rule string, verdict string")
    pages = spark.createDataFrame([(None, "http://org/"), (1, "http://org/"), (1, "http://org/"), (2, "http://com/"), (3, "http://b.c/d")], "page_id long, url string")
    clashing = pages.selectExpr("*", "'h' as host", "1 as rule", "2 as block", "3 as key", "4 as w0", "5 as key_host", "6 as rule_host", "7 as best")
    got = url_filter.judge(clashing, rules)
    assert sorted((r.page_id or 0, r.host, r.rule, r.verdict, r.block, r.w0, r.best) for r in got.collect()) == [
        (0, "org", "org/", "block", 2, 4, 7), (1, "org", "org/", "block", 2, 4, 7), (1, "org", "org/", "block", 2, 4, 7), (2, "com", None, "allow", 2, 4, 7),
        (3, "b.c", "b.c", "block", 2, 4, 7),  # as long as c/d, with the longer host
    ]
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {(r.rule, r.verdict) for r in url_filter.judge(pages, rules.limit(0), otherwise="block").collect()} == {(None, "block")}


def test_filter_passes_all_listed_keys_and_few_others(spark):
    listed = spark.range(20_000).select(F.concat(F.lit("h"), "id").alias("host"), F.lit("/").alias("path"))
    blocks = 20_000 * url_filter.BITS_PER_RULE // 256
    bloom = url_filter.bloom_blocks(listed, blocks)
    assert bloom.count() <= blocks
    asked = spark.range(40_000).select("id", F.concat(F.lit("h"), "id").alias("key_host"), F.lit("/").alias("key_path"))
    passed = url_filter.might_be_listed(asked, bloom, blocks)
    assert passed.where("id < 20000").count() == 20_000
    assert passed.where("id >= 20000").count() < 400


def test_plan_has_no_python(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = url_filter.judge(pages, spark.createDataFrame(RULES, "rule string, verdict string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
