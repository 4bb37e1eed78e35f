from litspark.llm import url_filter

RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:cut], rest[cut:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = rest[: min([rest.index(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: (len(r[1] + r[2]), len(r[1])), default=None)
    return host, path, best and best[1] + best[2], best[0] if best else default


URLS = [
    "http://a.example.org/es/1", "http://Example.ORG/en/12?x#y", "http://example.org/en/2", "http://org/",
    "http://org", "https://x.com/de/a", "https://x.com/fr/", "https://xcom/de/", "ftp://.com/de/", "no url", "", None,
    "http://a..example.org/es/é", "http://?q", "http://x.com/de/a://b.org/", "HTTP://x.com#/de/", "http://ex\nample.org/es/",
]


def test_against_brute_force(spark):
    rows = [(i % 12, u) for i, u in enumerate(URLS * 2)] + [(None, "http://a.org/x"), (7, "http://a.org/x")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' AS host", "'y' AS rule")
    found = url_filter.filter_urls(pages, url_filter.rules_table(spark, RULES)).collect()
    want = [(i, *brute(u, RULES)) for i, u in rows]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_rule_precedence_and_nulls(spark):
    rules = spark.createDataFrame(
        [("allow", "a.b", "/"), ("block", "a.b", "/"), ("block", "b", "/x/"), (None, "b", "/"), ("block", None, "/")],
        "verdict string, host string, path string",
    )
    pages = spark.createDataFrame([(1, "x://a.b/x/y"), (2, "x://c.b/q")], "page_id long, url string")
    found = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert found == {1: ("a.b/", "block"), 2: (None, "allow")}


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "x://a.b/")], "page_id long, url string")
    none = url_filter.rules_table(spark, [])
    assert [r.verdict for r in url_filter.filter_urls(pages, none, default="block").collect()] == ["block"]
    assert url_filter.filter_urls(pages.limit(0), url_filter.rules_table(spark, RULES)).count() == 0


def test_plan_is_native(spark):
    pages = spark.createDataFrame([(1, "x://a.b/")], "page_id long, url string")
    plan = url_filter.filter_urls(pages, url_filter.rules_table(spark, RULES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
