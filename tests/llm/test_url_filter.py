from pyspark.sql import functions as F

from phrasemine.llm.url_filter import RULES, host_and_path, listed_urls, url_keys

URLS = [
    None, "", "no scheme", "http://", "http:///path", "https://A.NET", "https://A.NET/", "http://www.example.net/en/1?x=/de/",
    "http://example.net/en", "http://example.net.evil.com/en/", "http://notexample.net/en/", "http://x.example.com/de/a#b",
    "http://example.com?q=/de/", "http://b.org/fr/", "http://b.org/FR/", "ftp://net/", "x://y://z.net/p", "http://É.net/ü",
    "http://a..net/", "http://b.org/fr/",
]


def judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = []
    for rule, action in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, action))
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def run(spark, rules, urls):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    host, path = host_and_path(F.col("url"))
    pages = pages.withColumns({"host": host, "path": path, "rule": F.lit("clash"), "cut": F.lit(7), "length": F.lit(8)})
    rows = listed_urls(pages, spark.createDataFrame(rules, "rule string, action string")).collect()
    return {r.page_id: (r.host, r.path, r.rule, r.action) for r in rows}


def test_rules(spark):
    assert run(spark, RULES, URLS) == {k: judge(u, RULES) for k, u in enumerate(URLS)}


def test_a_long_listing(spark):
    rules = [(f"h{k}.com/{'a/' * (k % 4)}", "block") for k in range(3000)] + [("com/", "allow"), ("com/", "block")]
    urls = [f"http://s{k % 3}.h{k * 7 % 4000}.com/a/a/{k}" for k in range(500)] + URLS
    expected = {k: judge(u, [r for r in rules if r != ("com/", "block")]) for k, u in enumerate(urls)}
    assert run(spark, rules, urls) == expected


def test_empty(spark):
    assert run(spark, RULES, []) == {}
    nothing = spark.createDataFrame([], "rule string, action string")
    pages = spark.createDataFrame([("a.net", "/")], "host string, path string")
    assert [tuple(r) for r in listed_urls(pages, nothing).collect()] == [("a.net", "/", None, None)]


def test_long_hosts_make_keys_of_listed_lengths_only():
    host = "a." * 50000 + "example.net"
    assert url_keys(host, "/en/x", [(3, 1), (11, 4), (12, 1), (0, 1)]) == ["net/", "example.net/en/"]
    assert url_keys("net", "", [(3, 0), (3, 1), (4, 0)]) == ["net"] and url_keys("a.", "/", [(0, 1)]) == ["/"]
