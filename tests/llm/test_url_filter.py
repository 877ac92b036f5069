import pytest

from reelspark.llm import url_filter as U

URLS = ["http://www.example.com/en/a?x#y", "https://Example.COM/en/", "http://example.com", "http://a.b.net/es/1", "http://net/fr/", "http://internet/es/", "ftp://x.com/", "no scheme", "", None, "http://example.com/en/", "http://example.com/en/", "http://x.org/en/#top", "://com/", "http://evil.com?/en/"]


def brute(url, rules, default):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, default))
    return host, path, rule, verdict


@pytest.mark.parametrize("blocks", [1, U.MAX_BLOCKS])
def test_rules_equal_brute_force(spark, blocks):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").selectExpr("*", "'h' as host", "1 as rule", "'x' as html")
    got = {r["page_id"]: tuple(r)[1:] for r in U.judge_urls(pages, U.rule_list(spark), max_blocks=blocks).collect()}
    assert got == {k: brute(u, U.RULES, "allow") for k, u in enumerate(URLS)}


def test_long_lists_and_no_list(spark):
    rules = [(f"site{k}.org", f"/{'x' * (k % 7)}", "block") for k in range(500)]
    urls = [f"http://a.site{k}.org/{'x' * (k % 5)}/z" for k in range(600)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: tuple(r)[1:] for r in U.judge_urls(pages, U.rule_list(spark, rules)).collect()}
    assert got == {k: brute(u, rules, "allow") for k, u in enumerate(urls)}
    assert {r["verdict"] for r in U.judge_urls(pages, U.rule_list(spark, []), default="block").collect()} == {"block"}
    assert U.judge_urls(pages.limit(0), U.rule_list(spark)).count() == 0


def test_rows_without_a_hit_are_not_shuffled(spark):
    """Only possible hits are exchanged: of 5,000 pages off the list none is, of 5,000 on it each is."""
    rules = U.rule_list(spark, [("listed.org", "/a", "block")])
    pages = spark.createDataFrame([(k, f"http://site{k}.net/x" if k % 2 else "no url") for k in range(5000)], "page_id long, url string")
    out = U.judge_urls(pages, rules)
    assert {r["verdict"] for r in out.collect()} == {"allow"} and out.count() == 5000
    listed = rules.select("host", "path")
    probes = U.probed(pages.selectExpr("page_id", "'www.listed.org' as host", "'/abc' as path"), U.bloom(listed, 1), U.rule_shapes(listed))
    assert probes.where("size(hits) = 1").count() == 5000 and "Exchange" not in probes._jdf.queryExecution().executedPlan().toString()


def test_filter_has_no_false_negatives(spark):
    keys = [(f"h{k}.com", f"/{k}") for k in range(3000)]
    made = U.bloom(spark.createDataFrame(keys, "host string, path string").repartition(4), 60)
    assert all((h + p).encode() in made for h, p in keys)
    assert sum(f"other{k}.org/{k}".encode() in made for k in range(3000)) < 600


def test_candidates_equal_all_suffixes_and_prefixes():
    shapes = {h: list(range(6)) for h in range(20)}
    got = set(U.candidates("a.b.com", "/x/y", shapes))
    assert got == {(h, "/x/y"[:k]) for h in ("a.b.com", "b.com", "com") for k in range(5)}
    assert list(U.candidates("", "", {0: [0]})) == [("", "")]


def test_odd_pages(spark):
    rows = [(None, "http://a.com/"), (None, "http://a.com/"), (1, None), (1, "http://b.net/es/1"), (2, "http://" + "x." * 3000 + "com/" + "y" * 50_000)]
    got = sorted((tuple(r)[3:] for r in U.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), U.rule_list(spark)).collect()), key=str)
    assert got == sorted([("com/", "allow"), ("com/", "allow"), (None, "allow"), ("net/es/", "block"), ("com/", "allow")], key=str)
