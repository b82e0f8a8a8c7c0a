from termloom.operators import crawl as C
from termloom.operators import html as H

PAGE = """<html><head><title> A
 b </title><base href="http://h.example/x/"><meta name="ROBOTS" content="noindex, NoFollow"><script>var t='<a href="no">';</script></head>
<body><h1>Top &amp; more</h1><p>text <a href="a.html#f">l</a><a href="/b">m</a><a href="a.html">again</a></p><noscript>off</noscript><img src="i.png"><frame src="f.html"></body></html>"""


def test_parse_page():
    p = H.parse_page("http://h.example/y/z.html", PAGE)
    assert p["title"] == "A b" and p["headlines"] == ["Top & more"] and p["robots"] == ["NOINDEX", "NOFOLLOW"]
    assert p["links"] == ["http://h.example/x/a.html", "http://h.example/b", "http://h.example/x/f.html"]
    assert p["refs"] == ["http://h.example/x/i.png"] and "off" not in p["text"] and "var" not in p["text"]
    assert H.parse_page(None, None)["title"] == "" and H.parse_page("http://h.example", "<<<")["links"] == []


def test_pages_to_documents(spark):
    pages = spark.createDataFrame([("http://h.example/a.html", "<title>T-1</title><body>x, y</body>", 1), ("http://h.example/b.html", PAGE, 2), (None, None, None)], "url string, html string, title int")
    parsed = H.parse_pages(pages)
    assert H.indexable(parsed).where("url is not null").count() == 1 and H.followed_links(parsed).count() == 0
    made = H.page_documents(H.indexable(parsed)).where("uri is not null").first()
    assert made["index"] == {"title": "T 1", "text": "x y"} and made["description"]["title"] == '"T-1"'
    names = parsed.where("url is not null").select(H.title_or_name()).collect()
    assert sorted(r[0] for r in names) == ["A b", "T-1"]


ROBOTS = "# c\nUser-agent: other\nDisallow: /\n\nUser-agent: *\nAllow: /open\nDisallow: /open/not\nDisallow: /shut\nDisallow:\n"


def test_robots(spark):
    rules = C.parse_robots(ROBOTS, "termloom")
    assert rules == [(0, True, "/open"), (1, False, "/open/not"), (2, False, "/shut"), (3, False, "")]
    assert C.parse_robots(ROBOTS, "other-1.0")[0] == (0, False, "/")
    table = spark.createDataFrame([("h.example", n, a, p) for n, a, p in rules], "host string, rule_no int, allow boolean, path string")
    asked = spark.createDataFrame([(u,) for u in ["http://h.example/open/not/x", "http://h.example/shut", "http://h.example/", "http://g.example/shut"]], "uri string")
    assert sorted(r["uri"] for r in C.allowed(asked, table).collect()) == ["http://g.example/shut", "http://h.example/", "http://h.example/open/not/x"]


def test_crawl(spark):
    links = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e"), ("e", None), ("e", "deny")], "url string, link string")
    seeds = spark.createDataFrame([("a",), (None,)], "uri string")
    levels = lambda **k: {r["uri"]: (r["level"], r["done"]) for r in C.crawl(seeds, links, C.CrawlConfig(**k)).collect()}
    assert levels(deny="deny") == {"a": (0, True), "b": (1, True), "c": (1, True), "d": (2, True), "e": (3, True)}
    assert levels(max_level=1) == {"a": (0, True), "b": (1, True), "c": (1, True)}
    assert levels(max_docs=2) == {"a": (0, True), "b": (1, True), "c": (1, False), "d": (2, False)}
    first = C.crawl(seeds, links, C.CrawlConfig(max_docs=2))
    again = C.crawl(seeds, links, C.CrawlConfig(deny="deny", per_round=1), state=first)
    assert {r["uri"]: r["done"] for r in again.collect()} == {u: True for u in "abcde"}


def test_crawl_of_all_levels(spark, tmp_path):
    from termloom import catalog

    ids = range(1, 2001)
    spark.createDataFrame([(r,) for r in ids], "record_id bigint").write.parquet(f"{tmp_path}/api_documents.parquet")
    levels, frontier = {}, {r for r in ids if r % 100 == 1}
    while frontier:
        levels |= dict.fromkeys(frontier, max(levels.values(), default=-1) + 1)
        frontier = {t for r in frontier if r in ids for t in (r * 3, r * 3 + 1, r // 2)} - levels.keys()
    got = {r["uri"]: (r["level"], r["done"]) for r in catalog.QUERIES["crawl_all"](spark, str(tmp_path)).collect()}
    assert got == {f"d{r}": (n, True) for r, n in levels.items()}
    assert max(levels.values()) > 6 and len(levels) > len(ids)
