"""Where a lookup finds its document: pages and documents fetched before, by hand."""

from evidentia.operators import retrieval

PDF, HTML = "application/pdf", "text/html; charset=utf-8"
LINKS = "".join(f'<a href="/d{k}.pdf">x</a>' for k in range(12))
FETCHED = [
    ("https://a.test/1", 200, PDF, None, None), ("https://a.test/2", 200, "binary/octet", "https://a.test/real.PDF#p2", None), ("https://a.test/3", 200, HTML, "https://b.test/p", '<a href="/x.pdf">a</a><a href="https://c.test/y.pdf?z">b</a>'),
    ("https://b.test/x.pdf", 404, PDF, None, None), ("https://c.test/y.pdf?z", 200, PDF, "https://c.test/final", None), ("https://a.test/4", 500, PDF, None, None), ("https://a.test/5", 200, None, None, "<a href='/q.pdf'>"),
    ("http://10.0.0.1/s.pdf", 200, PDF, None, None), ("https://a.test/6", 200, HTML, None, LINKS), ("https://a.test/d9.pdf", 200, PDF, None, None), ("https://a.test/7", 200, HTML, None, LINKS + '<a href="/d7.pdf">'), ("https://a.test/d7.pdf", 200, PDF, None, None),
]


def inspected(spark, urls):
    responses = spark.createDataFrame(FETCHED, "url string, status int, content_type string, final_url string, html string")
    return retrieval.inspected(spark.createDataFrame(list(enumerate(urls)), "k long, url string"), responses, ["k"])


def test_candidates(spark):
    urls = [f"https://a.test/{k}" for k in (1, 2, 3, 4, 5, 6)] + ["http://10.0.0.1/s.pdf", "https://never.test/", None, "https://a.test/1"]
    got = [(r.pdf_url, r.source_url) for r in sorted(inspected(spark, urls).collect())]
    first = ("https://a.test/1", "https://a.test/1")
    assert got == [
        first, ("https://a.test/real.PDF#p2", "https://a.test/2"), ("https://c.test/final", "https://b.test/p"),  # its first link is dead
        (None, None), (None, None), ("https://a.test/d7.pdf", "https://a.test/6"),  # the eighth link; the tenth is beyond what is followed
        (None, None), (None, None), (None, None), first,
    ]


def test_a_refused_search_ends_the_lookup(spark):
    rows = [
        (1, 0, 1, None), (1, 1, 2, "b"), (1, 1, 1, None), (1, 2, 1, "c"), (2, 1, 1, None), (2, 2, 1, "late"), (3, 0, 5, "direct"), (4, 1, 13, "beyond"), (5, 1, 1, "x"), (5, 1, 1, None),
    ]
    tried = spark.createDataFrame([(*r, r[3]) for r in rows], "k long, tier int, rank int, pdf_url string, source_url string")
    searches = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, False), (2, 2, True), (3, 1, True), (4, 1, False), (6, 1, True), (5, 1, None)], "k long, tier int, blocked boolean")
    got = {r.k: (r.pdf_url, r.search_blocked) for r in retrieval.located(tried, searches, "k").collect()}
    assert got == {1: ("b", False), 2: (None, True), 3: ("direct", False), 4: (None, False), 5: ("x", False), 6: (None, True)}
