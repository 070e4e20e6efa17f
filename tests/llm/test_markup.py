"""Texts of pages against the standard library's own parser."""

from html.parser import HTMLParser

import pytest

from evidentia.llm import warc

SF = "/root/testdata/sf0.001"
GONE = {"script", "style", "title", "textarea", *warc._WHOLE}
BLOCKS = set("address article aside blockquote br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())


class Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.inside = [], []

    def handle_starttag(self, tag, attrs):
        if tag in GONE:
            self.inside.append(tag)
        elif not self.inside and tag in BLOCKS:
            self.parts.append("\n")

    def handle_startendtag(self, tag, attrs):
        if not self.inside and tag in BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in self.inside:
            while self.inside.pop() != tag:
                pass
        elif not self.inside and tag in BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.inside:
            self.parts.append(" ".join(f"[{data}]".split())[1:-1])

    def text(self, page):
        self.feed(page)
        self.close()
        lines = (" ".join(x.split()) for x in "".join(self.parts).split("\n"))
        return "\n".join(filter(None, lines))


@pytest.mark.parametrize("page, text", [
    ('a <b x="1>2">bold</b>', "a bold"), ("<p title='a > b'>one<p data-x=\"/p>\">two", "one\ntwo"), ('<a href="x?a=1&b=2>3">link</a> after', "link after"),
    ("<p>1 < 2 and 3 > 2, x = \"a > b\"</p>", '1 < 2 and 3 > 2, x = "a > b"'), ("<img alt='>'>x", "x"), ('no end <b x="', 'no end <b x="'),
])
def test_a_tag_ends_behind_its_values(page, text):
    assert warc.plain_text(page) == text


def test_links_keep_values_with_angles():
    found = warc.about('<a href="/q?x=1>2">l</a>', "https://h.test/")
    assert found["Links"] == [{"path": "A@/href", "url": "/q?x=1>2", "absolute": "https://h.test/q?x=1>2"}]


def test_every_page_reads_as_the_parser_reads_it(spark):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    off = [k for k, html in pages if warc.plain_text(html or "") != Reader().text(html or "")]
    assert len(pages) >= 50 and not off
