"""Pages with long text runs as media, against a plain reading of the same pages."""

import hashlib
from collections import Counter

import pytest

from tidemark.llm import media, queries


def plain(html, least):
    """[(position, kind, text, caption, n_bytes, sha256)] of a page by one loop."""
    out, caption = [], None
    for k, item in enumerate(media.parse(html or "")):
        text = item["text"]
        if item["kind"] == "media":
            out.append((k, "media", text, item["caption"], None, None))
        elif len(text) < least:
            caption = text
            out.append((k, "text", text, None, None, None))
        else:
            raw = text.encode()
            body = raw + b"\xff" * (-len(raw) % 576)
            out.append((k, "media", None, caption, len(raw), hashlib.sha256(body).hexdigest()))
    return out


def rows(df):
    return Counter((r["page_id"], r["position"], r["kind"], r["text"], r["caption"], r["n_bytes"], r["payload_sha256"]) for r in df.collect())


def test_whole_pages_table(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    wanted = Counter((r["page_id"], *x) for r in pages.collect() for x in plain(r["html"], 200))
    got = rows(queries.page_media(spark, small))
    assert got == wanted
    places = {p for _, p, kind, _, _, n, _ in got if kind == "media" and n}
    assert len(places) > 5 and len({c for _, _, _, _, c, n, _ in got if n}) > 5


ODD = [
    (1, None), (2, ""), (3, "plain"), (None, "<p>no id and long enough to be kept</p>"), (4, "<p>a</p><p>" + "long & <b>odd</b> &lt;text&gt; \"q\" 'a' " * 9 + "</p>"),
    (5, "<p>first long run without a caption before it</p><h1>Cap &amp; <i>tail</i></h1><p>second long run with a caption of its own</p><p>third long run has the same one as the second</p>"),
    (5, "<p>first long run without a caption before it</p>"), (6, "<img src='x.png' alt='a \"b\"'><p>" + "é" * 700_000 + "</p><img src='y.png'><img src='SHA256:ab'>"), (7, "<div><p>broken <figure><img src=z><figcaption>open"),
    (8, "<p>first long run without a caption before it</p>"), (9, " \n\t "), (9, " \n\t "),
]


@pytest.mark.parametrize("least", [1, 30, 10**9])
def test_odd_pages(spark, least):
    names = "page_id long, html string, k string, position int, text string, `a.b` string, __ string"
    odd = spark.createDataFrame([(*x, "k", 7, "t", "d", "u") for x in ODD], names)
    wanted = Counter((i, *x) for i, html in ODD for x in plain(html, least))
    assert rows(media.page_media(odd, least=least)) == wanted


def test_no_pages(spark):
    assert media.page_media(spark.createDataFrame([], "page_id long, html string")).collect() == []
