"""Interleaved document sequences: HTML with media references, payloads resolved by digest.

A page is parsed into an ordered list of items: text runs and media references, each with
its position and, for media, its digest and caption. Payloads live in a media store keyed by
the sha256 of their bytes and are found again by a join on the digest, so positions and
captions stay with the item whatever the join does to the order of rows.

Stored form: an 8-bit grey image, binary PGM (`P5`), one sample a byte, 24 samples wide. A
payload is padded with bytes 255 to a positive multiple of 576, a tile of 24 by 24.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, lean
from tidemark.scratch import ensure_importable, table

TILE, SIDE, PAD = 576, 24, 255
#: Scheme of the references to payloads in the store.
SCHEME = "sha256:"
ITEMS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
_HEADER = re.compile(rb"P5\s+(\d+)\s+(\d+)\s+255\s")
_BLOCKS = {"p", "div", "li", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "blockquote", "pre", "br", "tr"}
_SILENT = {"script", "style", "noscript", "template"}
_VOID = {"br", "img", "hr", "meta", "link", "input", "source", "area", "base", "col", "embed", "track", "wbr"}


def payload(text: bytes) -> bytes:
    n = max(1, -(-len(text) // TILE)) * TILE
    return text + bytes([PAD]) * (n - len(text))


def to_image(samples: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (SIDE, len(samples) // SIDE) + samples


def from_image(stored: bytes) -> bytes:
    found = _HEADER.match(stored)
    if not found or int(found[1]) * int(found[2]) != len(stored) - found.end():
        raise ValueError("not an 8-bit grey image")
    return stored[found.end() :]


def image_feature(samples: bytes) -> str:
    """Rows, mean and spread of the samples, and the mean of each of the tile's four quarters."""
    x = np.frombuffer(samples, np.uint8).reshape(-1, SIDE)
    half = len(x) // 2
    quarters = [x[:half, : SIDE // 2], x[:half, SIDE // 2 :], x[half:, : SIDE // 2], x[half:, SIDE // 2 :]]
    numbers = [x.mean(), x.std(), *[q.mean() for q in quarters]]
    return f"{len(x)};" + ";".join(f"{v:.3f}" for v in numbers)


class _Sequence(HTMLParser):
    """Text runs and media references of a page in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.silent = 0
        self.figures: list[list] = []  # media items of each open figure
        self.caption: list[str] | None = None

    def _close_run(self):
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in _SILENT:
            self.silent += 1
        elif tag == "figure":
            self._close_run()
            self.figures.append([])
        elif tag == "figcaption":
            self._close_run()
            self.caption = []
        elif tag in ("img", "audio", "video", "source", "embed") and attrs.get("src"):
            self._close_run()
            src = attrs["src"]
            digest = src[len(SCHEME) :].lower() if src.startswith(SCHEME) else None
            item = {"kind": "media", "text": None if digest else src, "digest": digest, "caption": attrs.get("alt") or attrs.get("title")}
            self.items.append(item)
            if self.figures:
                self.figures[-1].append(item)
        elif tag in _BLOCKS:
            self._close_run()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in _SILENT:
            self.silent -= 1

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for item in self.figures[-1] if self.figures else []:
                item["caption"] = text or item["caption"]
            self.caption = None
        elif tag == "figure":
            self._close_run()
            if self.figures:
                self.figures.pop()
        elif tag in _BLOCKS:
            self._close_run()

    def handle_data(self, data):
        if not self.silent:
            (self.run if self.caption is None else self.caption).append(data)


def parse(html: str) -> list[dict]:
    parser = _Sequence()
    parser.feed(html)
    parser.close()
    parser._close_run()
    return [{"position": k, **item} for k, item in enumerate(parser.items)]


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id_col, items) of each page: ordered structs (position, kind, text, digest, caption).

    Media whose address does not have the store's scheme keep the address in text and have
    no digest. A null or empty page has no items; broken markup is read as far as it goes.
    """
    ensure_importable(pages.sparkSession)
    id_type = pages.schema[id_col].dataType.simpleString()
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "html"):
                items = pa.array([parse(x or "") for x in part.column("html").to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([part.column("k"), items], names=["k", "items"])

    got = pages.select(F.col(id_col).alias("k"), F.col(html_col).alias("html")).mapInArrow(run, f"k {id_type}, items {ITEMS}")
    return got.withColumnRenamed("k", id_col)


def references(sequenced: DataFrame, id_col: str) -> DataFrame:
    """One row (id_col, position, digest, caption) for each resolvable media reference."""
    items = sequenced.select(F.col(id_col).alias("k"), F.explode("items").alias("i")).where(F.col("i.digest").isNotNull())
    return items.select(F.col("k").alias(id_col), "i.position", "i.digest", "i.caption")


def resolve(sequenced: DataFrame, store: DataFrame, id_col: str = "page_id") -> DataFrame:
    """References joined with the store's columns by digest; unknown digests keep their place with nulls.

    The store has one row a digest (see one_each). A digest that many references share is on
    the side of the join that Spark can split.
    """
    taken = [F.col(c) for c in store.columns if c != "digest"]
    refs = references(sequenced, id_col)
    found = store.select(F.col("digest").alias("s_digest"), F.struct(*taken).alias("s"))
    return refs.join(found, F.col("digest") == F.col("s_digest"), "left").select(id_col, "position", "digest", "caption", "s.*")


def one_each(store: DataFrame) -> DataFrame:
    """The store with one row a digest, as a scratch table; equal digests hold equal bytes, so any row will do."""
    taken = [c for c in store.columns if c != "digest"]
    return table(store.groupBy("digest").agg(F.first(F.struct(*taken)).alias("s")).select("digest", "s.*"), "media-store")


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Media store and pages of documents whose texts are kept as 8-bit media.

    Returns (store, pages): store rows (digest, media) hold each distinct payload of a batch
    once; a page (doc_id, html) has a heading, a figure whose image refers to the payload by
    digest, with a caption that tells its bytes, and a closing line. A null text counts as
    empty.
    """
    ensure_importable(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for part in chunks(batch, "text"):
                digests, media, pages, seen = [], [], [], set()
                for text in part.column("text").to_pylist():
                    raw = (text or "").encode()
                    body = payload(raw)
                    digest = hashlib.sha256(body).hexdigest()
                    pages.append(f'<article><h1>Text</h1><figure><img src="{SCHEME}{digest}"><figcaption>{len(raw)} bytes</figcaption></figure><p>End</p></article>')
                    digests.append(digest)
                    media.append(None if digest in seen else to_image(body))
                    seen.add(digest)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(digests, pa.string()), pa.array(media, pa.binary()), pa.array(pages, pa.string())],
                    names=["doc_id", "digest", "media", "html"],
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kept = table(rows.mapInArrow(write, f"doc_id {id_type}, digest string, media binary, html string"), "media")
    return kept.where(F.col("media").isNotNull()).select("digest", "media"), kept.select("doc_id", "html")


def describe(store: DataFrame) -> DataFrame:
    """(digest, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) read from stored bytes."""
    ensure_importable(store.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for stored in batch.column("media"):
                stored = stored.as_py()
                body = from_image(stored)
                # no byte of UTF-8 is 255, so what stands before the padding is the text
                rows.append((len(body.rstrip(bytes([PAD]))), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), image_feature(body)))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                names=["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return store.select("digest", "media").mapInArrow(
        read, "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, ..., feature, position, caption) of every whole text kept as media.

    Texts go to the store, their pages are parsed, and each page's reference is joined by
    digest with what the stored bytes give. The columns are computed once for each stored
    row before the join, so a text with a third of all rows as copies costs only small rows.
    Repeated rows and equal texts get equal values; a null text counts as empty; an empty
    table gives an empty result.
    """
    store, pages = store_texts(docs, id_col, text_col)
    found = one_each(describe(store))
    seen = resolve(sequences(pages, "doc_id", "html"), found, "doc_id")
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption"]
    return seen.select("doc_id", *names)


def illustrate(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = 200) -> tuple[DataFrame, DataFrame]:
    """Media store and pages of pages whose long text runs are kept as 8-bit media between the short ones.

    A run of at least least characters becomes a figure at its place, with the nearest short
    run before it as its caption, if there is one; short runs stay text, and media that the
    page refers to already stay as they are. Returns (store, pages): a store row (digest,
    media) for each long run, equal ones included, and (id_col, html).
    """
    ensure_importable(pages.sparkSession)
    id_type = pages.schema[id_col].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for part in chunks(batch, "html"):
                digests, media, pages_ = [], [], []
                for page in part.column("html").to_pylist():
                    out, own, images, caption = [], [], [], None
                    for item in parse(page or ""):
                        text = item["text"]
                        if item["kind"] == "media":
                            src = text if item["digest"] is None else SCHEME + item["digest"]
                            alt = "" if item["caption"] is None else f' alt="{escape(item["caption"])}"'
                            out.append(f'<img src="{escape(src)}"{alt}>')
                        elif len(text) < least:
                            caption = text
                            out.append(f"<p>{escape(text)}</p>")
                        else:
                            body = payload(text.encode())
                            own.append(hashlib.sha256(body).hexdigest())
                            images.append(to_image(body))
                            below = "" if caption is None else f"<figcaption>{escape(caption)}</figcaption>"
                            out.append(f'<figure><img src="{SCHEME}{own[-1]}">{below}</figure>')
                    digests.append(own)
                    media.append(images)
                    pages_.append(f"<article>{''.join(out)}</article>")
                yield pa.RecordBatch.from_arrays(
                    [part.column("k"), pa.array(digests, pa.list_(pa.string())), pa.array(media, pa.list_(pa.binary())), pa.array(pages_, pa.string())], names=["k", "digests", "images", "html"]
                )

    rows = pages.select(F.col(id_col).alias("k"), F.col(html_col).alias("html"))
    kept = table(rows.mapInArrow(write, f"k {id_type}, digests array<string>, images array<binary>, html string"), "page-media")
    images = kept.select(F.explode(F.arrays_zip("digests", "images")).alias("z")).select(F.col("z.digests").alias("digest"), F.col("z.images").alias("media"))
    return images, kept.select(F.col("k").alias(id_col), "html")


def page_media(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = 200) -> DataFrame:
    """(id_col, position, kind, text, caption, n_bytes, payload_sha256, feature) of every item of every page, long text runs as media.

    Pages go through illustrate; what comes back is parsed from the written pages and read
    from the stored bytes, joined by digest. A text item has its text and no media columns; a
    media item has no text, but the address of one that is not in the store. A null or empty
    page has no items; a repeated row has its items again; an empty table gives an empty result.
    """
    images, written = illustrate(pages, id_col, html_col, least)
    items = table(sequences(written, id_col, "html"), "page-items")
    found = one_each(describe(images))
    names = ["n_bytes", "payload_sha256", "feature"]
    seen = resolve(items, found, id_col).select(F.col(id_col), "position", F.lit("media").alias("kind"), F.lit(None).cast("string").alias("text"), "caption", *names)
    rest = items.select(F.col(id_col), F.explode("items").alias("i")).where(F.col("i.digest").isNull())
    rest = rest.select(F.col(id_col), "i.position", "i.kind", "i.text", "i.caption", *[F.lit(None).cast(seen.schema[n].dataType).alias(n) for n in names])
    return seen.unionByName(rest)
