"""Suffix-array removal of repeated byte strings by blockwise sorting with a difference cover.

A string of `length` bytes is called a window. Windows are dealt out by their minimizer, the
least hash among their `seed`-byte strings, so equal windows always meet. Windows of one text
that share the place of their minimizer form a strand; strands whose minimizer occurs once
are done with, equal strands are counted, and only minimizers with several different strands
are sorted: their bytes form the text of a unit of bounded size, whose suffixes are sorted
one bucket at a time, long ties being resolved by the ranks of a difference-cover sample.
Minimizers with too many bytes for one unit deal their different strands out again in the
same way by longer seeds, at last by whole windows, so no unit grows with the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.llm.common import chunks, lean, quoted, utf8_bytes
from tidemark.scratch import drop, ensure_importable, table

LENGTH, SEED = 200, 64
#: Times the seed's bytes at the next level, for minimizers with too many bytes.
LONGER = 2
#: Period of the difference cover, the cover, and suffixes sorted in one bucket.
PERIOD, COVER, BUCKET = 16, (0, 1, 2, 5, 8), 1 << 16
#: Window starts handled at once in a text; bytes of strands sorted as one unit; bytes above which a minimizer is dealt out again.
PIECE, UNIT, HOT = 1 << 20, 1 << 20, 1 << 17

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_TABLE = np.random.default_rng(77).integers(0, 1 << 63, 256, dtype=np.uint64)
_SHIFT = np.array([[next(d for d in range(PERIOD) if (i + d) % PERIOD in COVER and (j + d) % PERIOD in COVER) for j in range(PERIOD)] for i in range(PERIOD)])
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) <= n:
        inverse = np.array([pow(int(_BASE), -1, 1 << 64)], np.uint64)[0]
        size = 1 << (n + 1).bit_length()
        with np.errstate(over="ignore"):
            _powers = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b, np.uint64))]) for b in (_BASE, inverse))
    return _powers


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """Mixed polynomial hash modulo 2**64 of every k-byte string."""
    n = len(data)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _power_tables(n)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_TABLE[data] * up[:n], dtype=np.uint64)])
    x = (sums[k:] - sums[:-k]) * down[: n - k + 1]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over every w neighbours, by running values within blocks of w from both sides."""
    n = len(x) - w + 1
    fill = np.iinfo(np.uint64).max if op is np.minimum else 0
    padded = np.full(-(-len(x) // w) * w, fill, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    left = op.accumulate(blocks, axis=1).ravel()
    right = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(right[:n], left[w - 1 : w - 1 + n])


def strands(data: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first window, number of windows) of the strands of one text."""
    if len(data) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = rolling(data, seed)
    w = length - seed + 1
    low = _sliding(h, w, np.minimum)
    n = len(low)
    # places that are the least of some window
    ends = np.zeros(w - 1, np.uint64)
    high = _sliding(np.concatenate([ends, low, ends]), w, np.maximum)
    places = np.flatnonzero(h == high)
    kinds, rank = np.unique(h[places], return_inverse=True)
    big = len(h) + 1
    listed = np.sort(rank.astype(np.int64) * big + places)
    # runs of windows with one minimizer, cut behind each place at which it occurs
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    last = np.append(first[1:], n) - 1
    kind = np.searchsorted(kinds, low[first]).astype(np.int64) * big
    begin, end = np.searchsorted(listed, kind + first), np.searchsorted(listed, kind + last + w)
    count = end - begin
    run = np.repeat(np.arange(len(first)), count)
    at = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    place = listed[begin[run] + at] % big
    start = np.where(at == 0, first[run], np.concatenate([[0], place[:-1]]) + 1)
    stop = np.minimum(place, last[run])
    good = start <= stop
    return low[first][run][good], start[good], (stop - start + 1)[good]


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes at every place as a number, zeros behind the end."""
    raw = np.concatenate([data, np.zeros(7, np.uint8)]).tobytes()
    return np.ndarray(len(data), ">u8", raw, strides=(1,)).astype(np.uint64)


def cover_ranks(words: np.ndarray, room: np.ndarray, depth: int) -> np.ndarray:
    """Rank at each place of the cover sample, by its first depth bytes or up to its strand's end.

    room is the number of bytes to the end of the strand. Ranks double the bytes they tell
    apart from step to step; the place PERIOD * 2**k further on is a sample place as well.
    """
    n = len(words)
    inside = np.zeros(PERIOD, bool)
    inside[list(COVER)] = True
    sample = np.flatnonzero(inside[np.arange(n) % PERIOD])
    w0, w1 = _cut(words, room, sample, 0), _cut(words, room, sample, 8)
    order = np.lexsort((w1, w0))
    rank = np.zeros(n + 1, np.int64)
    new = np.concatenate([[True], (w0[order][1:] != w0[order][:-1]) | (w1[order][1:] != w1[order][:-1])])
    rank[sample[order]] = np.cumsum(new)
    reach = PERIOD
    while reach < depth and not new.all():
        ahead = np.where(room[sample] > reach, rank[np.minimum(sample + reach, n)], 0)
        key = rank[sample] * (n + 2) + ahead
        order = np.argsort(key)
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        rank[sample[order]] = np.cumsum(new)
        reach *= 2
    return rank


def _cut(words: np.ndarray, room: np.ndarray, at: np.ndarray, skip: int) -> np.ndarray:
    """Eight bytes at at + skip, zeros from the strand's end on."""
    place = np.minimum(at + skip, len(words) - 1)
    left = np.clip(room[at] - skip, 0, 8).astype(np.uint64)
    mask = np.where(left > 0, ~np.uint64(0) << ((np.uint64(8) - left) * np.uint64(8) % np.uint64(64)), np.uint64(0))
    return words[place] & mask


def _sort_ties(groups: np.ndarray, sizes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Sort each group (consecutive, of the given sizes) whose suffixes agree in PERIOD bytes.

    Two suffixes are compared by the ranks at the least distance at which both meet the
    cover. Groups of similar size form a matrix that a bitonic network sorts.
    """
    out = groups.copy()
    starts = np.cumsum(sizes) - sizes
    width = 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
    for w in np.unique(width[sizes > 1]):
        chosen = np.flatnonzero((width == w) & (sizes > 1))
        columns = np.arange(w)
        filled = columns < sizes[chosen][:, None]
        m = np.where(filled, out[np.minimum(starts[chosen][:, None] + columns, len(out) - 1)], -1)
        k = 2
        while k <= w:
            j = k // 2
            while j:
                a = columns[(columns & j) == 0]
                b = a | j
                x, y = m[:, a], m[:, b]
                shift = _SHIFT[x % PERIOD, y % PERIOD]
                more = rank[np.maximum(x + shift, 0)] > rank[np.maximum(y + shift, 0)]
                more = np.where(x < 0, y >= 0, np.where(y < 0, False, more))  # blanks go last
                less = np.where(y < 0, x >= 0, np.where(x < 0, False, rank[np.maximum(x + shift, 0)] < rank[np.maximum(y + shift, 0)]))
                swap = np.where((a & k) == 0, more, less)
                m[:, a], m[:, b] = np.where(swap, y, x), np.where(swap, x, y)
                j //= 2
            k *= 2
        out[(starts[chosen][:, None] + columns)[filled]] = m[filled]
    return out


def repeated_windows(pieces: list[bytes], length: int = LENGTH, bucket: int = BUCKET) -> list[np.ndarray]:
    """For each piece, which of its windows also starts elsewhere in the pieces.

    All windows are sorted, one bucket of suffixes at a time; buckets are cut at words of
    the sorted text so that none is larger than bucket unless one word alone is.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    # no byte of UTF-8 is 255, so bytes move up by one and zero stands behind a strand
    data = np.frombuffer(b"".join(pieces), np.uint8) + np.uint8(1)
    n = len(data)
    if not n:
        return [np.zeros(0, bool) for _ in pieces]
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)
    words = _words(data)
    rank = cover_ranks(words, room, length + PERIOD)
    starts = np.flatnonzero(room >= length)
    flags = np.zeros(n, bool)
    head = words[starts]
    cuts = np.unique(np.sort(head)[bucket::bucket])
    home = np.searchsorted(cuts, head, side="right")
    dealt = np.argsort(home, kind="stable")
    edges = np.concatenate([[0], np.cumsum(np.bincount(home, minlength=len(cuts) + 1))])
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        at = starts[dealt[lo:hi]]
        if len(at) < 2:
            continue
        w0, w1 = words[at], words[at + 8]
        order = np.lexsort((w1, w0))
        at, w0, w1 = at[order], w0[order], w1[order]
        new = np.concatenate([[True], (w0[1:] != w0[:-1]) | (w1[1:] != w1[:-1])])
        first = np.flatnonzero(new)
        tie = np.diff(np.append(first, len(at)))
        keep = np.repeat(tie > 1, tie)
        at, tie = at[keep], tie[tie > 1]
        if not len(at):
            continue
        at = _sort_ties(at, tie, rank)
        group = np.repeat(np.arange(len(tie)), tie)
        pair = np.flatnonzero(group[1:] == group[:-1])
        for skip in [*range(16, length - 8, 8), length - 8]:  # neighbours that agree in all bytes
            pair = pair[words[at[pair] + skip] == words[at[pair + 1] + skip]]
        flags[at[pair]] = True
        flags[at[pair + 1]] = True
    counts = np.maximum(sizes - length + 1, 0)
    ends = np.cumsum(sizes)
    return [flags[e - s : e - s + c] for e, s, c in zip(ends, sizes, counts, strict=True)]


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _packed(spans: list[tuple[int, int]]) -> bytes:
    return np.array(spans, np.int64).reshape(-1).tobytes()


def repeated_spans(rows: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Scratch table (digest, spans) of the byte strings in rows (digest, tag, bytes) that have a repeated window.

    digest must tell strings apart; tag tells apart rows of one digest as far as it can, so
    that few of them are read for their bytes. spans holds pairs of int64: the starts and
    ends of runs of window starts, as bytes. A row counts as one occurrence of each of its
    windows.
    """
    spark = rows.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        lean()
        for batch in batches:
            for part in chunks(batch, "bytes", 2 << 20):
                data, ends = utf8_bytes(pc.fill_null(part.column("bytes"), b"").cast(pa.large_binary()))
                got: list[list] = [[], [], [], [], []]
                for i in range(part.num_rows):
                    body = data[ends[i] : ends[i + 1]]
                    for base in range(0, max(len(body) - length + 1, 0), PIECE):
                        piece = body[base : base + PIECE + length - 1]
                        key, a, n = strands(piece, length, seed)
                        raw = piece.tobytes()
                        got[0].append(np.full(len(key), i))
                        got[1].append(key.view(np.int64))
                        got[2].append(np.array([xxhash.xxh3_64_intdigest(raw[s:e]) for s, e in zip(a.tolist(), (a + n + length - 1).tolist(), strict=True)], np.uint64).view(np.int64))
                        got[3].append(a + base)
                        got[4].append(n)
                columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in got]
                yield pa.RecordBatch.from_arrays(
                    [part.column("digest").take(pa.array(columns[0])), *[pa.array(x, pa.int64()) for x in columns[1:]]],
                    names=["digest", "key", "body", "start", "n"],
                )

    all_strands = table(rows.select("digest", "bytes").mapInArrow(cut, "digest binary, key long, body long, start long, n long"), "strands")
    repeated = table(all_strands.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select(F.col("key").alias("r_key")), "repeated-seeds")
    # written before it is grouped: grouping on top of the join would keep Spark from splitting a hot minimizer
    near = table(all_strands.join(repeated, F.col("key") == F.col("r_key"), "left_semi"), "near-strands")
    drop(all_strands, repeated)
    met = table(near.groupBy("digest", "key", "body", "start", "n").agg(F.count("*").alias("c")), "met-strands")
    drop(near)
    distinct = table(met.groupBy("key", "body").agg(F.sum("c").alias("c"), F.min(F.struct("digest", "start", "n")).alias("at")), "distinct-strands")
    keys = distinct.groupBy("key").agg(F.count("*").alias("kinds"), F.sum(F.col("at.n") + (length - 1)).alias("bytes")).where("kinds > 1")
    keys = table(keys.select(F.col("key").alias("k_key"), "bytes"), "open-seeds")
    volume, largest = keys.agg(F.sum("bytes"), F.max("bytes")).first()
    units = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(volume or 0) // UNIT))
    hot = HOT if seed < length else int(largest or 0)  # windows that agree in the whole of their length are one strand
    whole = table(distinct.where("c > 1").select("key", "body", F.lit(None).cast("binary").alias("spans")), "whole-strands")

    # the bytes of each different strand, from one of the rows that hold it
    asked = distinct.join(keys, F.col("key") == F.col("k_key")).select("at.digest", F.struct("key", "body", "at.start", "at.n", (F.col("bytes") > hot).alias("hot")).alias("s"))
    asked = table(asked.groupBy(F.col("digest").alias("a_digest")).agg(F.collect_list("s").alias("asked")), "asked-strands")
    drop(distinct, keys)
    first = rows.groupBy(F.col("digest").alias("h_digest")).agg(F.min("tag").alias("h_tag"))  # copies are summed up before they are dealt out
    holders = table(first.join(asked.select("a_digest"), F.col("h_digest") == F.col("a_digest"), "left_semi"), "strand-holders")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        done = set()
        for batch in batches:
            out: dict[str, list] = {"key": [], "body": [], "hot": [], "bytes": []}
            for digest, raw, asked in zip(batch.column("digest"), batch.column("bytes"), batch.column("asked"), strict=True):
                if (digest := digest.as_py()) in done:
                    continue
                done.add(digest)
                raw = raw.as_py()
                for s in asked.as_py():
                    out["key"].append(s["key"])
                    out["body"].append(s["body"])
                    out["hot"].append(s["hot"])
                    out["bytes"].append(raw[s["start"] : s["start"] + s["n"] + length - 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["key"], pa.int64()), pa.array(out["body"], pa.int64()), pa.array(out["hot"], pa.bool_()), pa.array(out["bytes"], pa.binary())],
                names=list(out),
            )

    # texts are never joined by a broadcast: the plan is the same at every size
    one = rows.join(holders.hint("merge"), (F.col("digest") == F.col("h_digest")) & (F.col("tag") == F.col("h_tag"))).select("digest", "bytes")
    fetched = one.join(asked.hint("merge"), F.col("digest") == F.col("a_digest")).select("digest", "bytes", "asked").mapInArrow(fetch, "key long, body long, hot boolean, bytes binary")
    fetched = table(fetched, "strand-bytes")
    drop(asked, holders)

    def sort_unit(group: pa.Table) -> pa.Table:
        # rows alike in digest and tag that several tasks read bring a strand more than once
        rows = sorted({(k, b): x for k, b, x in zip(group.column("key").to_pylist(), group.column("body").to_pylist(), group.column("bytes").to_pylist(), strict=True)}.items())
        flags = repeated_windows([x for _, x in rows], length)
        found = [(k, b, _packed(_spans(f))) for ((k, b), _), f in zip(rows, flags, strict=True) if f.any()]
        key, body, spans = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"key": pa.array(key, pa.int64()), "body": pa.array(body, pa.int64()), "spans": pa.array(spans, pa.binary())})

    cold = (
        fetched.where("not hot").select("key", "body", "bytes", F.pmod(F.xxhash64("key"), F.lit(units)).alias("unit"))
        .groupBy("unit").applyInArrow(lambda g: sort_unit(g), "key long, body long, spans binary")
    )
    marked = whole.union(cold)
    deeper = None
    if int(largest or 0) > hot:
        # each different strand of a hot minimizer is a string of its own, whose windows meet again by longer seeds
        again = fetched.where("hot").dropDuplicates(["key", "body"]).select(F.concat(F.unhex(F.lpad(F.hex("key"), 16, "0")), F.unhex(F.lpad(F.hex("body"), 16, "0"))).alias("digest"), F.lit(0).cast("long").alias("tag"), "bytes")
        again = table(again, "hot-strands")
        deeper = repeated_spans(again, length, min(length, LONGER * seed))
        drop(again)
        number = lambda at: F.conv(F.hex(F.substring("digest", at, 8)), 16, -10).cast("long")
        marked = marked.union(deeper.select(number(1), number(9), "spans"))
    marked = table(marked.withColumnsRenamed({"key": "m_key", "body": "m_body"}), "marked-strands")
    drop(whole, fetched, *([deeper] if deeper is not None else []))

    hits = met.join(marked, (F.col("key") == F.col("m_key")) & (F.col("body") == F.col("m_body"))).select("digest", F.struct("start", "n", "spans").alias("s"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            out = []
            for hits in batch.column("hits"):
                runs = []
                for s in hits.as_py():
                    if s["spans"] is None:
                        runs.append((s["start"], s["start"] + s["n"]))
                    else:
                        runs += (np.frombuffer(s["spans"], np.int64).reshape(-1, 2) + s["start"]).tolist()
                out.append(_packed(sorted(map(tuple, runs))))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(out, pa.binary())], names=["digest", "spans"])

    found = table(hits.groupBy("digest").agg(F.collect_list("s").alias("hits")).mapInArrow(place, "digest binary, spans binary"), "repeated-spans")
    drop(met, marked)
    return found


def remove_spans(raw: bytes, spans: bytes | None, length: int) -> tuple[bytes, int, int]:
    """(bytes left, bytes removed, maximal runs removed) when windows starting in spans go."""
    if not spans:
        return raw, 0, 0
    runs: list[list[int]] = []
    for a, b in np.frombuffer(spans, np.int64).reshape(-1, 2).tolist():
        b += length - 1
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    left, at = [], 0
    for a, b in runs:
        left.append(raw[at:a])
        at = b
    left.append(raw[at:])
    return b"".join(left), sum(b - a for a, b in runs), len(runs)


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, output: str = "text") -> DataFrame:
    """docs with every byte removed that a repeated string of length bytes covers.

    A string is repeated if it starts at another place of any text as well, the same text
    included; strings never cross texts and are judged on the input. With output "text" all
    columns of docs are kept and text_col holds what is left, a character cut apart by the
    removal being dropped whole. With output "digest" the columns of docs but text_col are
    followed by n_bytes, n_removed, n_spans and kept_sha256 of the bytes left; columns of
    docs that have these names are left out. A null text stays null in "text" and counts as
    empty in "digest"; texts shorter than length are kept. Rows are judged one by one
    whatever their ids: repeated rows, and rows without an id, repeat each other's strings.
    An empty table gives an empty result.
    """
    ensure_importable(docs.sparkSession)
    digest = F.unhex(F.md5(F.col("text")))
    others = [c for c in docs.columns if c != text_col and not (output == "digest" and c in ("n_bytes", "n_removed", "n_spans", "kept_sha256"))]
    tag = F.xxhash64(*[F.col(quoted(c)) for c in others if "map" not in docs.schema[c].dataType.simpleString()]) if others else F.lit(0).cast("long")
    rows = docs.select(F.col(quoted(text_col)).alias("text"), tag.alias("tag")).where(F.octet_length("text") >= length)
    rows = rows.select(digest.alias("digest"), "tag", F.col("text").cast("binary").alias("bytes"))
    spans = repeated_spans(rows, length).select(F.col("digest").alias("s_digest"), "spans")
    packed = docs.select(F.struct(*[F.col(quoted(c)) for c in others]).alias("row"), F.col(quoted(text_col)).alias("text"))
    joined = packed.join(spans.hint("merge"), F.unhex(F.md5(F.col("text"))) == F.col("s_digest"), "left").select("row", "text", "spans")
    row = joined.schema["row"]

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            texts, measures = [], []
            for text, span in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = (text or "").encode()
                left, removed, runs = remove_spans(raw, span, length)
                if output == "text":
                    texts.append(text if not removed else left.decode(errors="ignore"))
                else:
                    measures.append((len(raw), removed, runs, hashlib.sha256(left).hexdigest()))
            if output == "text":
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])
            else:
                a, b, c, d = zip(*measures, strict=True) if measures else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.string())],
                    names=["row", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    if output == "text":
        cleaned = joined.mapInArrow(clean, StructType([row, StructField("text", StringType())]))
        return cleaned.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
    counts = [StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    cleaned = joined.mapInArrow(clean, StructType([row, *counts, StructField("kept_sha256", StringType())]))
    return cleaned.select(*[F.col("row").getField(c).alias(c) for c in others], "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Every window counted, for small tables; texts are handled as hex digits, two a byte.
REPEATS_SQL = """
with hexed as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
windows as materialized (
  select doc_id, i, md5(substr(h, 2 * i + 1, 400)) as k from (select doc_id, h, unnest(range(0, greatest(len(h) // 2 - 199, 0))) as i from hexed)),
hits as (select doc_id, i from windows where k in (select k from windows group by k having count(*) > 1)),
marked as (select *, case when i <= lag(i) over w + 200 then 0 else 1 end as fresh from hits window w as (partition by doc_id order by i)),
runs as (
  select doc_id, min(i) as a, max(i) + 200 as b
  from (select *, sum(fresh) over (partition by doc_id order by i rows unbounded preceding) as run from marked) group by doc_id, run),
gaps as (
  select r.doc_id, r.a, substr(h, 2 * coalesce(lag(r.b) over w, 0) + 1, 2 * (r.a - coalesce(lag(r.b) over w, 0))) as piece
  from runs r join hexed using (doc_id) window w as (partition by r.doc_id order by r.a)),
kept as (select doc_id, string_agg(piece, '' order by a) as head from gaps group by doc_id),
sums as (select doc_id, sum(b - a)::bigint as n_removed, count(*)::bigint as n_spans, max(b) as last from runs group by doc_id)
select h.doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from hexed h left join sums s on s.doc_id = h.doc_id left join kept k on k.doc_id = h.doc_id
"""
