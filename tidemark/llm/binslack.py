"""Packing token sequences into fixed-length bins by minimum bin slack."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import DocumentIds, bpe_encoder, chunks, lean, tokenizer_path
from tidemark.scratch import ensure_importable, table


#: Pieces in a shard, on average.
SHARD_ROWS = 1 << 19


def fullest(available: list[tuple[int, int]], capacity: int) -> list[tuple[int, int]]:
    """Combination of lengths with the largest sum up to capacity.

    available holds (length, count) in the order in which lengths are offered. Bit s of a
    bitset tells that sum s can be reached; counts are split into powers of two. Returns
    (length, how many).
    """
    mask = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length, count in available:
        count = min(count, capacity // length)
        part = 1
        while count > 0:
            take = min(part, count)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            count -= take
            part *= 2
        if reach >> capacity & 1:
            break
    at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return list(used.items())


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (repeats, [(length, how many), ...]) that use up the histogram of lengths.

    Each bin holds the longest length left and the fullest feasible combination beside it;
    a pattern is repeated while the lengths left allow it. Work depends on the number of
    distinct lengths, at most capacity, and not on the number of documents.
    """
    left = {k: v for k, v in histogram.items() if v > 0}
    order = sorted(left, reverse=True)
    plans = []
    while left:
        order = [k for k in order if k in left]
        first = order[0]
        offered = [(k, left[k] - (k == first)) for k in order if k <= capacity - first and left[k] > (k == first)]
        used = dict(fullest(offered, capacity - first)) if offered else {}
        used[first] = used.get(first, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        plans.append((times, sorted(used.items(), reverse=True)))
    return plans


def token_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document cut at capacity tokens."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe_encoder(tokenizer)
        for batch in batches:
            for part in chunks(batch, "text"):
                got = DocumentIds(part.column("text"), encoder, end_id)
                sizes = np.diff(got.offsets)
                n = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, sizes[doc] - start)
                raw, at = got.ids.astype("<u4"), got.offsets[doc] + start
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 0,
    capacity: int = 2048,
) -> DataFrame:
    """Pack all documents into sequences of at most capacity tokens.

    Returns (doc_id, piece, start, length, ids_crc32, sequence_id, offset). A document is
    its token ids and one end id (a null or empty text: the end id alone); only documents
    longer than capacity are cut, into full pieces and a last one. Only the histogram of
    lengths, at most capacity rows, reaches the driver, which plans the bins; the plan,
    bounded by capacity as well, goes back to the executors. Pieces of one length are
    ranked within (length, shard of the id) and the shards' counts summed up, so a length
    that a third of all rows have is spread over all shards. Repeated rows are packed as
    often as they occur. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ensure_importable(spark)
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    pieces = table(token_pieces(docs, id_col, text_col, path, end_id, capacity), "pack-pieces")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16, -(-pieces.count() // SHARD_ROWS))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("int"))
    counts = table(pieces.groupBy("length", "shard").agg(F.count("*").alias("n")), "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plans = plan_bins(histogram, capacity)

    # for each length, the rank at which each pattern begins to draw on it
    draws: dict[int, list[tuple[int, int, int, int]]] = {}
    drawn: dict[int, int] = {}
    base = 0
    for times, used in plans:
        at = 0
        for length, n in used:
            draws.setdefault(length, []).append((drawn.get(length, 0), n, base, at))
            drawn[length] = drawn.get(length, 0) + n * times
            at += length * n
        base += times
    shared = spark.sparkContext.broadcast({k: np.array(v, np.int64).T for k, v in draws.items()})

    earlier = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base_rank = counts.select(
        F.col("length").alias("c_length"), F.col("shard").alias("c_shard"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        pieces.withColumn("r", F.row_number().over(inside))
        .join(base_rank.hint("merge"), (F.col("length") == F.col("c_length")) & (F.col("shard") == F.col("c_shard")))
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("r") - 1 + F.col("before")).alias("rank"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        plan = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1))
            for rows in np.split(order, edges[1:]) if len(order) else []:
                size = int(length[rows[0]])
                begin, n, first, at = plan[size]
                k = np.searchsorted(begin, rank[rows], side="right") - 1
                q = rank[rows] - begin[k]
                seq[rows] = first[k] + q // n[k]
                off[rows] = at[k] + q % n[k] * size
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            )

    id_type = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(
        place, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
