"""Token ids as directly addressable codes.

A segment holds the ids of consecutive documents. Ids are split into chunk levels (widths
in bits, lowest chunk first); an id has as many chunks as it needs. Each level but the last
has a bitmap that tells which of its chunks are continued in the next level, with a rank
directory of the set bits before every block of 512. The place of an id's next chunk is the
rank of its bit, so any token is reached in as many steps as it has chunks, without decoding
the tokens before it.

Segment image, little-endian: magic `DAC1`, u32 levels, u64 tokens, u64 documents; per level
u32 width and u64 chunks; then the document ends (u64 each); then per level its chunks (u8,
u16 or u32 each), and for all but the last level the bitmap bytes and the directory (u64
each). Every section is padded to 8 bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import DocumentIds, bpe_encoder, chunks, lean, tokenizer_path
from tidemark.scratch import ensure_importable, table

MAGIC, BLOCK = b"DAC1", 512
#: Bytes of text that one part is to hold.
PART_BYTES = 64 << 20
#: Chunk widths: ids below 2**8, 2**16 and 2**32 take one, two and three chunks.
WIDTHS = (8, 8, 16)


def _padded(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % 8)


def _dtype(width: int) -> str:
    return "<u1" if width <= 8 else "<u2" if width <= 16 else "<u4"


def encode_segment(ids: np.ndarray, ends: np.ndarray, widths: Sequence[int] = WIDTHS) -> bytes:
    """Image of the ids; ends[i] is the number of ids up to the end of document i."""
    if sum(widths) < 32:
        raise ValueError("the chunk widths must cover 32 bits")
    head, body, rest = [], [], np.asarray(ids, np.uint64)
    for k, width in enumerate(widths):
        head.append(struct.pack("<IQ", width, len(rest)))
        body.append(_padded((rest & np.uint64((1 << width) - 1)).astype(_dtype(width)).tobytes()))
        if k + 1 < len(widths):
            high = rest >> np.uint64(width)
            more = high > 0
            body.append(_padded(np.packbits(more, bitorder="little").tobytes()))
            per_block = np.add.reduceat(more, np.arange(0, len(more), BLOCK)) if len(more) else np.zeros(0, np.int64)
            body.append((np.cumsum(per_block) - per_block).astype("<u8").tobytes())
            rest = high[more]
    top = MAGIC + struct.pack("<IQQ", len(widths), len(ids), len(ends)) + b"".join(head)
    return _padded(top) + np.asarray(ends, "<u8").tobytes() + b"".join(body)


class Segment:
    """Reader of one image."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a segment")
        levels, self.n_tokens, n_docs = struct.unpack_from("<IQQ", raw, 4)
        at = 24
        shape = [struct.unpack_from("<IQ", raw, at + 12 * k) for k in range(levels)]
        at += 12 * levels
        at += -at % 8
        self.ends = np.frombuffer(raw, "<u8", n_docs, at).astype(np.int64)
        at += 8 * n_docs
        self.levels = []
        for k, (width, n) in enumerate(shape):
            kind = np.dtype(_dtype(width))
            codes = np.frombuffer(raw, kind, n, at)
            at += n * kind.itemsize + -(n * kind.itemsize) % 8
            bits = directory = None
            if k + 1 < levels:
                size = -(-n // 8)
                bits = np.frombuffer(raw, np.uint8, size, at)
                at += size + -size % 8
                directory = np.frombuffer(raw, "<u8", -(-n // BLOCK), at)
                at += 8 * len(directory)
            self.levels.append((width, codes, bits, directory))

    def token(self, i: int) -> int:
        """The id at place i, by one rank for each chunk after the first."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = 0
        for width, codes, bits, directory in self.levels:
            value |= int(codes[i]) << shift
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            inside = int.from_bytes(bits[block * BLOCK // 8 : (i >> 3) + 1].tobytes(), "little")
            inside &= (1 << (i - block * BLOCK)) - 1
            i = int(directory[block]) + inside.bit_count()
            shift += width
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop; on each level one run of chunks is read."""
        out = None
        where = np.arange(stop - start)
        shift = 0
        for width, codes, bits, directory in self.levels:
            part = codes[start:stop].astype(np.uint64) << np.uint64(shift)
            if out is None:
                out = part
            else:
                out[where] |= part
            if bits is None or stop <= start:
                break
            block = start // BLOCK
            run = np.unpackbits(bits[block * BLOCK // 8 : -(-stop // 8)], bitorder="little")
            skip = start - block * BLOCK
            more = run[skip : skip + stop - start].astype(bool)
            where = where[more]
            start = int(directory[block]) + int(run[:skip].sum())
            stop = start + len(where)
            shift += width
        return out.astype(np.uint32) if out is not None else np.zeros(0, np.uint32)

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def write_ids(
    docs: DataFrame,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 2,
    widths: Sequence[int] = WIDTHS,
    partitions: int | None = None,
) -> DataFrame:
    """Write the token ids of all documents in ascending id order and return the segment table.

    Rows are (part, segment, doc_ids, n_tokens, image): part and segment give the order,
    doc_ids names the documents of a segment, image is the segment in this module's format.
    The images live in a binary Parquet column, so any store that Spark writes will do, and
    a lost executor costs only its own parts. Without partitions, there are as many parts as
    the texts' bytes ask for, but no fewer than spark.sql.shuffle.partitions. A null or empty
    text is the end id alone, null ids come first, repeated ids stand beside each other
    ordered by a hash of their texts, and may share several parts. Other columns of docs are
    left out. An empty table gives an empty segment table.
    """
    spark = docs.sparkSession
    ensure_importable(spark)
    vocabulary = tokenizer or tokenizer_path("word_bpe_49k.json")
    id_type = docs.schema[id_col].dataType.simpleString()
    n = partitions
    if not n:
        volume = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-volume // PART_BYTES))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, segment, encoder = TaskContext.get().partitionId(), 0, bpe_encoder(vocabulary)
        for batch in batches:
            for rows in chunks(batch, "text"):
                got = DocumentIds(rows.column("text"), encoder, end_id)
                image = encode_segment(got.ids, got.offsets[1:], widths)
                names = rows.column("doc_id")
                listed = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), listed, pa.array([len(got.ids)], pa.int64()), pa.array([image], pa.binary())],
                    names=["part", "segment", "doc_ids", "n_tokens", "image"],
                )
                segment += 1

    ordered = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    )
    images = ordered.mapInArrow(encode, f"part int, segment int, doc_ids array<{id_type}>, n_tokens long, image binary")
    if path is None:
        return table(images, "dac")
    images.write.parquet(path)
    return spark.read.schema(images.schema).parquet(path)


def read_ids(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read from its segment's image.

    start counts the ids of all documents before it: running sums over the parts, then over
    the segments of a part, then over the documents of a segment.
    """
    id_type = segments.schema["doc_ids"].dataType.elementType.simpleString()
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = table(parts.select(F.col("part").alias("p_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("p_base")), "dac-parts")
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    small = segments.select("part", "segment", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("s_base"))
    bases = table(
        small.join(parts, F.col("part") == F.col("p_part")).select(
            F.col("part").alias("b_part"), F.col("segment").alias("b_segment"), (F.col("p_base") + F.col("s_base")).alias("base")
        ),
        "dac-bases",
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for base, names, image in zip(batch.column("base").to_pylist(), batch.column("doc_ids"), batch.column("image"), strict=True):
                segment = Segment(image.as_py())
                starts = np.concatenate([[0], segment.ends[:-1]]).astype(np.int64)
                crc = [zlib.crc32(segment.document(k).astype("<u4")) for k in range(len(segment.ends))]
                yield pa.RecordBatch.from_arrays(
                    [names.values, pa.array(base + starts), pa.array(segment.ends - starts), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return (
        segments.join(bases, (F.col("part") == F.col("b_part")) & (F.col("segment") == F.col("b_segment")))
        .select("base", "doc_ids", "image")
        .mapInArrow(decode, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")
    )
