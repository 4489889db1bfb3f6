"""Exact duplicates by progressive refinement, in DataFrame functions only.

Texts are compared without their white space (characters `[\\x20\\x09-\\x0D]`). Three levels
tell them apart, each at work only on what the level before has left together:

1. the length in bytes, counted over all rows;
2. the hash of a prefix, for rows whose length occurs twice;
3. the hash of the whole text, for rows whose length and prefix occur twice.

What a level leaves together is handed on as a bitmap of hashed keys. Its size is fixed, so it
can be sent to all tasks whatever the size of the corpus, and the documents are filtered where
they are read: no text is shuffled. Two keys that share a bit only cost a hash of level 3 that
was not needed, and with more keys than bits that level approaches one hash a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import quoted
from tidemark.scratch import drop, ensure_importable, table

#: Code points of the prefix; bits of a bitmap as a power of two (2 MB); bits of one of Spark's bitmap buckets.
PREFIX, BITS, BUCKET_BITS = 256, 24, 15
_SPACE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normal(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for mark in _SPACE:
        out = F.replace(out, F.lit(mark), F.lit(""))
    return out


def text_sha256(text: Column) -> Column:
    """sha256 of the normalised text in lower-case hex."""
    return F.sha2(normal(text), 256)


def _bit(keys: list[Column], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << bits))


def _bitmap(survivors: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """(bucket, bitmap) of the hashed keys: at most 2^bits / 32,768 rows of 4 KB."""
    bit = survivors.select(_bit([F.col(k) for k in keys], bits).alias("bit"))
    bucket, place = F.shiftright("bit", BUCKET_BITS), F.col("bit").bitwiseAND(F.lit((1 << BUCKET_BITS) - 1))
    return bit.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(place).alias("bitmap"))


def _marked(rows: DataFrame, bitmap: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """rows with a column `again`: whether the bit of their keys is set. The bitmap has at most 2^bits / 8 bytes, so it is broadcast."""
    placed = rows.withColumn("bit", _bit([F.col(k) for k in keys], bits)).withColumn("at", F.shiftright("bit", BUCKET_BITS))
    place = F.col("bit").bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, place.bitwiseAND(F.lit(7))) == 1
    joined = placed.join(F.broadcast(bitmap), F.col("at") == F.col("bucket"), "left")
    return joined.withColumn("again", F.coalesce(is_set, F.lit(False))).drop("bit", "at", "bucket", "bitmap")


def _judged(docs: DataFrame, carried: list[Column], id_col: str, text_col: str, prefix: int, bits: int) -> DataFrame:
    """(row, id, keep_id, group_size, kept) of every row of docs; row holds the carried columns."""
    ensure_importable(docs.sparkSession)
    measured = docs.select(
        F.struct(*carried).alias("row"), F.col(quoted(id_col)).alias("id"), F.coalesce(F.char_length(F.col(quoted(text_col))), F.lit(0)).alias("n_chars"),
        normal(F.col(quoted(text_col))).alias("text"),
    ).select("row", "id", "n_chars", "text", F.octet_length("text").alias("n_bytes"), F.xxhash64(F.substring("text", 1, prefix)).alias("prefix"))
    facts = table(measured.select("n_bytes", "prefix"), "exact-facts")
    lengths = facts.groupBy("n_bytes").agg(F.count("*").alias("n")).where("n > 1")
    left = _marked(facts, _bitmap(lengths, ["n_bytes"], bits), ["n_bytes"], bits).where("again")
    pairs = left.groupBy("n_bytes", "prefix").agg(F.count("*").alias("n")).where("n > 1")
    bitmap = table(_bitmap(pairs, ["n_bytes", "prefix"], bits), "exact-bitmap")
    drop(facts)
    again = _marked(measured, bitmap, ["n_bytes", "prefix"], bits)
    digest = F.when(F.col("again"), F.unhex(F.sha2("text", 256)))
    # a place of its own for each row, fixed by being written, tells rows apart that repeat an id
    rows = table(again.select("row", "id", "n_chars", digest.alias("digest"), F.monotonically_increasing_id().alias("place")), "exact-rows")
    drop(bitmap)
    order = F.struct((-F.col("n_chars")).alias("shorter"), F.col("id").isNull().alias("unknown"), F.col("id").alias("id"), F.col("place").alias("place"))
    # written by itself, so that Spark can split the rows of a large group in the join
    groups = rows.where("digest is not null").groupBy("digest").agg(F.count("*").alias("group_size"), F.min(order).alias("best")).where("group_size > 1")
    groups = table(groups.select(F.col("digest").alias("g_digest"), "group_size", F.col("best.id").alias("keep_id"), F.col("best.place").alias("keep_place")), "exact-groups")
    met = rows.where("digest is not null").join(groups.hint("merge"), F.col("digest") == F.col("g_digest"), "left")
    shared = met.select(
        "row", "id", F.when(F.col("g_digest").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("place") == F.col("keep_place"), F.lit(True)).alias("kept"),
    )
    alone = rows.where("digest is null").select("row", "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return shared.unionAll(alone)


ADDED = ("keep_id", "group_size", "kept")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, bits: int = BITS) -> DataFrame:
    """The columns of docs but text_col, then keep_id, group_size and kept, one row for each row of docs.

    Rows are equal if their texts are after white space is deleted; a null text counts as
    empty, so null, empty and blank texts form one group. Of a group the row with the most
    code points in its original text stays, then the one with the smallest id, an unknown id
    last; keep_id is its id. Of rows that repeat id and text one stays, whichever. Very long
    texts need nothing special. An empty table gives an empty result; columns of docs that
    are named like the three added ones are left out, any other name may be used, dots
    included.
    """
    others = [c for c in docs.columns if c != text_col and (c == id_col or c not in ADDED)]
    judged = _judged(docs, [F.col(quoted(c)) for c in others], id_col, text_col, prefix, bits)
    return judged.select(*[F.col("row").getField(c).alias(c) for c in others], *ADDED)


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, bits: int = BITS) -> DataFrame:
    """The rows of docs that exact_duplicates keeps, with all their columns; texts of groups are shuffled once."""
    judged = _judged(docs, [F.col(quoted(c)) for c in docs.columns], id_col, text_col, prefix, bits)
    return judged.where("kept").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


EXACT_SQL = """
with normalised as (
  select doc_id, length(coalesce(text, '')) as n_chars, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') as t from documents),
grouped as (
  select doc_id, t, first_value(doc_id) over (partition by t order by n_chars desc, doc_id) as keep_id, count(*) over (partition by t) as group_size from normalised)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from grouped
"""
