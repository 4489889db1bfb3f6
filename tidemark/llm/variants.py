"""Spelling variants of the words of a corpus, grouped without pairs.

Two words are near if one inserted, deleted or replaced code point parts them. Words are
never compared with each other:

* replaced: a word belongs to a wildcard group for each of its positions, the words with the
  same prefix before it and the same suffix after it. A group keeps its size and its two most
  frequent words, which is all that a member needs to know: how many others there are, and
  the best of them that is not itself. A group has at most as many words as the alphabet has
  letters.
* inserted, deleted: the word without one code point joins the vocabulary.

Both use one exchange: a word without the code point at a position is the join key of the
deletion, and with the position the key of the wildcard group.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Words, chunks, lean, mapped, of_bytes, quoted
from tidemark.scratch import drop, ensure_importable, table

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5

_lower = np.full(256, 32, np.uint8)
_lower[65:91] = _lower[97:123] = np.arange(97, 123)
_lower[128:] = np.arange(128, 256)


def letter_runs(column: pa.Array) -> Words:
    """Maximal runs `[A-Za-z\\u00C0-\\u00FF]+` of each text, A-Z in lower case.

    In UTF-8 the letters beyond ASCII are the byte C3 and one that follows it.
    """
    data, ends = mapped(column, _lower)
    pair = data == 0xC3
    pair[1:] |= pair[:-1]
    return Words(of_bytes(np.where((data >= 128) & ~pair, np.uint8(32), data), ends))


def _counted(part: pa.RecordBatch, damage: int | None, least: int) -> pa.RecordBatch:
    runs = letter_runs(part.column("text"))
    vocab = runs.vocab
    size = len(vocab)
    lost: Counter = Counter()
    counts = np.bincount(runs.codes, minlength=size).astype(np.int64)
    if damage:
        pairs, times = np.unique(runs.doc_of_word() * max(size, 1) + runs.codes, return_counts=True)
        spelled = [w.encode() for w in vocab.to_pylist()]
        heads = [zlib.crc32(f"{i}:".encode()) for i in part.column("id").to_pylist()]
        doc, code = np.divmod(pairs, max(size, 1))
        hashes = np.fromiter((zlib.crc32(spelled[c], heads[d]) for d, c in zip(doc.tolist(), code.tolist(), strict=True)), np.int64, len(pairs))
        for k in np.flatnonzero(hashes % damage == 0).tolist():
            word = spelled[code[k]].decode()
            at = int(hashes[k]) % len(word)
            counts[code[k]] -= times[k]
            lost[word[:at] + word[at + 1 :]] += int(times[k])
    known = pa.array(counts > 0)
    words = pa.concat_arrays([vocab.filter(known).cast(pa.large_string()), pa.array(lost, pa.large_string())])
    n = np.concatenate([counts[counts > 0], np.fromiter(lost.values(), np.int64, len(lost))])
    long = pc.greater_equal(pc.utf8_length(words), least)
    return pa.RecordBatch.from_arrays([words.filter(long).cast(pa.string()), pa.array(n).filter(long)], names=["word", "n"])


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, damage: int | None = None) -> DataFrame:
    """(word, n) of all letter runs with at least least_length code points.

    With damage, a run of a document loses a code point wherever damage divides
    h = crc32("<id>:<run>"), the one at h modulo the run's length; an unknown id counts as
    an empty one. Null texts have no runs. Words are counted within a batch, then summed by
    Spark with its partial aggregation, so a word of any frequency is no hot key.
    """
    ensure_importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for part in chunks(batch, "text"):
                yield _counted(part, damage, least_length)

    rows = docs.select(F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("")).alias("id"), F.col(quoted(text_col)).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have near words: how many, and the most frequent one with its n.

    words has distinct word and n; ties go to the smaller word in code-point order.
    """
    cut = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.char_length("word"))).alias("pos"))
    rest = F.concat(F.expr("substring(word, 1, pos - 1)"), F.expr("substring(word, pos + 1)"))
    cut = cut.withColumn("rest", rest).repartition("rest")

    def ranked(n: str, word: str):
        return F.struct((-F.col(n)).alias("less"), F.col(word).alias("word"))

    group = Window.partitionBy("rest", "pos")
    best_first = group.orderBy(F.col("n").desc(), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wild = cut.select("word", F.count("*").over(group).alias("size"), *[F.nth_value(ranked("n", "word"), k).over(best_first).alias(f"top{k}") for k in (1, 2)]).where("size > 1")
    replaced = wild.select("word", (F.col("size") - 1).alias("near"), F.when(F.col("word") == F.col("top1.word"), F.col("top2")).otherwise(F.col("top1")).alias("best"))
    # of equal neighbours, the last one is cut: each shorter word once
    once = cut.where("substring(word, pos, 1) <> substring(word, pos + 1, 1)").select("rest", F.col("word").alias("longer"), F.col("n").alias("longer_n"))
    met = once.join(words.hint("merge"), F.col("rest") == F.col("word"))
    sides = F.explode(F.array(
        F.struct(F.col("word").alias("word"), ranked("longer_n", "longer").alias("best")),
        F.struct(F.col("longer").alias("word"), ranked("n", "word").alias("best")),
    ))
    moved = met.select(sides.alias("s")).select("s.word", F.lit(1).cast("long").alias("near"), "s.best")
    every = replaced.unionByName(moved).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return every.select("word", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.word").alias("best"))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, form, form_n, n_near, root) of every word of a table of distinct (word, n).

    A word's form is its most frequent near word, if that is at least ratio times as
    frequent, else null; form_n is the form's n. root follows the forms to the last, the
    word itself without a form. An n grows by the ratio with each form, so chains have at
    most as many links as n has digits to that base; each round halves what is left of them.
    """
    near = near_words(words).select(F.col("word").alias("w"), "n_near", "best_n", "best")
    known = words.join(near.hint("merge"), F.col("word") == F.col("w"), "left")
    has = F.col("best_n") >= ratio * F.col("n")
    formed = table(
        known.select("word", "n", F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")),
        "variant-forms",
    )
    links = table(formed.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "variant-links")
    while not links.where("moved").isEmpty():
        onward = links.select(F.col("word").alias("via"), F.col("root").alias("further"))
        further = links.join(onward.hint("merge"), F.col("root") == F.col("via"), "left")
        further = table(further.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variant-links")
        drop(links)
        links = further
    ends = links.select(F.col("word").alias("w"), "root")
    return formed.join(ends.hint("merge"), F.col("word") == F.col("w"), "left").select("word", "n", "form", "form_n", "n_near", F.coalesce("root", "word").alias("root"))


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    ratio: int = RATIO,
    damage: int | None = None,
) -> DataFrame:
    """(word, n, form, form_n, n_near, root) of the words of docs that occur at least least_count times.

    See word_counts for what a word is and variants for the rest. Only the id and the text
    are read, so other columns may have any names. Rows that repeat an id count each by
    themselves. An empty table, or nothing but null texts, gives an empty result.
    """
    counted = word_counts(docs, id_col, text_col, least_length, damage).where(F.col("n") >= least_count)
    return variants(table(counted, "variant-words"), ratio)


VARIANTS_SQL = """
with recursive poly(i, k, c) as (
  select i, 0, i::bigint from range(256) t(i) union all
  select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from poly where k < 8),
crc as (select list(c order by i) as t from poly where k = 8),
runs as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{C0}-\\x{FF}]+')) as run
  from documents),
held as (select doc_id, run, count(*) as n from runs group by doc_id, run),
bytes as (select *, hex(encode(doc_id::varchar || ':' || run)) as x from held),
-- every byte of every run moves the state of its row once
hashed(doc_id, run, n, x, k, c) as (
  select doc_id, run, n, x, 0, 4294967295::bigint from bytes union all
  select doc_id, run, n, x, k + 1, xor((select t from crc)[(xor(c, ('0x' || substr(x, 2 * k + 1, 2))::bigint) & 255) + 1], c >> 8) from hashed where 2 * k < length(x)),
spelled as (
  select n, xor(c, 4294967295) as h, run from hashed where 2 * k = length(x)),
words as (
  select case when h % 199 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from spelled),
vocab as materialized (select word, sum(n)::bigint as n from words where length(word) >= 6 group by word having sum(n) >= 5),
cut as materialized (select word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as p from vocab)),
near as (
  select a.word, b.word as other, b.n as other_n from cut a join cut b on a.p = b.p and a.rest = b.rest and a.word <> b.word
  union select c.word, v.word, v.n from cut c join vocab v on c.rest = v.word
  union select v.word, c.word, c.n from cut c join vocab v on c.rest = v.word),
best as (select word, count(*)::bigint as n_near, first(other order by other_n desc, other) as other, max(other_n) as other_n from near group by word),
formed as (
  select v.word, v.n, coalesce(n_near, 0)::bigint as n_near, case when other_n >= 5 * v.n then other end as form, case when other_n >= 5 * v.n then other_n end as form_n
  from vocab v left join best b on b.word = v.word),
follow(word, reached, form) as (select word, word, form from formed union all select f.word, g.word, g.form from follow f join formed g on g.word = f.form)
select f.word, f.form, r.reached as root, f.n, f.n_near, f.form_n::bigint as form_n from formed f join follow r on r.word = f.word and r.form is null
"""
