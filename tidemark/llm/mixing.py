"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import quoted
from tidemark.scratch import table

#: Bits of the hash that one histogram level resolves, and number of levels.
LEVEL_BITS, LEVELS = 12, 3


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Targets by water filling over (source, source_size), one row a source.

    Sources in code-point order, null last, get the weights in turn; a target that would
    pass cap * source_size stops there and the excess is shared among the rest by weight.
    """
    total = Window.partitionBy()
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(rank) - 1) % len(weights)
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int"))
    rows = (
        sizes.withColumn("w", w)
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("most") / F.col("w"))
        .withColumn("budget", F.sum("source_size").over(total) * F.lit(float(share)))
        .withColumn("w_all", F.sum("w").over(total))
    )
    left = F.col("budget") - F.coalesce(F.sum("most").over(fill), F.lit(0.0))
    level = left / (F.col("w_all") - F.coalesce(F.sum("w").over(fill), F.lit(0.0)))
    rows = rows.withColumn("level", level).withColumn("capped", F.col("level") >= F.col("ratio"))
    free = F.max(F.when(~F.col("capped"), F.col("level"))).over(total)  # levels fall after the first free source
    target = F.when(F.col("capped"), F.col("most")).otherwise(F.col("w") * free)
    return rows.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
) -> DataFrame:
    """Words of each document that a mix of the sources takes.

    Returns (doc_id, source, size, source_size, target, copies, taken): size is the number
    of words `[^\\x20\\x09-\\x0D]+` (null text: 0); every document of a source is taken
    floor(target / source_size) times, and those below the source's hash threshold once
    more. The threshold is where the summed size comes nearest to what is left, found by
    summing sizes per (source, hash bucket) and refining only the boundary bucket, level by
    level; documents are never sorted. The hash is a digest of the id, so reruns agree, a
    repeated row shares its twin's fate, and a null id counts as the empty id. Null sources
    form one source of their own, placed last. An empty table gives an empty result.
    """
    sized, cut = _thresholds(docs, id_col, text_col, source_col, weights, share, cap)
    copies = _copies(F.col("h"), cap)
    return sized.join(cut, F.col("source").eqNullSafe(F.col("c_source"))).select(
        "doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
    )


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
) -> DataFrame:
    """The rows of docs as often as mix takes them, with all their columns; texts without words are not taken.

    Once the thresholds are known, one row a source, the documents are only filtered: their
    texts are not shuffled.
    """
    _, cut = _thresholds(docs, id_col, text_col, source_col, weights, share, cap)
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), F.col(quoted(source_col)).alias("source"), _size(text_col).alias("size"), _hash(id_col).alias("h"))
    taken = rows.join(cut, F.col("source").eqNullSafe(F.col("c_source"))).where("size > 0").withColumn("copies", _copies(F.col("h"), cap).cast("long"))
    each = taken.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def _size(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(quoted(text_col)), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hash(id_col: str) -> Column:
    digest = F.md5(F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, LEVEL_BITS * LEVELS // 4), 16, 10).cast("long")


def _copies(h: Column, cap: float) -> Column:
    return F.col("whole") + F.when((h < F.col("h_end")) & (F.col("whole") < F.lit(int(cap))), 1).otherwise(0)


def _thresholds(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float], share: float, cap: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, h) of all rows, and (c_source, source_size, target, whole, h_end) of all sources."""
    bits = LEVEL_BITS * LEVELS
    sized = table(docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(source_col)).alias("source"), _size(text_col).alias("size"), _hash(id_col).alias("h")), "mix-sizes")
    shift = bits - LEVEL_BITS
    level1 = table(
        sized.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("s")), "mix-level"
    )
    sources = level1.groupBy("source").agg(F.sum("s").alias("source_size"))
    targets = source_targets(sources, weights, share, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    edge = table(
        targets.withColumn("whole", whole.cast("long"))
        .withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("low", F.lit(0).cast("long")),
        "mix-edge",
    )
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    for level in range(LEVELS):
        shift = bits - LEVEL_BITS * (level + 1)
        if level == 0:
            hist = level1
        else:
            e = edge.select(F.col("source").alias("e_source"), "low")
            inside = sized.join(e, F.col("source").eqNullSafe(F.col("e_source"))).where(
                F.shiftright("h", shift + LEVEL_BITS) == F.col("low")
            )
            hist = inside.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("s"))
        run = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        h = hist.withColumn("before", F.coalesce(F.sum("s").over(run), F.lit(0))).alias("h")
        x = edge.alias("x")
        # the boundary bucket is the last one whose lower end does not pass what is needed
        hit = (
            x.join(h, F.col("x.source").eqNullSafe(F.col("h.source")), "left")
            .where(F.col("h.b").isNull() | (F.col("h.before") <= F.col("x.need")))
            .groupBy("x.source", "x.source_size", "x.target", "x.whole")
            .agg(F.max_by(F.struct("x.need", "h.before", "h.b", "h.s"), F.col("h.b")).alias("at"), F.first("x.need").alias("n0"))
        )
        edge = table(
            hit.select(
                "source",
                "source_size",
                "target",
                "whole",
                (F.coalesce(F.col("at.need"), F.col("n0")) - F.coalesce(F.col("at.before"), F.lit(0))).alias("need"),
                F.coalesce(F.col("at.b"), F.lit(0).cast("long")).alias("low"),
                F.coalesce(F.col("at.s"), F.lit(0).cast("long")).alias("s"),
            ),
            "mix-edge",
        )
    # one hash value is left: it is taken if that brings the sum nearer
    limit = F.when(F.col("need") * 2 >= F.col("s"), F.col("low") + 1).otherwise(F.col("low"))
    cut = table(edge.select(F.col("source").alias("c_source"), "source_size", "target", "whole", limit.alias("h_end")), "mix-cut")
    return sized, cut


#: The whole method in one statement: thresholds are where the running size by hash comes nearest to the need.
MIX_SQL = """
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 9))::bigint as h
  from documents),
src as (
  select source, sum(size)::bigint as source_size,
         list_value(3.0::double, 1.0::double, 2.0::double)[1 + (row_number() over (order by source nulls last) - 1) % 3] as w
  from sized group by source),
ratio as (select *, source_size * 2.0::double / w as ratio, sum(source_size) over () * 1.5::double as budget, sum(w) over () as w_all from src),
filled as (
  select *, (budget - coalesce(sum(source_size * 2.0::double) over p, 0)) / (w_all - coalesce(sum(w) over p, 0)) as lvl
  from ratio window p as (order by ratio, source nulls last rows between unbounded preceding and 1 preceding)),
flagged as (select *, lvl >= ratio as capped from filled),
free as (select max(lvl) filter (where not capped) as lvl from flagged),
targets as (
  select source, source_size, case when capped then source_size * 2.0::double else w * free.lvl end as target
  from flagged, free),
needs as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole from targets),
byhash as (
  select s.source, s.h, sum(s.size) as s, any_value(n.target - n.whole * n.source_size) as need
  from sized s join needs n on s.source is not distinct from n.source group by s.source, s.h),
cut as (select source, h, (need - (sum(s) over (partition by source order by h) - s)) * 2 >= s as more from byhash)
select s.doc_id, s.size, n.source_size, n.target, (s.size * (n.whole + case when c.more and n.whole < 2 then 1 else 0 end))::bigint as taken
from sized s join needs n on s.source is not distinct from n.source
join cut c on s.source is not distinct from c.source and s.h = c.h
"""
