"""Conformal prediction sets for a binary outcome: split, by group, and adaptive over sessions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cols import clip
from tidemark.scratch import ensure_importable, table

c = F.col
EPS = 1e-6
#: Rows that a range of counts_before holds.
BUCKET_ROWS = 500_000


def nonconformity(y: Column, p: Column) -> Column:
    """1 - p of the class that came true."""
    q = clip(p, EPS, 1 - EPS)
    return F.when(y == 1, 1 - q).otherwise(q)


def at_or_above(bank: DataFrame, asked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, t, above, n): bank scores (keys, score) not below each asked value (keys, t), and how many scores there are.

    Equal values are counted before they are sorted, so a window holds the different values
    of a key and not its rows.
    """
    keys = list(keys)
    held = bank.where(c("score").isNotNull()).groupBy(*keys, c("score").alias("t")).agg(F.count("*").alias("k"))
    wanted = asked.where(c("t").isNotNull()).select(*keys, "t").distinct()
    both = held.select(*keys, "t", "k", F.lit(0).alias("ask")).unionByName(wanted.select(*keys, "t", F.lit(0).cast("long").alias("k"), F.lit(1).alias("ask")))
    down = Window.partitionBy(*keys).orderBy(c("t").desc()).rangeBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(*keys)
    return both.withColumns({"above": F.sum("k").over(down), "n": F.sum("k").over(total)}).where("ask = 1").select(*keys, "t", "above", "n")


def _on(keys: Sequence[str], prefix: str) -> list[Column]:
    return [c(k).eqNullSafe(c(f"{prefix}{k}")) for k in keys]


def _p_values(calibration: DataFrame, test: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """test with prefix-columns n, p0 and p1 of the bank of its keys; null where the bank is empty."""
    q = clip(c("p"), EPS, 1 - EPS)
    asked = test.select(*keys, F.explode(F.array(q, 1 - q)).alias("t"))
    counts = at_or_above(calibration, asked, keys)
    out = test
    for name, t in (("1", 1 - q), ("0", q)):
        got = counts.select(*[c(k).alias(f"{prefix}{k}") for k in keys], c("t").alias(f"{prefix}t"), c("above").alias(f"{prefix}a{name}"), c("n").alias(f"{prefix}n{name}"))
        out = out.join(got, [*_on(keys, prefix), t == c(f"{prefix}t")], "left").drop(*[f"{prefix}{k}" for k in keys], f"{prefix}t")
        out = out.withColumn(f"{prefix}p{name}", (1 + c(f"{prefix}a{name}")) / (1 + c(f"{prefix}n{name}"))).drop(f"{prefix}a{name}")
    return out.withColumnRenamed(f"{prefix}n1", f"{prefix}n").drop(f"{prefix}n0")


def _sets(df: DataFrame, alpha: float | Column) -> DataFrame:
    level = F.lit(float(alpha)) if isinstance(alpha, float) else alpha
    df = df.withColumns({"has0": c("p0") > level, "has1": c("p1") > level, "predicted": (c("p") >= 0.5).cast("int")})
    return df.withColumns({"set_size": c("has0").cast("int") + c("has1").cast("int"), "p_predicted": F.when(c("predicted") == 1, c("p1")).otherwise(c("p0"))})


def prediction_sets(calibration: DataFrame, test: DataFrame, keys: Sequence[str], alpha: float = 0.1) -> DataFrame:
    """test (keys, p) with p0, p1, has0, has1, predicted, set_size and p_predicted from the calibration rows (keys, y, p) of its keys."""
    bank = calibration.select(*keys, nonconformity(c("y"), c("p")).alias("score"))
    found = _p_values(bank, test, keys, "__").withColumnsRenamed({"__p0": "p0", "__p1": "p1"}).drop("__n")
    return _sets(found, float(alpha))


def group_prediction_sets(calibration: DataFrame, test: DataFrame, keys: Sequence[str], group: str, alpha: float = 0.1, least: int = 50) -> DataFrame:
    """prediction_sets by (keys, group); a group with fewer than least calibration rows uses those of all groups (fallback)."""
    bank = calibration.select(*keys, group, nonconformity(c("y"), c("p")).alias("score"))
    found = _p_values(bank, test, [*keys, group], "__g_")
    found = _p_values(bank.drop(group), found, keys, "__a_")
    own = F.coalesce(c("__g_n"), F.lit(0)) >= least
    found = found.withColumns({"fallback": ~own, "p0": F.when(own, c("__g_p0")).otherwise(c("__a_p0")), "p1": F.when(own, c("__g_p1")).otherwise(c("__a_p1"))})
    return _sets(found.drop(*[f"__{x}_{y}" for x in "ga" for y in ("n", "p0", "p1")]), float(alpha))


def smaller_before(s: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For each place of an order, the sum of k over the places before it whose s (0 or more) is smaller.

    s is read bit by bit: at the first bit in which two numbers differ, the smaller one has a 0.
    """
    out = np.zeros(len(s), np.int64)
    s = s.astype(np.uint16 if s.max(initial=0) < 1 << 16 else np.uint32)  # 16 bits are sorted by radix
    for bit in range(int(s.max(initial=0)).bit_length()):
        order = np.argsort(s >> (bit + 1), kind="stable")
        high, one = (s >> (bit + 1))[order], (s[order] >> bit & 1).astype(bool)
        run = np.concatenate([[0], np.cumsum(np.where(one, 0, k[order]))])
        first = np.flatnonzero(np.concatenate([[True], high[1:] != high[:-1]]))
        start = np.repeat(run[first], np.diff(np.append(first, len(s))))
        out[order[one]] += run[:-1][one] - start[one]
    return out


def _whole(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    """The columns of a task's rows."""
    held = list(batches)
    return [pa.chunked_array([x.column(k) for x in held]).to_numpy() for k in range(held[0].num_columns)] if held else []


def counts_before(cells: DataFrame, parts: int) -> DataFrame:
    """cells (id, s, q, a, b) with up and down: how many scores of places before s are 1 - q or q, whichever is larger, or above; and how many are below the smaller one.

    a rows of a cell have the score 1 - q and b rows the score q. A score is not below 0.5 (an
    upper one) or below it (a lower one), and what is asked is symmetric about 0.5 too: if h is the
    larger of q and 1 - q, the scores asked for are upper ones with an h as large, and lower ones
    with a smaller 1 - h, so both lie before the cell when cells are put in falling order of h. Each
    task holds a range of that order, with all cells of an h, and counts in it; what the
    ranges before it hold is added from a row a range and place. parts is the number of ranges.
    """
    h = F.greatest("q", 1 - c("q"))
    upper = F.when(c("q") <= 0.5, c("a")).otherwise(0) + F.when(c("q") >= 0.5, c("b")).otherwise(0)
    named = "id long, s int, q double, a long, b long"
    ranged = cells.select("id", "s", "q", "a", "b", upper.alias("u"), h.alias("h")).repartitionByRange(parts, c("id"), c("h").desc()).select("id", "s", "q", "a", "b", "u", F.spark_partition_id().alias("v"))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = _whole(batches)
        if not columns:
            return
        by_id = np.argsort(columns[0], kind="stable")
        for own in np.split(by_id, np.flatnonzero(np.diff(columns[0][by_id])) + 1):
            id_, s, q, a, b, u, v = (x[own] for x in columns)
            up, down = np.empty(len(q), np.int64), np.empty(len(q), np.int64)
            order = np.lexsort((s, -np.maximum(q, 1 - q)))
            up[order] = smaller_before(s[order], u[order])
            order = np.lexsort((-s, np.minimum(q, 1 - q)))
            down[order] = smaller_before(s[order], (a + b - u)[order])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (id_, s, q, a, b, u, v, up, down)], names=["id", "s", "q", "a", "b", "u", "v", "up", "down"])

    def across(_: tuple, ranges: pa.Table) -> pa.Table:
        v, s, u, d = (ranges.column(x).to_numpy() for x in ("v", "s", "u", "d"))
        order = np.lexsort((-s, v))  # of a range, larger places first: they do not count for it
        got = [smaller_before(s[order], k[order]) for k in (u, d)]
        return pa.table({"id": ranges.column("id").take(pa.array(order)), "v": v[order], "s": s[order], "u": got[0], "d": got[1]})

    counted = table(ranged.mapInArrow(within, f"{named}, u long, v int, up long, down long"), "earlier-counts")
    sums = counted.groupBy("id", "v", "s").agg(F.sum("u").alias("u"), F.sum(c("a") + c("b") - c("u")).alias("d"))
    before = table(sums.groupBy("id").applyInArrow(across, "id long, v int, s int, u long, d long"), "earlier-ranges")
    before = before.select("id", "v", "s", c("u").alias("bu"), c("d").alias("bd"))
    return counted.join(before, ["id", "v", "s"]).select("id", "s", "q", "a", "b", (c("up") + c("bu")).alias("up"), (c("down") + c("bd")).alias("down"))


def session_levels(counts: DataFrame, alpha: float, gamma: float, low: float, high: float) -> DataFrame:
    """(place, alpha_used) of every session in counts (id, place, s, v, k): k rows of session s, whose number is place, with p-value v.

    The level of a session follows from the misses of those before it, so the sessions of a
    key (id) are read in their order by one task, which holds one level and two sums.
    """
    start = min(max(alpha, low), high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, at, missed, n = start, None, 0, 0
        for batch in batches:
            place, s, v, k = (x.to_numpy() for x in batch.columns)
            found = []
            for rows in np.split(np.arange(len(place)), np.flatnonzero(np.diff(place)) + 1):
                if len(rows) and place[rows[0]] != at:
                    if s[rows[0]] == 1:
                        level = start
                    elif n:
                        level = min(max(level + gamma * (alpha - missed / n), low), high)
                    at, missed, n = place[rows[0]], 0, 0
                    found.append((at, level))
                missed += int(k[rows][v[rows] <= level].sum())
                n += int(k[rows].sum())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.float64())], names=["place", "alpha_used"])

    ordered = counts.repartition("id").sortWithinPartitions("id", "s").select("place", "s", "v", "k")
    return ordered.mapInArrow(run, "place long, alpha_used double")


def adaptive_sets(
    calibration: DataFrame, test: DataFrame, keys: Sequence[str], session: str = "session_date", alpha: float = 0.1, gamma: float = 0.02, low: float = 0.01, high: float = 0.5
) -> DataFrame:
    """prediction_sets whose level and bank follow the sessions.

    A session is scored by the level in force and by the scores known before it; once its
    outcomes are there, the level moves by gamma * (alpha - miss rate), held in [low, high],
    and its scores join the bank. Adds alpha_used. Rows of a session with the same p are one cell,
    and earlier scores are counted once for a cell (counts_before); only the level goes from
    session to session, over counts of different p-values between low and high. A null session comes first. Rows without p have
    null p-values and, like rows without y, neither count as missed nor join the bank.
    """
    ensure_importable(test.sparkSession)
    key = lambda: F.struct(*[c(k) for k in keys]).alias("key")
    q = clip(F.when(~F.isnan("p"), c("p")), EPS, 1 - EPS)
    scored = c("q").isNotNull() & c("y").isNotNull()
    old = calibration.select(key(), q.alias("q"), "y").where(scored)
    days = test.select(key(), c(session).alias("day"), q.alias("q"), "y").groupBy("key", "day").agg(F.count(F.when(scored, 1)).alias("k"), F.count("q").alias("m"))
    first = old.groupBy(c("key").alias("k0")).agg(F.count("*").alias("n0"))
    line = Window.partitionBy("key").orderBy("day")  # a row a session
    days = days.withColumns({"s": F.row_number().over(line), "n": F.coalesce(F.sum("k").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}).join(first, c("key") == c("k0"), "left")
    days = days.select("key", "day", "s", (c("n") + F.coalesce("n0", F.lit(0))).alias("n"), "m", F.coalesce("n0", F.lit(0)).alias("n0"), F.monotonically_increasing_id().alias("place"))
    days = table(days, "adaptive-sessions")
    size = days.agg(F.coalesce(F.sum("m") + F.sum(F.when(c("s") == 1, c("n0"))), F.lit(0))).first()[0]
    days = days.withColumn("id", F.min("place").over(Window.partitionBy("key")))

    rows = test.select(F.struct(*[c(f"`{x}`") for x in test.columns]).alias("row"), key().alias("rk"), c(session).alias("rd"), q.alias("q"), c("y"))
    rows = rows.join(days, (c("rk") == c("key")) & c("rd").eqNullSafe(c("day"))).select("row", "id", "place", "s", "q", "y")
    rows = table(rows, "adaptive-rows")
    old = old.join(days.where("s = 1").select(c("key").alias("k0"), "id"), c("key") == c("k0")).select("id", F.lit(0).alias("s"), "q", "y")
    cells = old.unionByName(rows.where("q is not null").select("id", "s", "q", "y"))
    cells = cells.groupBy("id", "s", "q").agg(F.count(F.when(c("y") == 1, 1)).alias("a"), F.count(F.when(c("y") != 1, 1)).alias("b"))
    found = counts_before(cells, min(1 + size // BUCKET_ROWS, 1 << 16)).where("s > 0").join(days.select("id", "s", "n", "place"), ["id", "s"])
    larger, smaller = (1 + c("up")) / (1 + c("n")), (1 + c("n") - c("down")) / (1 + c("n"))
    found = found.select("id", "s", "place", "q", "a", "b", F.when(c("q") <= 0.5, larger).otherwise(smaller).alias("p1"), F.when(c("q") >= 0.5, larger).otherwise(smaller).alias("p0"))

    own = found.select("id", "place", "s", F.explode(F.array(F.struct(c("p1").alias("v"), c("a").alias("k")), F.struct(c("p0").alias("v"), c("b").alias("k")))).alias("z"))
    v = c("z.v")
    sure = F.when(v <= low, 0.0).when(v > high, 2.0).otherwise(v)  # missed or met whatever the level
    counts = own.where("z.k > 0").groupBy("id", "place", "s", sure.alias("v")).agg(F.sum("z.k").alias("k"))
    counts = counts.unionByName(days.select("id", "place", "s", F.lit(2.0).alias("v"), F.lit(0).cast("long").alias("k")))
    levels = table(session_levels(counts, alpha, gamma, low, high), "adaptive-levels").withColumnRenamed("place", "at")
    asked = found.select(c("id").alias("fk"), c("s").alias("fs"), c("q").alias("fq"), "p0", "p1")
    out = rows.join(levels, c("place") == c("at")).join(asked, (c("id") == c("fk")) & (c("s") == c("fs")) & (c("q") == c("fq")), "left").select("row.*", "p0", "p1", "alpha_used")
    return _sets(out, c("alpha_used"))
