"""Nearest-neighbour retrieval in blocks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.scratch import ensure_importable


#: Bytes of vectors that a block of the history, or a part of the queries, holds.
BLOCK_BYTES = 32 << 20


def nearest(queries: DataFrame, history: DataFrame, id_col: str, vector_col: str, k: int = 12, blocks: int | None = None) -> DataFrame:
    """(query_id, neighbour_id, distance, rank): the k nearest history rows by squared distance, ties to the smaller id.

    History is dealt into blocks of about BLOCK_BYTES, queries into parts of the same size, and
    each part goes to every block, which returns its k best for each query; the best of all
    blocks are ranked: exact, with k rows a block and query, and bounded work in a task.
    A row is not its own neighbour; null vectors take no part. Distances are summed squared
    differences at any size, so equal vectors have equal distances.
    """
    ensure_importable(queries.sparkSession)
    known = lambda df: df.where(F.col(vector_col).isNotNull()).agg(F.count("*").alias("n"), F.max(F.size(vector_col)).alias("width")).first()
    of = lambda x: max(1, -(-int(x["n"]) * 8 * int(x["width"] or 1) // BLOCK_BYTES))
    size = known(history)
    blocks = blocks or max(of(size), min(8, -(-int(size["n"]) // 256)) or 1)
    parts = of(known(queries))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    h = history.where(F.col(vector_col).isNotNull()).select(F.pmod(F.xxhash64(id_col), F.lit(blocks)).alias("b"), every(parts).alias("p"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    q = queries.where(F.col(vector_col).isNotNull()).select(every(blocks).alias("b"), F.pmod(F.xxhash64(id_col), F.lit(parts)).alias("p"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = t.column("id").to_numpy()
        flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False) if t.num_rows else np.zeros(0)
        return ids, flat.reshape(len(ids), -1)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        qi, qv = matrix(left)
        hi, hv = matrix(right)
        out: list[list] = [[], [], []]
        if len(qi) and len(hi):
            order = np.argsort(hi)
            hi, hv = hi[order], hv[order]
            hn = (hv**2).sum(1)
            for at in range(0, len(qi), 256):
                some, ids = qv[at : at + 256], qi[at : at + 256]
                qn = (some**2).sum(1)
                # the product form names candidates, with a margin for what it cancels; exact sums rank them
                d = qn[:, None] + hn - 2 * some @ hv.T
                d[ids[:, None] == hi[None]] = np.inf
                last = min(k, d.shape[1]) - 1
                limit = np.partition(d, last, axis=1)[:, last] + 16 * (some.shape[1] + 8) * np.finfo(float).eps * (qn + hn.max())
                for row, (x, most) in enumerate(zip(d, limit, strict=True)):
                    at_h = np.flatnonzero((x <= most) & np.isfinite(x))
                    exact = ((some[row] - hv[at_h]) ** 2).sum(1)
                    top = np.argsort(exact, kind="stable")[:k]
                    out[0] += [ids[row]] * len(top)
                    out[1] += hi[at_h[top]].tolist()
                    out[2] += exact[top].tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "neighbour_id": pa.array(out[1], pa.int64()), "distance": pa.array(out[2], pa.float64())})

    found = q.groupBy("b", "p").cogroup(h.groupBy("b", "p")).applyInArrow(lambda a, b: best(a, b), "query_id long, neighbour_id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbour_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def distances(a: np.ndarray, b: np.ndarray, scales: Sequence[float], factor: np.ndarray | float) -> np.ndarray:
    """Mean scaled difference of each row of a and each of b, times the factor of the row of a; added in the order of the columns."""
    b, d = np.ascontiguousarray(b.T), np.zeros((len(a), len(b)))
    for k, s in enumerate(scales):
        part = a[:, k : k + 1] - b[k]
        np.abs(part, out=part)
        part /= s
        d += part
    d /= len(scales)
    d *= np.reshape(factor, (-1, 1))
    return d


def _best(d: np.ndarray, most: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the top least finite entries of each row up to most, ties to the smaller column."""
    row, col = np.nonzero((d <= most[:, None]) & np.isfinite(d))
    order = np.lexsort((col, d[row, col], row))
    row, col = row[order], col[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < top
    return row[keep], col[keep]


def _matrix(t: pa.Table, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([t.column(x).to_numpy() for x in names])


def nearest_in(asked: pa.Table, points: pa.Table, names: Sequence[str], scales: Sequence[float], top: int) -> pa.Table:
    """(spot, other, d, failed): for each visit of one cell its top points of earlier folds within the visit's bound."""
    kinds = points.schema
    out = []
    if asked.num_rows and points.num_rows:
        points = points.sort_by([("id", "ascending")])
        a, b, spot, bound, factor = _matrix(asked, names), _matrix(points, names), *[asked.column(x).to_numpy() for x in ("spot", "bound", "factor")]
        fa, fb = asked.column("fold").to_numpy(), points.column("fold").to_numpy()
        for at in range(0, len(a), 256):
            part = slice(at, at + 256)
            d = distances(a[part], b, scales, factor[part])
            d[fb[None] >= fa[part, None]] = np.inf
            row, col = _best(d, bound[part], top)
            out.append((spot[part][row], col, d[row, col]))
    spot, col, d = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.table({"spot": pa.array(spot, pa.int64()), "other": points.column("id").take(pa.array(col)).cast(kinds.field("id").type), "d": pa.array(d), "failed": points.column("failed").take(pa.array(col))})


class Cells:
    """Space of a few columns split by regime and then at medians of a sample, with the bounds of what lies in each cell."""

    def __init__(self, scales: Sequence[float]) -> None:
        self.scales, self.roots, self.regimes = scales, {}, []
        self.column, self.at, self.next, self.cell = [], [], [], []

    @classmethod
    def split(cls, regimes: list[str | None], sample: np.ndarray, sizes: dict[str | None, int], scales: Sequence[float], size: int) -> Cells:
        """Cells of about size points each, for sizes points a regime of which the sample holds some."""
        out, names = cls(scales), np.array(regimes, object)
        for regime, n in sizes.items():
            own = sample[[x == regime for x in names]] if len(names) else sample
            out.roots[regime] = out._node(own, regime, n / max(1, len(own)), size)
        out.column, out.cell, out.next, out.at = np.array(out.column), np.array(out.cell), np.array(out.next), np.array(out.at)
        return out

    def _node(self, own: np.ndarray, regime: str | None, each: float, size: int) -> int:
        node = len(self.cell)
        self.column.append(0), self.at.append(0.0), self.next.append((node, node)), self.cell.append(-1)
        if len(own) * each > size and len(own) > 1:
            k = int(np.argmax(np.ptp(np.quantile(own, [0.02, 0.98], axis=0), axis=0) / self.scales))
            k = k if np.ptp(own[:, k]) > 0 else int(np.argmax(np.ptp(own, axis=0)))
            values = np.sort(own[:, k])
            at = values[(len(values) - 1) // 2]
            at = at if at < values[-1] else values[np.searchsorted(values, at) - 1]  # something is left on the right
            if values[0] < values[-1]:
                left = own[:, k] <= at
                self.column[node], self.at[node] = k, at
                self.next[node] = (self._node(own[left], regime, each, size), self._node(own[~left], regime, each, size))
                return node
        self.cell[node] = len(self.regimes)
        self.regimes.append(regime)
        return node

    def of(self, regimes: pa.Array, x: np.ndarray) -> np.ndarray:
        """Cell of each row."""
        node = np.array([self.roots[r] for r in regimes.to_pylist()], np.int64)
        rows = np.flatnonzero(self.cell[node] < 0)
        while len(rows):
            here = node[rows]
            node[rows] = self.next[here, (x[rows, self.column[here]] > self.at[here]).astype(int)]
            rows = rows[self.cell[node[rows]] < 0]
        return self.cell[node]

    def bounded(self, own: pa.Table, names: Sequence[str]) -> Cells:
        """These cells with bounds and numbers of points, from a row (cell, fold, n, lo_x and hi_x for each name)."""
        cell, fold = own.column("cell").to_numpy(), own.column("fold").to_numpy()
        self.folds = np.unique(fold)
        self.low, self.high = np.full((len(self.regimes), len(names)), np.inf), np.full((len(self.regimes), len(names)), -np.inf)
        np.minimum.at(self.low, cell, _matrix(own, [f"lo_{x}" for x in names]))
        np.maximum.at(self.high, cell, _matrix(own, [f"hi_{x}" for x in names]))
        n = np.zeros((len(self.regimes), len(self.folds)), np.int64)
        np.add.at(n, (cell, np.searchsorted(self.folds, fold)), own.column("n").to_numpy())
        self.earlier = np.cumsum(n, axis=1) - n  # points of earlier folds
        return self

    def _reach(self, a: np.ndarray, cells: np.ndarray, factor: np.ndarray, far: bool) -> np.ndarray:
        """Least (or largest) distance that a point of each cell can have from each row of a."""
        out = 0.0
        for k, s in enumerate(self.scales):
            below, above = self.low[cells, k] - a[:, k : k + 1], a[:, k : k + 1] - self.high[cells, k]
            out = out + (np.maximum(np.abs(below), np.abs(above)) if far else np.maximum(np.maximum(below, above), 0.0)) / s
        return out / len(self.scales) * factor

    def search(self, points: pa.Table, names: Sequence[str], top: int) -> pa.Table:
        """Hits (spot, other, d, failed) of a cell's spots in the cell itself, and as further rows the visits (cell, fold, names, factor, bound) they have to make."""
        points = points.sort_by([("id", "ascending")])
        own = points.column("cell")[0].as_py()
        x, fold, r, spot = _matrix(points, names), points.column("fold").to_numpy(), points.column("r").to_numpy(), points.column("spot").to_numpy()
        asks = np.flatnonzero((r == 1) & (fold > self.folds[0]))
        factors = np.array([0.8 if g == self.regimes[own] else 1.0 for g in self.regimes])
        others = np.flatnonzero(np.arange(len(self.regimes)) != own)
        hits, visits = [], []
        for at in range(0, len(asks), 256):
            some = asks[at : at + 256]
            a, place = x[some], np.searchsorted(self.folds, fold[some])
            d = distances(a, x, self.scales, 0.8)
            d[fold[None] >= fold[some, None]] = np.inf
            last = np.partition(d, top - 1, axis=1)[:, top - 1] if d.shape[1] >= top else np.full(len(some), np.inf)
            row, col = _best(d, last, top)
            hits.append((spot[some][row], col, d[row, col]))
            bound = last.copy()
            for i in np.flatnonzero(~np.isfinite(last)):  # few earlier points here: as far as cells with enough of them reach
                far, n = self._reach(a[i : i + 1], np.arange(len(factors)), factors, True)[0], self.earlier[:, place[i]]
                far = np.where(n > 0, far, np.inf)
                order = np.argsort(far)
                enough = np.searchsorted(np.cumsum(n[order]), top)
                bound[i] = far[order[enough]] if enough < len(order) else np.inf
            bound = bound * (1 + 1e-9) + 1e-12  # sums of bounds and of distances are rounded apart
            low, high = a.min(0), a.max(0)
            apart = np.maximum(np.maximum(self.low[others] - high, low - self.high[others]), 0.0) / self.scales
            near = others[apart.mean(1) * factors[others] <= bound.max() * (1 + 1e-9)]
            i, j = np.nonzero((self._reach(a, near, factors[near], False) <= bound[:, None]) & (self.earlier[near][:, place].T > 0))
            visits.append((some[i], near[j], factors[near[j]], bound[i]))
        cat = lambda v, m: [np.concatenate(y) for y in zip(*v, strict=True)] if v else [np.zeros(0, np.int64) for _ in range(m)]
        hs, hc, hd = cat(hits, 3)
        vi, vc, vf, vb = cat(visits, 4)
        pad = lambda n, kind: pa.nulls(n, kind)
        take = lambda name, index: points.column(name).combine_chunks().take(pa.array(index, pa.int64()))
        h, v = len(hs), len(vi)
        columns = {
            "spot": pa.concat_arrays([pa.array(hs, pa.int64()), pa.array(spot[vi], pa.int64())]), "other": pa.concat_arrays([take("id", hc), pad(v, points.schema.field("id").type)]),
            "d": pa.concat_arrays([pa.array(hd, pa.float64()), pad(v, pa.float64())]), "failed": pa.concat_arrays([take("failed", hc), pad(v, pa.float64())]),
            "cell": pa.concat_arrays([pad(h, pa.int32()), pa.array(vc, pa.int32())]),
        }
        columns |= {y: pa.concat_arrays([pad(h, points.schema.field(y).type), take(y, vi)]) for y in ("fold", *names)}
        columns |= {y: pa.concat_arrays([pad(h, pa.float64()), pa.array(w, pa.float64())]) for y, w in (("factor", vf), ("bound", vb))}
        return pa.table(columns)


def weighted_success(neighbours: DataFrame, outcomes: DataFrame, id_col: str, value_col: str) -> DataFrame:
    """Mean outcome of each query's neighbours, weighted by inverse squared distance."""
    o = outcomes.select(F.col(id_col).alias("__o"), F.col(value_col).cast("double").alias("__v"))
    w = 1 / F.greatest(F.col("distance") + 1e-6, F.lit(1e-6))
    return neighbours.join(o, F.col("neighbour_id") == F.col("__o")).groupBy("query_id").agg((F.sum(w * F.col("__v")) / F.sum(w)).alias("success"))


def standardised(rows: DataFrame, history: DataFrame, columns: Sequence[str], id_col: str, vector_col: str = "vector") -> DataFrame:
    """(id, vector): the columns less the history's medians, over its deviations (1 where there is none), missing values as the median."""
    from tidemark.functions.quantiles import exact_quantiles

    middle = [exact_quantiles(history, [], x, [0.5]).first() for x in columns]
    spread = history.agg(*[F.stddev_pop(x).alias(x) for x in columns]).first()
    z = []
    for x, m in zip(columns, middle, strict=True):
        level, scale = (m["q"][0] if m else 0.0), spread[x]
        z.append(F.coalesce((F.col(x).cast("double") - F.lit(level)) / F.lit(scale if scale is not None and scale >= 1e-6 else 1.0), F.lit(0.0)))
    return rows.select(id_col, F.array(*z).alias(vector_col))
