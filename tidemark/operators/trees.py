"""Histogram trees: leaf-wise boosting with logistic, squared and pinball loss, and extremely randomised trees.

Features become codes of one byte, the places of their values among quantiles, and rows are kept
in blocks of about 1 MB, so that a pass moves whole blocks to Python. Rows stay where
they are: a task adds up what its rows say about each code, and only such sums go to other tasks.
The tasks of a boosted model hold their rows until its trees are grown; for forests, every level of
the trees is a pass. The driver sees trees and a row a node, never rows of data.

All sums are of whole numbers (fixed-point gradients and weights), so they do not depend on the
order in which tasks finish: a model is the same however its rows are partitioned.
"""

from __future__ import annotations

import heapq
import math
import mmap
import os
import pickle
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidemark.scratch import drop, drop_folder, ensure_importable, shared_folder, table

c = F.col
#: Fixed point of gradients and weights; trees that a job grows, which is what the loss of an executor costs at most.
UNIT, REFRESH = 1 << 24, 250
#: Bytes of a block of rows; rows that a boosting task holds, if there are cores enough.
BLOCK_BYTES, TASK_ROWS = 1 << 20, 1_000_000
#: Least sum of second derivatives on a side of a split.
LEAST_HESSIAN = 1e-3
Tree = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # feature, code, left, right (-1: leaf), value


# codes ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Bins:
    """Medians, which stand in for unknown values, and the rising edges of each feature's codes."""

    features: tuple[str, ...]
    medians: tuple[float, ...]
    edges: tuple[tuple[float, ...], ...]

    def codes(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        """(rows, features): how many edges lie below each value."""
        out = np.empty((len(columns[0]) if columns else 0, len(self.features)), np.uint8)
        for k, (v, m, e) in enumerate(zip(columns, self.medians, self.edges, strict=True)):
            out[:, k] = np.searchsorted(np.array(e), np.where(np.isnan(v), m, v), side="left")
        return out

    @property
    def top(self) -> np.ndarray:
        """The largest code of each feature."""
        return np.array([len(e) for e in self.edges])


def fit_bins(df: DataFrame, features: Sequence[str], bins: int = 255, accuracy: int = 10_000) -> Bins:
    """Edges at the quantiles k / bins of each feature, and its median, from one pass of Spark's quantile sketch.

    Null and nan are left out; a feature without values has one code. The sketch's rank error
    is 1 / accuracy.
    """
    known = {x: F.when(~F.isnan(c(x).cast("double")), c(x).cast("double")) for x in features}
    levels = [0.5, *[k / bins for k in range(1, bins)]]
    one = df.agg(*[F.percentile_approx(v, levels, accuracy).alias(f"q{k}") for k, v in enumerate(known.values())]).first()
    found = [one[f"q{k}"] or [0.0] for k in range(len(known))]
    return Bins(tuple(features), tuple(float(q[0]) for q in found), tuple(tuple(sorted(set(map(float, q[1:])))) for q in found))


@dataclass(frozen=True)
class Blocks:
    """Coded rows of a table whose label and weight are known; models of one label can share them."""

    bins: Bins
    rows: DataFrame = field(repr=False)
    n: int
    top_weight: float
    top_label: float


_BLOCK = "n long, x binary, y binary, w binary, f binary"


def blocks(df: DataFrame, features: Sequence[str], label: str, weight: str | None = None, bins: Bins | int = 255) -> Blocks:
    """The rows of df in blocks (n, x: codes feature by feature, y, w, f: doubles; no w: 1, no f: 0)."""
    ensure_importable(df.sparkSession)
    found = bins if isinstance(bins, Bins) else fit_bins(df, features, bins)
    names = [f"f{k}" for k in range(len(found.features))]
    w = c(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(*[c(x).cast("double").alias(n) for x, n in zip(found.features, names, strict=True)], c(label).cast("double").alias("y"), *([w.alias("w")] if weight else []))
    rows = rows.where(c("y").isNotNull() & ~F.isnan("y"))
    rows = rows.where(c("w").isNotNull() & (c("w") >= 0)) if weight else rows
    most = max(1, BLOCK_BYTES // (len(names) + 24))

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        column = lambda name: t.column(name).to_numpy().astype(float)
        y, w = column("y"), column("w") if weight else None
        x = found.codes([column(n) for n in names])
        one = _as_block(np.ascontiguousarray(x.T), y, w, None)
        return pa.RecordBatch.from_arrays([*one.columns, pa.array([1.0 if w is None else float(w.max())]), pa.array([float(np.abs(y).max())])], names=[*one.schema.names, "tw", "ty"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held, size = [*held, batch], size + batch.num_rows
            if size >= most:
                yield block(held)
                held, size = [], 0
        if held:
            yield block(held)

    out = table(rows.mapInArrow(run, f"{_BLOCK}, tw double, ty double"), "tree-rows")
    top = out.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("tw").alias("w"), F.max("ty").alias("y")).first()
    return Blocks(found, out, top["n"], top["w"] or 0.0, top["y"] or 0.0)


def _as_block(x: np.ndarray, y: np.ndarray, w: np.ndarray | None, f: np.ndarray | None) -> pa.RecordBatch:
    binary = [pa.array([b"" if v is None else v.tobytes()], pa.binary()) for v in (x, y, w, f)]
    return pa.RecordBatch.from_arrays([pa.array([len(y)]), *binary], names=["n", "x", "y", "w", "f"])


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]]:
    """x (rows, features), y, w (None: 1) and f of each block."""
    for batch in batches:
        for k in range(batch.num_rows):
            n = batch.column("n")[k].as_py()
            raw = [batch.column(name)[k].as_buffer() for name in "xywf"]
            y, w, f = (np.frombuffer(v, float) if v.size else None for v in raw[1:])
            yield np.frombuffer(raw[0], np.uint8).reshape(width, n).T, y, w, np.zeros(n) if f is None else f


def _units(v: np.ndarray, w: np.ndarray | None, unit: float) -> np.ndarray:
    """Weighted values in whole units."""
    return np.rint((v if w is None else w * v) * unit)


def leaf_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The node of a tree in which each row ends."""
    feature, code, left, right, _ = tree
    n = len(x)
    node = np.zeros(n, np.int64)
    if left[0] < 0 or not n:
        return node
    flat = np.ascontiguousarray(x.T).reshape(-1)  # no copy of a block's codes
    inner, own = left >= 0, np.arange(len(left))
    column, code = feature * n, code.astype(np.uint8)
    child = np.stack([np.where(inner, right, own), np.where(inner, left, own)], 1).reshape(-1)  # a leaf is its own child
    rows, at, step = np.arange(n), node, 0
    while True:
        at = child.take(2 * at + (flat.take(column.take(at) + rows) <= code.take(at)))
        step += 1
        if step % 3 == 0 or len(left) < 1 << step + 1:  # rows that have ended are left out from time to time
            on = inner.take(at)
            ended = len(at) - np.count_nonzero(on)
            if ended == len(at) or 4 * ended > len(at):
                node[rows] = at
                rows, at = rows[on], at[on]
                if not len(rows):
                    return node


def _summed(trees: Sequence[Tree], x: np.ndarray, start: np.ndarray) -> np.ndarray:
    for t in trees:
        start = start + t[4].take(leaf_of(t, x))
    return start


# boosting -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Loss:
    """What is boosted: log (labels 0 and 1), squared, or pinball at a level."""

    name: str
    level: float = 0.5

    def gradients(self, y: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.name == "log":
            p = 1 / (1 + np.exp(-np.clip(f, -50, 50)))
            return p - y, p * (1 - p)
        if self.name == "squared":
            return f - y, np.ones(len(y))
        return np.where(y >= f, -self.level, 1 - self.level), np.ones(len(y))


@dataclass
class _Node:
    g: float
    h: float
    n: int
    parent: int = -1
    best: tuple | None = None  # gain, feature, code, and g, h, n of the left side
    looked_at: bool = False
    left: int = -1
    right: int = -1


@dataclass(frozen=True)
class Boosted:
    """A boosted model; scores are the sum of the start and of each tree's value, a probability with the logistic loss."""

    bins: Bins
    loss: Loss
    start: float
    trees: tuple[Tree, ...] = field(repr=False)

    def predict(self, df: DataFrame, name: str) -> DataFrame:
        ensure_importable(df.sparkSession)

        def of(x: np.ndarray) -> np.ndarray:
            f = _summed(self.trees, x, np.full(len(x), self.start))
            return 1 / (1 + np.exp(-np.clip(f, -50, 50))) if self.loss.name == "log" else f

        return _predicted(df, self.bins, of, name)


def _predicted(df: DataFrame, bins: Bins, of: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    @pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(of(bins.codes([v.to_numpy(float) for v in columns])))

    return df.withColumn(name, score(*[c(x).cast("double") for x in bins.features]))


def fit_boosted(
    df: DataFrame | Blocks,
    features: Sequence[str],
    label: str,
    loss: str = "log",
    level: float = 0.5,
    rounds: int = 300,
    rate: float = 0.04,
    leaves: int = 31,
    least: int = 20,
    ridge: float = 1.0,
    weight: str | None = None,
    bins: Bins | int = 255,
    share: int = 1,
) -> Boosted:
    """Gradient boosting with trees that grow leaf by leaf, the leaf with the largest gain first.

    The gain of a split is G_l^2 / (H_l + ridge) + G_r^2 / (H_r + ridge) - G^2 / (H + ridge);
    each side has least rows at least. Ties go to the first feature and the lowest code, and
    among leaves to the older one. Values are -rate * G / (H + ridge); with the pinball loss
    they are rate times the level's exact quantile of the residuals in the leaf (the smallest
    one that the share of weight at or below it reaches). Rows without a label are left out,
    unknown features count as the median. Without rows the model is the constant 0. Blocks
    stand for a table, its label, weight and bins.

    The tasks of one barrier stage (one task alone, where the scratch folder is no folder of files) hold the rows and grow REFRESH trees together: each adds up
    its own rows, all sum what all have found, and so take the same splits. A task has about
    TASK_ROWS rows, or more where the cores, of which share models have a part each, are fewer.
    Nodes are looked at many at a time: whenever the order of splits waits for the gains of a
    leaf's children, the other leaves that can still be split are looked at as well. Only the
    smaller child of a split is counted; the larger one is what is left of the node.
    """
    given = df if isinstance(df, Blocks) else blocks(df, features, label, weight, bins)
    found, how = given.bins, Loss(loss, level)
    if not given.n or not given.top_weight:
        return Boosted(found, how, 0.0, ())
    w_unit = UNIT / given.top_weight
    g_unit = w_unit / (2 * given.top_label or 1.0 if loss == "squared" else 1.0)
    tasks = _team_size(given, share)
    folder = shared_folder(given.rows.sparkSession, "boosting-sums") if tasks > 1 else None
    tasks = tasks if folder else 1
    dealt = given.rows.repartition(tasks) if tasks > 1 else given.rows.coalesce(1)
    start: float | None = None
    grown: list[Tree] = []
    while len(grown) < rounds or start is None:
        more = min(REFRESH, rounds - len(grown))

        def run(batches: Iterator[pa.RecordBatch], start=start, before=tuple(grown), more=more) -> Iterator[pa.RecordBatch]:
            team = _Team(tasks, folder)
            try:
                got = _boosted_by(team, batches, len(found.features), how, start, before, more, (g_unit, w_unit), leaves, least, ridge, rate)
            finally:
                team.close()
            if team.me == 0:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(got)], pa.binary())], names=["model"])

        start, new = pickle.loads(dealt.mapInArrow(run, "model binary", barrier=tasks > 1).collect()[0]["model"])
        grown += new
        if len(new) < more:
            break
    if tasks > 1:
        drop_folder(given.rows.sparkSession, folder)
    if given is not df:
        drop(given.rows)
    return Boosted(found, how, start, tuple(grown))


def _team_size(given: Blocks, share: int) -> int:
    """Tasks that hold the rows together; one where executors come and go, as barrier stages cannot run there."""
    context = given.rows.sparkSession.sparkContext
    if context.getConf().get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 1
    inner = context._jsc.sc()
    slots = inner.maxNumConcurrentTasks(inner.resourceProfileManager().defaultResourceProfile())
    return max(1, min(slots // max(share, 1), -(-given.n // TASK_ROWS)))


@dataclass
class _Held:
    """A block in a task's file: codes feature by feature, label, weight, score, gradients in units, and the node of each row."""

    x: np.ndarray
    y: np.ndarray
    w: np.ndarray | None
    f: np.ndarray
    g: np.ndarray
    h: np.ndarray | None
    node: np.ndarray


class _Team:
    """The tasks of a barrier stage, of which each has some of the rows; alone, a task that has all.

    Sums go through files of the shared folder: Spark's own exchange between barrier tasks looks
    for answers once a second, and a tree takes about ten.
    """

    def __init__(self, tasks: int, folder: str | None):
        self.tasks, self.step, self.me, self.folder = tasks, 0, 0, folder
        if tasks > 1:
            context = BarrierTaskContext.get()
            self.me = context.partitionId()
            self.folder = os.path.join(folder, context.allGather(uuid.uuid4().hex)[0])  # another attempt has another name
            os.makedirs(self.folder, exist_ok=True)
        self.file = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)  # rows are pages of it: memory can do without them

    def close(self) -> None:
        self.file.close()

    def sum(self, own: np.ndarray) -> np.ndarray:
        """Whole numbers added up over all tasks."""
        if self.tasks == 1:
            return own
        self.step += 1
        name = lambda step, task: os.path.join(self.folder, f"{step}-{task}")
        with open(name(self.step, f"{self.me}.part"), "wb") as out:
            out.write(np.ascontiguousarray(own).data)
        os.rename(out.name, name(self.step, self.me))
        total = own.copy()
        for task in range(self.tasks):
            if task != self.me:
                while not os.path.exists(name(self.step, task)):  # a task that fails ends the whole stage
                    time.sleep(0.0005)
                total += np.fromfile(name(self.step, task), np.int64).reshape(own.shape)
        if self.step > 1:  # all have read it
            os.remove(name(self.step - 1, self.me))
        return total

    def hold(self, batches: Iterator[pa.RecordBatch], width: int, second: bool) -> list[_Held]:
        """The blocks, written to the task's file and mapped, with scores 0 at node 0; second: with room for second derivatives."""
        known = []
        for x, y, w, _ in _blocks(batches, width):
            n = len(y)
            self.file.write(y.tobytes() + (b"" if w is None else w.tobytes()) + bytes(8 * n + (8 if second else 4) * n + 2 * n) + x.T.tobytes() + bytes(-(2 * n + width * n + (8 if second else 4) * n) % 8))
            known.append((n, w is not None))
        self.file.flush()
        mapped, at, out = mmap.mmap(self.file.fileno(), 0) if known else b"", 0, []

        def take(kind: type, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(mapped, kind, n, at)
            at += got.nbytes
            return got

        for n, weighted in known:
            y, w, f = take(np.float64, n), take(np.float64, n) if weighted else None, take(np.float64, n)
            g, h, node = take(np.int32, n), take(np.int32, n) if second else None, take(np.int16, n)
            out.append(_Held(take(np.uint8, width * n).reshape(width, n), y, w, f, g, h, node))
            at += -at % 8
        return out


def _boosted_by(
    team: _Team, batches: Iterator[pa.RecordBatch], width: int, how: Loss, start: float | None, before: Sequence[Tree], rounds: int, units: tuple[float, float], leaves: int, least: int, ridge: float, rate: float
) -> tuple[float, list[Tree]]:
    """What a task does for a model: the start and the trees that follow those before, the same in every task."""
    held = team.hold(batches, width, how.name == "log")
    g_unit, w_unit = units
    if start is None:
        if how.name == "pinball":
            start = _quantiles(team, held, [np.zeros(len(b.y), np.int64) for b in held], 1, how.level, w_unit)[0]
        else:
            own = [[int(_units(b.y, b.w, g_unit).astype(np.int64).sum()), int(_units(np.ones(len(b.y)), b.w, w_unit).astype(np.int64).sum())] for b in held]
            y, w = team.sum(np.array(own or [[0, 0]], np.int64).sum(0)).tolist()
            mean = y / g_unit / (w / w_unit)
            start = math.log(max(mean, 1e-12) / max(1 - mean, 1e-12)) if how.name == "log" else mean
    for b in held:
        b.f[:] = _summed(before, b.x.T, np.full(len(b.y), start))
    out: list[Tree] = []
    for _ in range(rounds):
        for b in held:
            g, h = how.gradients(b.y, b.f)
            b.g[:] = _units(g, b.w, g_unit)
            if b.h is not None:
                b.h[:] = _units(h, b.w, w_unit)
            b.node[:] = 0
        tree = _grown(team, held, units, width, leaves, least, ridge, rate, None if how.name != "pinball" else how.level)
        if tree is None:
            break
        out.append(tree)
    return start, out


def _grown(team: _Team, held: list[_Held], units: tuple[float, float], width: int, leaves: int, least: int, ridge: float, rate: float, level: float | None) -> Tree | None:
    """The next tree, added to the scores of the rows; None if nothing can be split."""
    nodes = [_Node(0.0, 0.0, 0)]
    sums: dict[int, np.ndarray] = {}
    moved: set[int] = set()

    def look_at(which: list[int]) -> None:
        for k, r in _best_splits(team, held, nodes, which, moved, sums, units, width, least, ridge).items():
            nodes[k].g, nodes[k].h, nodes[k].n, nodes[k].best = r
        for k in which:
            nodes[k].looked_at = True

    def split(k: int) -> tuple[int, int]:
        node = nodes[k]
        if node.left < 0:
            _, _, _, g, h, n = node.best
            nodes.extend([_Node(g, h, n, k), _Node(node.g - g, node.h - h, node.n - n, k)])
            node.left, node.right = len(nodes) - 2, len(nodes) - 1
        return node.left, node.right

    open_ = lambda k: [x for x in split(k) if not nodes[x].looked_at and nodes[x].n >= 2 * least]
    look_at([0])
    while True:
        waiting, taken = [(-nodes[0].best[0], 0)] if nodes[0].best else [], []
        asked: list[int] = []
        while waiting and len(taken) + 1 < leaves and not asked:
            _, k = heapq.heappop(waiting)
            taken.append(k)
            if len(taken) + 1 == leaves:
                break
            asked = open_(k)
            for x in split(k) if not asked else ():
                if nodes[x].best:
                    heapq.heappush(waiting, (-nodes[x].best[0], x))
        if not asked:
            break
        for _, k in heapq.nsmallest(leaves - 1 - len(taken), waiting):
            asked += open_(k)
        look_at(asked)
    if not taken:
        return None
    # the splits that were taken, nodes numbered as they are met
    chosen, number, order = set(taken), {0: 0}, [0]
    for k in order:
        if k in chosen:
            for x in split(k):
                number[x] = len(order)
                order.append(x)
    of = lambda get, rest: np.array([get(nodes[k]) if k in chosen else rest for k in order])
    feature, code, left, right = of(lambda x: x.best[1], 0), of(lambda x: x.best[2], 0), of(lambda x: number[x.left], -1), of(lambda x: number[x.right], -1)
    home = np.zeros(len(nodes), np.int64)  # where the rows of a node end
    for k, node in enumerate(nodes):
        home[k] = number.get(k, home[max(node.parent, 0)])
    shape = _arrays(nodes)
    last = np.isin(np.arange(len(nodes)), [k for k in chosen if k not in moved])
    for b in held:
        _move(b, shape, last)
    if level is None:
        value = np.array([0.0 if k in chosen else -rate * nodes[k].g / (nodes[k].h + ridge) for k in order])
    else:
        ends = np.flatnonzero(left < 0)
        place = np.zeros(len(order), np.int64)
        place[ends] = np.arange(len(ends))
        value = np.zeros(len(order))
        value[ends] = rate * np.array(_quantiles(team, held, [place.take(home).take(b.node) for b in held], len(ends), level, units[1]))
    each = value.take(home)
    for b in held:
        b.f[:] += each.take(b.node)
    return feature, code, left, right, value


def _arrays(nodes: list[_Node]) -> tuple[np.ndarray, ...]:
    """Feature, code and children of the splits known so far."""
    of = lambda get, rest: np.array([get(x) if x.left >= 0 else rest for x in nodes])
    return of(lambda x: x.best[1], 0), of(lambda x: x.best[2], 0), of(lambda x: x.left, -1), of(lambda x: x.right, -1)


def _move(b: _Held, shape: tuple[np.ndarray, ...], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the marked nodes go to their children: which rows, and where."""
    feature, code, left, right = shape
    rows = np.flatnonzero(which.take(b.node))
    at = b.node.take(rows)
    goes = b.x.reshape(-1).take((feature * len(b.y)).take(at) + rows) <= code.take(at)
    child = np.where(goes, left.take(at), right.take(at))
    b.node[rows] = child
    return rows, child


def _best_splits(
    team: _Team, held: list[_Held], nodes: list[_Node], which: list[int], moved: set[int], known: dict[int, np.ndarray], units: tuple[float, float], width: int, least: int, ridge: float
) -> dict[int, tuple]:
    """Each node of which: its sums g, h, n and its best split, if it has one. Rows go to the children of split nodes, known gets the sums of codes."""
    g_unit, h_unit = units
    split = sorted({nodes[k].parent for k in which} - {-1})
    small = [min((nodes[k].left, nodes[k].right), key=lambda x: (nodes[x].n, x)) for k in split] or [0]
    shape, slots = _arrays(nodes), np.full(len(nodes), -1)
    slots[small] = np.arange(len(small))
    marked = np.isin(np.arange(len(nodes)), split)
    moved.update(split)
    cells = len(small) * 256
    own = np.zeros((3, width, cells))  # whole numbers below 2^53: exact
    alike = not held or held[0].w is None and held[0].h is None  # every row has the same second derivative
    for b in held:
        if split:
            rows, at = _move(b, shape, marked)
            slot = slots.take(at)
            mine = np.flatnonzero(slot >= 0)
            rows, base = rows.take(mine), slot.take(mine) * 256
            pick = lambda v, rows=rows: v.take(rows)
        else:
            base, pick = 0, lambda v: v
        g = pick(b.g).astype(float)
        h = None if alike else pick(b.h).astype(float) if b.h is not None else _units(np.ones(len(g)), pick(b.w), h_unit)
        for k in range(width):
            at = base + pick(b.x[k]).astype(np.int64)
            own[0, k] += np.bincount(at, g, cells)
            if h is not None:
                own[1, k] += np.bincount(at, h, cells)
            own[2, k] += np.bincount(at, None, cells)
    total = own.astype(np.int64)
    if alike:
        total[1] = total[2] * round(h_unit)
    total = team.sum(total).reshape(3, width, len(small), 256)
    for slot, k in enumerate(small):
        known[k] = np.ascontiguousarray(total[:, :, slot])
    for k in split:
        a, z = (nodes[k].left, nodes[k].right) if nodes[k].left in small else (nodes[k].right, nodes[k].left)
        known[z] = known.pop(k) - known[a]
    out = {}
    for k in which:
        left = np.cumsum(known[k], axis=2)
        every = left[:, :, -1:]
        (gl, hl, _), (gr, hr, _), (ga, ha, _) = ((v[0] / g_unit, v[1] / h_unit, v[2]) for v in (left, every - left, every))
        may = (known[k][2] > 0) & (left[2] >= least) & ((every - left)[2] >= least) & (hl >= LEAST_HESSIAN) & (hr >= LEAST_HESSIAN)
        with np.errstate(invalid="ignore", divide="ignore"):
            gain = np.where(may, gl * gl / (hl + ridge) + gr * gr / (hr + ridge) - ga * ga / (ha + ridge), 0.0)
        f, code = divmod(int(np.argmax(gain)), 256)  # the first of equal ones
        g, h, n = every[:, f, 0].tolist()
        a = left[:, f, code].tolist()
        out[k] = (g / g_unit, h / h_unit, n, (float(gain[f, code]), f, code, a[0] / g_unit, a[1] / h_unit, a[2]) if gain[f, code] > 0 else None)
    return out


_DIGITS = (11, 11, 11, 11, 10, 10)


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers of the same order (negative zero as zero)."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def of_ordered_bits(u: int) -> float:
    return float(np.uint64(u & ~(1 << 63) if u >> 63 else ~u & (1 << 64) - 1).view(np.float64))


def _quantiles(team: _Team, held: list[_Held], places: list[np.ndarray], n: int, level: float, w_unit: float) -> list[float]:
    """The level's exact weighted quantile of the residuals y - f at each of n places, each with a row at least.

    The bits of a residual are counted digit by digit from the front: each pass counts, by
    place, the next digit of the residuals that begin with the digits found, and keeps the one
    that holds the quantile. No place's residuals are sorted or gathered.
    """
    head, need, used = np.zeros(n, np.int64), None, 0
    left = None
    for digits in _DIGITS:
        shift, mask = np.uint64(64 - used - digits), np.uint64((1 << digits) - 1)
        counts = np.zeros(n << digits, np.int64)
        kept = []
        for p, bits, w in ((p, ordered_bits(b.y - b.f), b.w) for p, b in zip(places, held, strict=True)) if left is None else left:
            if used:
                mine = np.flatnonzero((bits >> np.uint64(64 - used)).astype(np.int64) == head.take(p))
                p, bits, w = p.take(mine), bits.take(mine), None if w is None else w.take(mine)
                kept.append((p, bits, w))
            at = (p << digits) | ((bits >> shift) & mask).astype(np.int64)
            counts += np.bincount(at, None, len(counts)) * round(w_unit) if w is None else np.bincount(at, _units(np.ones(len(p)), w, w_unit), len(counts)).astype(np.int64)
        if kept:  # few share the digits before
            left = [tuple(None if v[0] is None else np.concatenate(v) for v in zip(*kept, strict=True))]
        upto = np.cumsum(team.sum(counts).reshape(n, -1), axis=1)
        if need is None:
            need = np.maximum(np.ceil(upto[:, -1] * float(level)), 1).astype(np.int64)
        digit = (upto >= need[:, None]).argmax(1)
        need = need - np.where(digit > 0, upto[np.arange(n), np.maximum(digit - 1, 0)], 0)
        head = (head << digits) | digit
        used += digits
    return [of_ordered_bits(int(u) & (1 << 64) - 1) for u in head]


# extremely randomised trees -------------------------------------------------------------------

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _hash(*parts: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of whole numbers, elementwise."""
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p, np.uint64)) * _A + _B
            h = (h ^ (h >> np.uint64(31))) * _B
    return h ^ (h >> np.uint64(29))


def draw_splits(seed: int, tree: int, path: int, low: np.ndarray, high: np.ndarray, tries: int) -> list[tuple[int, int]]:
    """Up to tries (feature, code) of a node: the features that a hash of (tree, node, feature) puts first, each cut at a code drawn by that hash.

    path numbers the node (root 1, children 2n and 2n + 1); low and high are the codes at
    which each feature can still be cut there, given the cuts above.
    """
    features = np.arange(len(low))
    h = _hash(seed, tree, path & (1 << 64) - 1, features)
    free = features[high >= low]
    first = free[np.lexsort((free, h[free]))][:tries]
    return [(int(f), int(low[f] + (h[f] >> np.uint64(8)) % np.uint64(high[f] - low[f] + 1))) for f in first]


@dataclass
class _Shoot:
    """A node that is still to be cut."""

    tree: int
    node: int
    path: int
    low: np.ndarray
    high: np.ndarray
    splits: list[tuple[int, int]] = field(default_factory=list)


@dataclass(frozen=True)
class Forest:
    """Trees whose leaves hold the mean label; a score is the mean over trees."""

    bins: Bins
    trees: tuple[Tree, ...] = field(repr=False)

    def predict(self, df: DataFrame, name: str) -> DataFrame:
        ensure_importable(df.sparkSession)
        return _predicted(df, self.bins, lambda x: _summed(self.trees, x, np.zeros(len(x))) / max(len(self.trees), 1), name)

    def leaves(self, df: DataFrame, name: str = "leaf") -> DataFrame:
        """df with the leaf of each tree that a row ends in, as an array."""
        ensure_importable(df.sparkSession)
        bins, trees = self.bins, self.trees

        @pandas_udf("array<int>")
        def of(*columns: pd.Series) -> pd.Series:
            x = bins.codes([v.to_numpy(float) for v in columns])
            return pd.Series(list(np.stack([leaf_of(t, x) for t in trees], 1).astype(np.int32))) if len(x) else pd.Series([], dtype=object)

        return df.withColumn(name, of(*[c(x).cast("double") for x in bins.features]))


def fit_extra_trees(
    df: DataFrame | Blocks,
    features: Sequence[str],
    label: str,
    trees: int = 300,
    least: int = 20,
    depth: int = 12,
    tries: int | None = None,
    weight: str | None = None,
    bins: Bins | int = 255,
    seed: int = 42,
    at_once: int = 1 << 18,
) -> Forest:
    """Extremely randomised trees for a label in [0, 1], or any other whose mean is asked for.

    Every tree sees all rows. A node looks at tries features (the root of their number) at one
    threshold each, drawn by a hash, and takes the cut that lowers the summed squared error
    most, which for labels 0 and 1 is the Gini impurity; each side keeps least rows. A node
    ends as a leaf at the given depth, with a single label, or if none of its thresholds
    leaves least rows on both sides. One pass over the rows serves a level of all trees, or
    of so many that at_once thresholds are counted together.

    Thresholds are drawn among the codes that the cuts above a node leave open, not between
    the least and largest value of its rows: that needs no pass of its own. The depth bounds
    the number of nodes, which the driver holds. Without rows every score is 0.
    """
    given = df if isinstance(df, Blocks) else blocks(df, features, label, weight, bins)
    found, rows = given.bins, given.rows
    width = len(found.features)
    k = tries or max(1, int(math.sqrt(width)))
    if not given.n or not given.top_weight:
        return Forest(found, ())
    w_unit = UNIT / given.top_weight
    y_unit = w_unit / max(given.top_label, 1.0)
    grown = [[[0], [0], [-1], [-1], [0.0]] for _ in range(trees)]
    shoots = [_Shoot(t, 0, 1, np.zeros(width, np.int64), found.top - 1) for t in range(trees)]
    for level in range(depth + 1):
        for s in shoots:
            s.splits = draw_splits(seed, s.tree, s.path, s.low, s.high, k) if level < depth else []
        after: list[_Shoot] = []
        step = max(1, at_once // (k + 1))
        for at in range(0, len(shoots), step):
            part = shoots[at : at + step]
            got = _cuts(rows, grown, part, width, k, w_unit, y_unit, least)
            for i, s in enumerate(part):
                after += _applied(grown[s.tree], s, got.get(i), w_unit, y_unit)
        shoots = after
        if not shoots:
            break
    if given is not df:
        drop(rows)
    return Forest(found, tuple(tuple(np.array(x, float if j == 4 else np.int64) for j, x in enumerate(t)) for t in grown))


def _applied(tree: list[list], s: _Shoot, found: dict | None, w_unit: float, y_unit: float) -> list[_Shoot]:
    """Enter what was found for a node; its children, if it was cut."""
    if found is None:
        return []
    tree[4][s.node] = (found["y"] / y_unit) / (found["w"] / w_unit) if found["w"] else 0.0
    if found["best"] is None:
        return []
    f, b = s.splits[-found["best"]["c"]]
    out = []
    for side in (0, 1):
        number = len(tree[0])
        for x, v in zip(tree, (0, 0, -1, -1, 0.0), strict=True):
            x.append(v)
        low, high = s.low.copy(), s.high.copy()
        if side:
            low[f] = b + 1
        else:
            high[f] = b - 1
        tree[2 + side][s.node] = number
        out.append(_Shoot(s.tree, number, 2 * s.path + side, low, high))
    tree[0][s.node], tree[1][s.node] = f, b
    return out


def _cuts(rows: DataFrame, grown: list, part: list[_Shoot], width: int, k: int, w_unit: float, y_unit: float, least: int) -> dict[int, dict]:
    """For the place of each node of part: its sums, and the best of its drawn splits."""
    by_tree: dict[int, list[int]] = {}
    for i, s in enumerate(part):
        by_tree.setdefault(s.tree, []).append(i)
    features, codes = np.zeros((k, len(part)), np.int64), np.zeros((k, len(part)), np.int16)
    for i, s in enumerate(part):
        for j in range(k):
            features[j, i], codes[j, i] = s.splits[j] if j < len(s.splits) else (0, 256)  # all rows on the left: not a split
    shapes = []
    for t, places in by_tree.items():
        slot = np.full(len(grown[t][0]), -1)
        slot[[part[i].node for i in places]] = places
        shapes.append((min(places), max(places) + 1, tuple(np.array(x) for x in grown[t]), slot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(part)
        sums = np.zeros((3, n, k + 1), np.int64)  # rows, weight, label; on the left of each split, then all
        weighted = False
        lone = np.array([[np.iinfo(np.int64).max], [np.iinfo(np.int64).min]]).repeat(n, 1)  # least and largest label
        for x, y, w, _ in _blocks(batches, width):
            weighted = w is not None
            parts = (None, None if w is None else _units(np.ones(len(y)), w, w_unit), _units(y, w, y_unit))
            label = (ordered_bits(y) ^ np.uint64(1 << 63)).astype(np.int64)
            flat, every = x.T.reshape(-1), np.arange(len(y))
            column = features * len(y)
            for first, last, tree, slot in shapes:
                at, own = slot.take(leaf_of(tree, x)), every
                if at.min(initial=0) < 0:
                    own = np.flatnonzero(at >= 0)
                    at = at.take(own)
                alike = lone[0, first:last] >= lone[1, first:last]  # places that have had one label at most
                if alike.any():
                    seen = np.flatnonzero(alike.take(at - first))
                    np.minimum.at(lone[0], at[seen], label[own[seen]])
                    np.maximum.at(lone[1], at[seen], label[own[seen]])
                values = [None if v is None else v.take(own) for v in parts]
                for j in range(0, k, 2):  # two splits at a time: a cell says on which side of each a row is
                    cell = at - first
                    for i in (j, min(j + 1, k - 1)):
                        cell = 2 * cell + (flat.take(column[i].take(at) + own) <= codes[i].take(at))
                    count = np.bincount(cell, None, 4 * (last - first)).reshape(-1, 2, 2)
                    for s, v in zip(sums, values, strict=True):
                        by = count if v is None else np.bincount(cell, v, 4 * (last - first)).astype(np.int64).reshape(-1, 2, 2)
                        s[first:last, min(j + 1, k - 1)] += by[:, :, 1].sum(1)
                        if j + 1 < k:
                            s[first:last, j] += by[:, 1].sum(1)
                        if not j:
                            s[first:last, k] += by.sum((1, 2))
        if not weighted:
            sums[1] = sums[0] * round(w_unit)
        place = np.flatnonzero(sums[0, :, k])
        place, j = place.repeat(k) if k else place, np.tile(np.arange(k), len(place))
        left, every = sums[:, place, j], sums[:, place, k]
        yield pa.RecordBatch.from_arrays([*map(pa.array, (place, j, *left, *every, lone[0, place], lone[1, place]))], names=["place", "j", "nl", "wl", "yl", "n", "w", "y", "low", "high"])

    schema = ", ".join(f"{x} long" for x in ("place", "j", "nl", "wl", "yl", "n", "w", "y", "low", "high"))
    total = rows.mapInArrow(run, schema).repartition("place").groupBy("place", "j").agg(*[F.sum(x).alias(x) for x in ("nl", "wl", "yl", "n", "w", "y")], F.min("low").alias("low"), F.max("high").alias("high"))
    square = lambda y, w: F.coalesce(F.try_divide(y.cast("double") * y, w.cast("double")), F.lit(0.0))
    gain = square(c("yl"), c("wl")) + square(c("y") - c("yl"), c("w") - c("wl")) - square(c("y"), c("w"))
    may = (c("nl") >= least) & (c("n") - c("nl") >= least) & (c("low") < c("high"))
    best = total.groupBy("place").agg(F.max(F.when(may, F.struct(gain.alias("gain"), (-c("j")).alias("c")))).alias("best"), *[F.max(x).alias(x) for x in ("n", "w", "y")])
    return {r["place"]: r.asDict() for r in best.collect()}


# quantile forests -----------------------------------------------------------------------------

#: Fixed point of the weights of a leaf's rows.
SHARE = 1 << 40
#: Ranges of the label that quantile forests deal rows by, and rows of test that tell where these are wanted.
RANGES, SPOTS = 128, 4096


def forest_quantiles(train: DataFrame, test: DataFrame, id_col: str, label: str, levels: Sequence[float], leaf: str = "leaf") -> DataFrame:
    """(id, q: array) by the training labels of the leaves that a row of test falls in.

    Both tables have an array of leaves, one a tree. A training row of a leaf with n rows
    weighs 1 / n in it, and the weights of a label are summed over trees; a quantile is the
    smallest label that the level's share of all weight reaches. Leaves are described by
    their different labels and how often each occurs, so nothing is cut to a grid. Rows of
    train without a label are left out; a row of test in no known leaf has no quantiles and is
    missing.

    Rows of test do not meet the labels: what a leaf has in each of up to 128 ranges of the label goes to
    the tasks, which tell by it the range of each quantile, and only the rows of train and test of
    a range come together, where the quantile is found by halving. A third of the ranges holds
    alike many labels, the others alike many of the quantiles of SPOTS rows of a larger test
    table, as most rows have theirs close together: where ranges begin has no part in the result.
    The number of leaves, which the depth of the trees bounds, bounds what the driver gets.
    """
    rows = train.where(c(label).isNotNull()).select(c(label).cast("double").alias("v"), c(leaf).alias("leaf"))
    asked = test.select(c(id_col).alias("id"), c(leaf).alias("leaf"))
    ensure_importable(train.sparkSession)
    sizes = _leaf_sizes(rows)
    edges = np.unique(rows.agg(F.percentile_approx("v", [k / RANGES for k in range(1, RANGES)], 10_000)).first()[0] or [])  # any will do
    n = asked.count()
    if n > 4 * SPOTS and len(edges):
        some = asked.where(F.pmod(F.xxhash64("id"), F.lit(n // SPOTS)) == 0)
        wanted = [x for r in _ranged_quantiles(rows, some, sizes, edges, levels).select("q").collect() for x in r["q"]]  # some 4,096 rows
        edges = np.unique(np.concatenate([edges[::3], np.quantile(wanted, np.arange(1, RANGES * 2 // 3) / (RANGES * 2 // 3), method="nearest") if wanted else []]))
    return _ranged_quantiles(rows, asked, sizes, edges, levels).withColumnRenamed("id", id_col)


def _leaves(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    """(rows, trees)"""
    column = batch.column("leaf")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0), np.int32)


def _leaf_sizes(rows: DataFrame) -> np.ndarray:
    """(trees, leaves): how many rows end in each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for t, own in enumerate(_leaves(batch).T):
                n = np.bincount(own)
                before = held.get(t, n[:0])
                wide = np.zeros(max(len(n), len(before)), np.int64)
                wide[: len(n)] += n
                wide[: len(before)] += before
                held[t] = wide
        for t, n in held.items():
            leaf = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), t, np.int32)), pa.array(leaf.astype(np.int32)), pa.array(n[leaf])], names=["tree", "leaf", "n"])

    found = rows.mapInArrow(count, "tree int, leaf int, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).toArrow()  # a row a leaf
    tree, leaf, n = (found.column(x).to_numpy() for x in ("tree", "leaf", "n"))
    out = np.zeros((int(tree.max(initial=-1)) + 1, int(leaf.max(initial=-1)) + 1), np.int64)
    out[tree, leaf] = n
    return out


def _label_weights(labels: pa.Table, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different labels v, the rising keys (tree * leaves + leaf) * len(v) + place in v of those that occur, and their weights."""
    v, which = np.unique(labels.column("v").to_numpy(), return_inverse=True)
    leaves = _leaves(labels)
    key, n = np.unique(((np.arange(leaves.shape[1]) * sizes.shape[1] + leaves) * max(len(v), 1) + which.reshape(-1, 1)).reshape(-1), return_counts=True)
    size = sizes.reshape(-1).take(key // max(len(v), 1))
    whole, rest = np.divmod(n << 20, size)  # n * SHARE // size in two steps, without overflow
    return v, key, (whole << 20) + (rest << 20) // size


def _sorted_place(low: np.ndarray, high: np.ndarray, more: np.ndarray, place: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """For each row, the first place at which the weights of its entries low to high (rows, trees), in the order of places, add up to more."""
    count = (high - low).reshape(-1)
    at = np.repeat(low.reshape(-1) - (np.cumsum(count) - count), count) + np.arange(count.sum())
    own = (high - low).sum(1)
    order = np.argsort(np.repeat(np.arange(len(own)) * n, own) + place.take(at))
    at = at.take(order)
    upto = np.concatenate([[0], np.cumsum(w.take(at))])
    found = np.searchsorted(upto[1:], upto.take(np.cumsum(own) - own) + more)
    return place.take(at.take(np.minimum(found, len(at) - 1)))


def _halved_place(low: np.ndarray, high: np.ndarray, home: np.ndarray, more: np.ndarray, key: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    """The same by halving the places, and within them the entries of each leaf."""
    more = more + sums[low].sum(1)
    first, last = np.zeros(len(more), np.int64), np.full(len(more), n - 1)
    while (first < last).any():
        middle = (first + last) // 2
        wanted, at, end = home + middle[:, None], low.copy(), high.copy()
        while (open_ := at < end).any():
            half = (at + end) >> 1
            less = open_ & (key.take(np.minimum(half, len(key) - 1)) <= wanted)
            at, end = np.where(less, half + 1, at), np.where(less, end, np.where(open_, half, end))
        reached = sums[at].sum(1) >= more
        first, last = np.where(reached, first, middle + 1), np.where(reached, middle, last)
    return first


def _ranged_quantiles(rows: DataFrame, asked: DataFrame, sizes: np.ndarray, edges: np.ndarray, levels: Sequence[float]) -> DataFrame:
    """(id, q) for asked (id, leaf) by rows (v, leaf), in ranges of v parted at edges."""
    width = len(edges) + 1

    @pandas_udf("int")
    def range_of(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, v.to_numpy(), side="left").astype(np.int32))

    context = rows.sparkSession.sparkContext
    known = context.broadcast(sizes)
    parted = rows.withColumn("b", range_of("v")).repartition(width, "b")

    def weigh(key: tuple, labels: pa.Table) -> pa.Table:
        v, at, w = _label_weights(labels, known.value)
        end = at // max(len(v), 1)
        first = np.flatnonzero(np.diff(end, prepend=-1))
        return pa.table({"place": pa.array(end[first]), "b": pa.array(np.full(len(first), key[0].as_py(), np.int32)), "w": pa.array(np.add.reduceat(w, first))})

    counts = parted.groupBy("b").applyInArrow(weigh, "place long, b int, w long").toArrow()  # a row a leaf and range
    place = np.zeros(sizes.shape, np.int64)  # 0: not known
    ends = np.flatnonzero(sizes)
    place.reshape(-1)[ends] = np.arange(1, len(ends) + 1)
    upto = np.zeros((len(ends) + 1, width), np.int64)
    upto[place.reshape(-1).take(counts.column("place").to_numpy()), counts.column("b").to_numpy()] = counts.column("w").to_numpy()
    shared = context.broadcast((place, np.cumsum(upto, axis=1)))
    shares = [float(q) for q in levels]
    id_type = dict(asked.dtypes)["id"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, upto = shared.value
        held: list[tuple] = []

        def blocks_of() -> Iterator[pa.RecordBatch]:
            """The questions of many rows, a row a range."""
            ids = pa.concat_arrays([x[0] for x in held])
            level, b, before, need, leaves = (np.concatenate([x[k] for x in held]) for k in range(1, 6))
            held.clear()
            order = np.argsort(b, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(b[order])) + 1):
                binary = [pa.array([v[own].tobytes()], pa.binary()) for v in (level, before, need, leaves)]
                named = ids.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([pa.array([int(b[own[0]])], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), named), *binary], names=["b", "id", "level", "before", "need", "leaf"])

        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                leaves = _leaves(batch)
                total = np.zeros((batch.num_rows, width), np.int64)
                for t in range(min(leaves.shape[1], place.shape[0])):
                    own = leaves[:, t]
                    total += upto[np.where(own < place.shape[1], place[t, np.minimum(own, place.shape[1] - 1)], 0)]
                found = np.flatnonzero(total[:, -1] > 0)
                total, ids, leaves = total[found], batch.column("id").take(pa.array(found)), leaves[found].astype(np.int32)
                for k, q in enumerate(shares):
                    need = total[:, -1] * q
                    b = (total >= need[:, None]).argmax(1)
                    before = np.where(b > 0, total[np.arange(len(b)), np.maximum(b - 1, 0)], 0)
                    if len(b):
                        held.append((ids, np.full(len(b), k, np.int32), b, before, need, leaves))
            if sum(len(x[1]) for x in held) >= 200_000:
                yield from blocks_of()
        if held:
            yield from blocks_of()

    def find(blocks: pa.Table, labels: pa.Table) -> pa.Table:
        sizes = known.value
        v, key, w = _label_weights(labels, sizes)
        n, sums = len(v), np.concatenate([[0], np.cumsum(w)])
        ids = pa.chunked_array([x.flatten() for x in blocks.column("id").chunks], blocks.column("id").type.value_type)
        joined = lambda x, kind: np.frombuffer(b"".join(blocks.column(x).to_pylist()), kind)
        asked = {"level": joined("level", np.int32), "before": joined("before", np.int64), "need": joined("need", np.float64)}
        every = joined("leaf", np.int32).reshape(len(ids), -1) if len(ids) else None
        out, place = np.empty(len(ids), np.int64), (key % max(n, 1)).astype(np.int32)
        starts = np.append(np.searchsorted(key, np.arange(sizes.size + 1) * n), len(key))  # of each leaf; the last one is not known and has none
        for at in range(0, len(ids), 4096):  # arrays that stay in a core's cache
            part = slice(at, at + 4096)
            leaves = every[part, : sizes.shape[0]].astype(np.int64)
            home = np.where(leaves < sizes.shape[1], np.arange(leaves.shape[1]) * sizes.shape[1] + leaves, sizes.size)
            low, high = starts.take(home), starts.take(home + 1)  # what each leaf has in this range
            more = np.ceil(asked["need"][part]).astype(np.int64) - asked["before"][part]  # weight to be reached within the range
            own = (high - low).sum(1)
            if own.mean() <= 2048:  # few labels a row: they are sorted
                step = max(1, int((1 << 18) // max(own.mean(), 1)))
                for k in range(0, len(own), step):
                    some = slice(k, k + step)
                    out[at + k : at + k + len(own[some])] = _sorted_place(low[some], high[some], more[some], place, w, n)
            else:
                out[part] = _halved_place(low, high, home * n, more, key, sums, n)
        out = v[out] if len(ids) else np.zeros(0)
        return pa.table({"id": ids, "level": pa.array(asked["level"]), "v": pa.array(out)})

    questions = asked.mapInArrow(ask, f"b int, id array<{id_type}>, level binary, before binary, need binary, leaf binary").repartition(width, "b")
    found = questions.groupBy("b").cogroup(parted.groupBy("b")).applyInArrow(find, f"id {id_type}, level int, v double")
    reached = [F.max(F.when(c("level") == k, c("v"))) for k in range(len(shares))]
    return found.groupBy("id").agg(F.array(*reached).alias("q")).select("id", "q")
