"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Words, bounded_sample, chunks, lean, remainder, texts_of, utf8_bytes
from tidemark.scratch import ensure_importable, table

#: Byte classes whose shares are statistics.
CLASSES = ("upper", "lower", "digit", "blank", "newline", "stop", "pause", "symbol", "high")
STATISTICS = (
    "words", "word_bytes", "word_spread", "distinct", "short", "long", "line_bytes", "repeated_lines", "byte_entropy", *CLASSES,
)


def _classes() -> np.ndarray:
    table = np.zeros((256, len(CLASSES)))
    for b in range(256):
        c = chr(b)
        name = (
            "high" if b > 127 else "upper" if c.isupper() else "lower" if c.islower() else "digit" if c.isdigit()
            else "newline" if c == "\n" else "blank" if c.isspace() else "stop" if c in ".!?" else "pause" if c in ",;:'\"-()" else "symbol"
        )
        table[b, CLASSES.index(name)] = 1
    return table


def statistics(texts: pa.Array) -> np.ndarray:
    """Transformed statistics of each whole text, one row a text; an empty text gives finite values."""
    texts = texts_of(texts)
    n = len(texts)
    data, ends = utf8_bytes(texts)
    counts = np.zeros((n, 256))
    for i in range(n):
        counts[i] = np.bincount(data[ends[i] : ends[i + 1]], minlength=256)
    size = np.maximum(counts.sum(1), 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = counts / size[:, None]
        entropy = -np.nansum(np.where(p > 0, p * np.log2(p), 0), axis=1)
    shares = np.sqrt(p @ _classes())

    words = Words(texts)
    doc = words.doc_of_word()
    length = pc.binary_length(words.vocab).to_numpy(zero_copy_only=False).astype(float)
    of_word = length[words.codes] if len(words.codes) else np.zeros(0)
    per = lambda v: np.bincount(doc, weights=v, minlength=n) / np.maximum(words.counts, 1)
    mean = per(of_word)
    spread = np.sqrt(np.maximum(per(of_word**2) - mean**2, 0))
    vocabulary = max(len(words.vocab), 1)
    key = np.sort(doc * vocabulary + words.codes)
    first = key[np.flatnonzero(np.diff(key, prepend=-1))] // vocabulary
    distinct = np.bincount(first, minlength=n) / np.maximum(words.counts, 1) ** 0.8

    lines, repeated = np.zeros(n), np.zeros(n)
    for i, text in enumerate(texts.to_pylist()):
        rows = [x for x in text.split("\n") if x]
        lines[i] = len(rows)
        repeated[i] = 1 - len(set(rows)) / len(rows) if rows else 0
    return np.column_stack(
        [np.log1p(words.counts), np.log1p(mean), np.log1p(spread), distinct, per(of_word <= 3), per(of_word >= 12), np.log1p(size / np.maximum(lines, 1)), np.sqrt(repeated), entropy, shares]
    )


def forward(factor: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solution y of factor @ y = b for a lower triangular factor, row by row."""
    y = np.empty_like(b)
    for i in range(len(factor)):
        y[i] = (b[i] - factor[i, :i] @ y[:i]) / factor[i, i]
    return y


@dataclass
class Discriminant:
    """Class means, Cholesky factors of shrunken covariances and the calibration of their log-density difference."""

    shift: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    slope: float
    intercept: float

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 minus class 0, from Mahalanobis distances by forward substitution."""
        z = np.clip((x - self.shift) / self.scale, -12, 12)
        logs = []
        for mean, factor in zip(self.means, self.factors, strict=True):
            y = forward(factor, (z - mean).T)
            logs.append(-0.5 * (y**2).sum(0) - np.log(np.diag(factor)).sum())
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        t = np.clip(self.slope * self.difference(x) + self.intercept, -40, 40)
        return 1 / (1 + np.exp(-t))


def _fit_classes(x: np.ndarray, y: np.ndarray, toward_pooled: float, toward_sphere: float) -> Discriminant:
    shift, scale = np.median(x, 0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - shift) / scale, -12, 12)
    groups = [z[y == k] for k in (0, 1)]
    own = [np.cov(g.T, bias=True) if len(g) > 1 else np.eye(z.shape[1]) for g in groups]
    pooled = sum(len(g) * c for g, c in zip(groups, own, strict=True)) / len(z)
    factors = []
    for c in own:
        c = (1 - toward_pooled) * c + toward_pooled * pooled
        c = (1 - toward_sphere) * c + toward_sphere * np.trace(c) / len(c) * np.eye(len(c))
        factors.append(np.linalg.cholesky(c + 1e-6 * np.eye(len(c))))
    return Discriminant(shift, scale, [g.mean(0) for g in groups], factors, 1.0, 0.0)


def _calibrate(d: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by Newton steps with a small ridge."""
    unit = max(float(np.std(d)), 1e-9)
    a = np.column_stack([d / unit, np.ones(len(d))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        grad = a.T @ (p - y) + 1e-2 * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 0) / unit), float(w[1])


def fit(x: np.ndarray, y: np.ndarray) -> Discriminant:
    """Fit on rows x with labels y; shrinkage is chosen, and scores calibrated, on folds left out in turn."""
    if len(set(y.tolist())) < 2:
        model = Discriminant(np.zeros(x.shape[1]), np.ones(x.shape[1]), [np.zeros(x.shape[1])] * 2, [np.eye(x.shape[1])] * 2, 0.0, 0.0)
        model.intercept = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        return model
    fold = np.arange(len(y)) % 5
    best = None
    for pooled in (0.05, 0.2, 0.5):
        for sphere in (0.02, 0.1):
            d = np.zeros(len(y))
            for k in range(5):
                rest = fold != k
                if len(set(y[rest].tolist())) == 2:
                    d[~rest] = _fit_classes(x[rest], y[rest], pooled, sphere).difference(x[~rest])
            slope, intercept = _calibrate(d, y)
            t = np.clip(slope * d + intercept, -40, 40)
            loss = float(np.mean(np.log1p(np.exp(-t)) * y + np.log1p(np.exp(t)) * (1 - y)))
            if best is None or loss < best[0]:
                best = (loss, pooled, sphere, slope, intercept)
    model = _fit_classes(x, y, best[1], best[2])
    model.slope, model.intercept = best[3], best[4]
    return model


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.3,
    training_rows: int = 20_000,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text.

    Statistics of all documents are computed once and kept in a scratch table. The model
    learns from at most about training_rows labelled rows, drawn by a hash of the id, whose
    crc32(id as text) mod 5 is not 0; null labels and null ids are not learned from, and a
    label or a text that occurs twice for one id counts twice. The
    driver fits the discriminant and caches its Cholesky factors. A null text counts as
    empty and gets a score as well; without any label the score is 0.5. Repeated rows get
    equal scores; an empty table gives an empty result.
    """
    ensure_importable(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for part in chunks(batch, "text"):
                x = statistics(part.column("text"))
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), flat], names=["doc_id", "x"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    described = table(rows.mapInArrow(describe, f"doc_id {id_type}, x array<double>"), "quality-statistics")
    known = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("y")).where(
        F.col("y").isin(0, 1) & (remainder(F.col("l_id"), 5) != 0)
    )
    training = bounded_sample(described.join(known, F.col("doc_id") == F.col("l_id")), training_rows, "doc_id")
    got = training.select("doc_id", "x", "y").orderBy(F.xxhash64("doc_id"), "doc_id", "x", "y").limit(2 * training_rows).toArrow()
    width = len(STATISTICS)
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, width)
    y = np.array(got.column("y").to_pylist(), int)
    order = np.lexsort([*x.T, y]) if len(y) else np.zeros(0, int)
    model = fit(x[order], y[order])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            score = model.score(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array(score >= threshold).cast(pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return described.select("doc_id", held_out.alias("held_out"), "x").mapInArrow(
        judge, f"doc_id {id_type}, held_out boolean, score double, predicted int"
    )
