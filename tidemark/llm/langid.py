"""Language identification by a byte convolutional network trained in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample, chunks, lean, remainder, texts_of, utf8_bytes
from tidemark.scratch import ensure_importable

WINDOW, WIDTHS, FILTERS, DIMS = 256, (2, 3, 4), 16, 8
UNKNOWN = "und"
_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    """Whether any character is in one of Unicode's letter categories."""
    return _LETTER.search(text) is not None or any(map(str.isalpha, text))


def _alphabet() -> np.ndarray:
    """Symbol of each byte: letters without case, one for digits, blanks and marks each, high bytes as they are."""
    table = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        table[b] = 29 + b - 128 if b > 127 else 3 + ord(c.lower()) - 97 if c.isalpha() else 1 if c.isspace() else 2
    table[0] = 0
    return table


ALPHABET = _alphabet()
N_SYMBOLS = int(ALPHABET.max()) + 1


def windows_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all windows that tile the texts, the last of each padded; and the text each belongs to."""
    sizes = np.diff(ends)
    n = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), n)
    out = np.zeros(int(n.sum()) * WINDOW, np.uint8)
    first = (np.cumsum(n) - n) * WINDOW
    at = np.repeat(first - ends[:-1], sizes) + np.arange(len(data))
    out[at] = ALPHABET[data]
    return out.reshape(-1, WINDOW), owner


@dataclass
class Network:
    """Embedding, filters of several widths as one matrix, max pooling over the window, softmax."""

    embed: np.ndarray  # symbols x DIMS
    filters: np.ndarray  # max(WIDTHS) * DIMS x FILTERS * len(WIDTHS); rows beyond a filter's width are zero
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def patches(self, symbols: np.ndarray) -> np.ndarray:
        x = self.embed[symbols]
        view = np.lib.stride_tricks.sliding_window_view(x.reshape(len(x), -1), max(WIDTHS) * DIMS, axis=1)[:, ::DIMS]
        return view.reshape(-1, max(WIDTHS) * DIMS)

    def pooled(self, symbols: np.ndarray, where: bool = False):
        y = (self.patches(symbols) @ self.filters).reshape(len(symbols), -1, len(self.bias))
        if where:
            best = y.argmax(1)
            return np.take_along_axis(y, best[:, None], 1)[:, 0] + self.bias, best
        return y.max(1) + self.bias

    def probabilities(self, symbols: np.ndarray, step: int = 512) -> np.ndarray:
        parts = [np.zeros((0, len(self.out_bias)))]
        for at in range(0, len(symbols), step):
            z = np.maximum(self.pooled(symbols[at : at + step]), 0) @ self.out + self.out_bias
            e = np.exp(z - z.max(1, keepdims=True))
            parts.append(e / e.sum(1, keepdims=True))
        return np.concatenate(parts)


def _shape_mask() -> np.ndarray:
    mask = np.zeros((max(WIDTHS), DIMS, len(WIDTHS), FILTERS), np.float32)
    for k, width in enumerate(WIDTHS):
        mask[:width, :, k] = 1
    return mask.reshape(max(WIDTHS) * DIMS, -1)


def train(symbols: np.ndarray, target: np.ndarray, n_classes: int, epochs: int = 6, batch: int = 128, seed: int = 7) -> Network:
    """Adam on the cross-entropy; only the place that won the pooling gets a gradient."""
    rng = np.random.default_rng(seed)
    mask, total = _shape_mask(), FILTERS * len(WIDTHS)
    net = Network(
        rng.normal(0, 0.5, (N_SYMBOLS, DIMS)).astype(np.float32),
        (rng.normal(0, 0.25, mask.shape) * mask).astype(np.float32),
        np.zeros(total, np.float32),
        rng.normal(0, 0.1, (total, n_classes)).astype(np.float32),
        np.zeros(n_classes, np.float32),
    )
    names = ("embed", "filters", "bias", "out", "out_bias")
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    step, offsets = 0, np.arange(max(WIDTHS))
    for epoch in range(epochs):
        order = rng.permutation(len(symbols))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x, y = symbols[rows], target[rows]
            pooled, best = net.pooled(x, where=True)
            hidden = np.maximum(pooled, 0)
            z = hidden @ net.out + net.out_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            g = (p @ net.out.T) * (pooled > 0)
            seen = x[np.arange(len(y))[:, None, None], best[:, :, None] + offsets]  # batch x filters x width
            patch = net.embed[seen].reshape(len(y), total, -1)
            back = (g[:, :, None] * net.filters.T[None]).reshape(-1, DIMS)
            embed = np.zeros_like(net.embed)
            flat = seen.ravel()
            for d in range(DIMS):
                embed[:, d] = np.bincount(flat, weights=back[:, d], minlength=N_SYMBOLS)
            grads = {
                "embed": embed,
                "filters": np.einsum("bf,bfk->kf", g, patch) * mask,
                "bias": g.sum(0),
                "out": hidden.T @ p + 1e-4 * net.out,
                "out_bias": p.sum(0),
            }
            step += 1
            rate = 0.01 * (0.5 if epoch >= epochs // 2 else 1.0)
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, (getattr(net, k) - rate * move).astype(np.float32))
    return net


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    training_documents: int = 6_000,
    windows_each: int = 3,
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text.

    The network learns from windows_each windows, spread evenly over the text, of about
    training_documents documents with a language, drawn by a hash of the id among those whose
    crc32(id as text) mod 5 is not 0. Each text is tiled by windows; their class probabilities
    are averaged, weighted by the letters and high bytes they hold, and score is the mean
    probability of the language predicted. A text that is null or has no letter is `und` with
    score 0, as is every text when there is nothing to learn from. Null ids are scored but
    not learned from; repeated rows get equal results; an empty table gives an empty result.
    """
    ensure_importable(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), 5) != 0)
    )

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                symbols, owner = windows_of(*utf8_bytes(texts_of(part.column("text"))))
                n = np.bincount(owner, minlength=part.num_rows)
                first = np.cumsum(n) - n
                take = np.concatenate([np.zeros(0, int), *[first[i] + np.unique(np.linspace(0, n[i] - 1, windows_each).astype(int)) for i in np.flatnonzero(n)]]).astype(int)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bytes(w) for w in symbols[take]], pa.binary()), part.column("lang").take(pa.array(owner[take]))], names=["w", "lang"]
                )

    drawn = bounded_sample(known, training_documents, "doc_id")
    # repeated ids may bring more rows than were drawn; in a fixed order a rerun learns from the same
    sample = drawn.mapInArrow(spread, "w binary, lang string").orderBy(F.xxhash64("w"), "w", "lang").limit(2 * training_documents * windows_each).toArrow()
    langs = sorted(set(sample.column("lang").to_pylist()))
    net = None
    if langs:
        symbols = np.frombuffer(b"".join(sample.column("w").to_pylist()), np.uint8).reshape(-1, WINDOW)
        target = np.array([langs.index(x) for x in sample.column("lang").to_pylist()])
        net = train(symbols, target, len(langs))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for part in chunks(batch, "text", 2 << 20):
                texts = texts_of(part.column("text"))
                n = len(texts)
                label, score = np.full(n, UNKNOWN, object), np.zeros(n)
                if net is not None:
                    symbols, owner = windows_of(*utf8_bytes(texts))
                    p = net.probabilities(symbols)
                    weight = (symbols >= 3).sum(1)
                    mean = np.column_stack([np.bincount(owner, weights=weight * p[:, k], minlength=n) for k in range(len(langs))])
                    mean /= np.maximum(np.bincount(owner, weights=weight, minlength=n), 1)[:, None]
                    best = mean.argmax(1)
                    for i, text in enumerate(texts.to_pylist()):
                        if has_letter(text):
                            label[i], score[i] = langs[best[i]], min(float(mean[i, best[i]]), 1.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(label, pa.string()), pa.array(score)],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    held_out = F.coalesce(remainder(F.col(id_col), 5) == 0, F.lit(False))
    return docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text")).mapInArrow(
        predict, f"doc_id {id_type}, held_out boolean, lang_pred string, score double"
    )
