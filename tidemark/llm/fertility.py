"""Quality rules from tokeniser fertility, beside word-repetition rules.

Two public vocabularies read every text: a sentencepiece model with byte fallback and a
multilingual byte-level one. Each gives characters per token, the share of tokens that stand
for a single byte outside ASCII, and the entropy of its tokens. A document is rejected where
a measure leaves the band of the document's script.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, fields
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WordEncoder, Words, chunks, each_word, quoted, ragged, resident, texts_of, tokenizer_path, utf8_bytes
from tidemark.scratch import ensure_importable

#: Scripts told apart, by ranges of code points; letters elsewhere count as other.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "cyrillic": ((0x400, 0x52F),),
    "greek": ((0x370, 0x3FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "hebrew": ((0x590, 0x5FF),),
    "devanagari": ((0x900, 0x97F),),
    "cjk": ((0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF), (0x20000, 0x2FA1F)),
}


_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


#: Names of the vocabularies and their files.
VOCABULARIES = {"piece": "piece_bpe_32k.model", "multi": "byte_bpe_multi_50k.tiktoken"}
#: Tokens in a window of which the entropy is taken; characters at which a word is cut for a byte-level vocabulary.
SPAN, LONGEST = 64, 512


@dataclass(frozen=True)
class Band:
    """Closed intervals of the measures of one vocabulary.

    chars_per_token: characters of words per token. byte_share: share of tokens that are a
    single byte outside ASCII. entropy: mean over windows of SPAN tokens of the entropy of
    their distribution, in parts of the most that a window of that length can have, so that
    it does not fall with the length of the document.
    """

    chars_per_token: tuple[float, float]
    byte_share: tuple[float, float]
    entropy: tuple[float, float]


MEASURES = tuple(f.name for f in fields(Band))

#: Bands by script and vocabulary. Those of latin script hold all but about a thousandth of the
#: clean texts of four languages on either side (see bands_of) and leave room for plainer
#: prose, which has more characters a token; "other" holds for any other or no script.
BANDS: dict[str, dict[str, Band]] = {
    "latin": {"piece": Band((1.6, 6.5), (0.0, 0.02), (0.83, 0.99)), "multi": Band((1.7, 7.0), (0.0, 0.05), (0.835, 0.99))},
    "cyrillic": {"piece": Band((1.2, 6.0), (0.0, 0.05), (0.75, 0.99)), "multi": Band((1.0, 7.0), (0.0, 0.2), (0.75, 0.99))},
    "greek": {"piece": Band((0.7, 4.0), (0.0, 0.25), (0.65, 0.99)), "multi": Band((0.7, 6.0), (0.0, 0.3), (0.65, 0.99))},
    "cjk": {"piece": Band((0.35, 3.0), (0.0, 0.8), (0.6, 1.0)), "multi": Band((0.35, 4.0), (0.0, 0.8), (0.6, 1.0))},
    "other": {"piece": Band((0.25, 6.5), (0.0, 1.0), (0.5, 1.0)), "multi": Band((0.25, 7.0), (0.0, 1.0), (0.5, 1.0))},
}


@lru_cache(maxsize=1)
def _script_table() -> np.ndarray:
    table = np.zeros(0x30000, np.uint8)
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for low, high in ranges:
            table[low : high + 1] = k
    return table


def vocabulary_encoder(path: str) -> tuple[WordEncoder, np.ndarray]:
    """Word-wise encoder of a sentencepiece or tiktoken file, and which of its ids are a single byte outside ASCII."""
    return _piece_encoder(path) if path.endswith(".model") else _byte_encoder(path)


def _piece_encoder(path: str) -> tuple[WordEncoder, np.ndarray]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    is_byte = np.array([model.is_byte(i) and int(model.id_to_piece(i)[1:-1], 16) > 127 for i in range(model.get_piece_size())])
    return WordEncoder(each_word(lambda words: model.encode(words, num_threads=1))), is_byte


def _byte_encoder(path: str) -> tuple[WordEncoder, np.ndarray]:
    """Words are encoded with a blank before them, long ones in parts, as the merges of a long run take quadratic time."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    is_byte = np.zeros(max(ranks.values()) + 1, bool)
    is_byte[[i for piece, i in ranks.items() if len(piece) == 1 and piece[0] > 127]] = True
    one = model.encode_ordinary

    def encode(words: list[str]) -> list[list[int]]:
        return [one(" " + w) if len(w) <= LONGEST else [i for at in range(0, len(w), LONGEST) for i in one(w[at : at + LONGEST])] for w in words]

    return WordEncoder(each_word(encode)), is_byte


def _repeat_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def fertility(words: Words, encoder: WordEncoder, is_byte: np.ndarray, word_chars: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of Band for each text."""
    n, codes = len(words.counts), words.codes
    flat, lengths = encoder(words.vocab)
    starts = np.cumsum(lengths) - lengths
    before = np.concatenate([[0], np.cumsum(lengths[codes])])[words.offsets]
    tokens = np.diff(before)
    ids = flat[ragged(starts[codes], lengths[codes])].astype(np.int64)
    byte = np.concatenate([[0], np.cumsum(is_byte[ids])])[before]

    # windows of SPAN tokens tile a text; a rest of up to half a window stands only for itself
    spans = np.maximum(-(-(tokens - SPAN // 2) // SPAN), np.minimum(tokens, 1))
    first = np.cumsum(spans) - spans
    at = np.arange(len(ids)) - np.repeat(before[:-1], tokens)
    inside = at < np.repeat(spans * SPAN, tokens)
    window = (at // SPAN + np.repeat(first, tokens))[inside]
    size = np.bincount(window, minlength=int(spans.sum()))
    key = np.sort(window * len(is_byte) + ids[inside])
    edge = np.flatnonzero(np.diff(key, prepend=-1))
    times = np.diff(np.append(edge, len(key)))
    spent = np.bincount(key[edge] // len(is_byte), weights=times * np.log2(times), minlength=len(size))
    most = np.log2(np.maximum(size, 2))
    entropy = np.bincount(np.repeat(np.arange(n), spans), weights=np.clip((np.log2(np.maximum(size, 1)) - spent / np.maximum(size, 1)) / most, 0, 1), minlength=n)
    total = np.maximum(tokens, 1)
    return {"chars_per_token": word_chars / total, "byte_share": np.diff(byte) / total, "entropy": entropy / np.maximum(spans, 1)}


def word_measures(words: Words, texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts of words, their characters, symbols, repeated lines and repeated words of each text; and its script."""
    n = len(words.counts)
    doc = words.doc_of_word()
    sums = lambda values: np.bincount(doc, weights=values, minlength=n).astype(np.int64)

    chars = pc.utf8_length(words.vocab).to_numpy(zero_copy_only=False).astype(np.int64)
    out = {"n_words": words.counts.astype(np.int64), "word_chars": sums(chars[words.codes])}
    data, ends = utf8_bytes(texts)
    at = np.flatnonzero(_SYMBOLS[data])
    out["n_symbols"] = np.diff(np.searchsorted(at, ends)).astype(np.int64)
    out["n_dup_lines"] = np.fromiter(map(_repeat_lines, texts.to_pylist()), np.int64, n)

    # words that lie in a 3-word window found twice or more in their text
    codes = words.codes.astype(np.uint64)
    covered = np.zeros(len(codes) + 2, bool)
    if len(codes) >= 3:
        size = np.uint64(len(words.vocab))
        start = np.flatnonzero(doc[:-2] == doc[2:])
        window = codes[start] * size + codes[start + 1]
        if len(words.vocab) >= 1 << 21:  # three codes no longer fit in 64 bits
            window = np.unique(window, return_inverse=True)[1].astype(np.uint64)
        window = window * size + codes[start + 2]
        order = np.argsort(window, kind="stable")  # documents stay in order within a window
        same = (window[order][1:] == window[order][:-1]) & (doc[start[order]][1:] == doc[start[order]][:-1])
        twice = np.zeros(len(start), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = start[twice]
        for k in range(3):
            covered[hit + k] = True
    out["n_repeat_words"] = sums(covered[: len(codes)])

    # the script most letters belong to, counted by distinct word
    scripts = _script_table()
    points = np.frombuffer("".join(words.vocab.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = scripts[np.minimum(points, len(scripts) - 1)]
    best, most = np.zeros(n, np.int64), np.zeros(n, np.int64)
    word_of = np.repeat(np.arange(len(chars)), chars)
    for k in range(1, len(SCRIPTS) + 1):
        if (of := kinds == k).any():
            count = sums(np.bincount(word_of[of], minlength=len(chars))[words.codes])
            best, most = np.where(count > most, k, best), np.maximum(count, most)
    out["script"] = best
    return out


LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class _Judge:
    """Measures and verdict of an array of texts."""

    def __init__(self, vocabularies: Mapping[str, str] | None, bands: Mapping[str, Mapping[str, Band]] | None, min_words: int, max_repeat_percent: int):
        self.paths = dict(vocabularies or {k: tokenizer_path(v) for k, v in VOCABULARIES.items()})
        bands = dict(bands or BANDS)
        self.min_words, self.max_repeat_percent = min_words, max_repeat_percent
        self.scripts = ["other", *SCRIPTS]
        self.names = [f"{v}_{m}" for v in self.paths for m in MEASURES]
        self.limits = np.array([[getattr(bands.get(s, bands["other"])[v], m) for v in self.paths for m in MEASURES] for s in self.scripts])

    def __call__(self, texts: pa.Array) -> dict[str, np.ndarray]:
        texts = texts_of(texts)
        words = Words(texts)
        out = word_measures(words, texts)
        encoders = resident(("fertility", *self.paths.values()), lambda: [vocabulary_encoder(p) for p in self.paths.values()])
        for v, (encoder, is_byte) in zip(self.paths, encoders, strict=True):
            out |= {f"{v}_{m}": x for m, x in fertility(words, encoder, is_byte, out["word_chars"]).items()}
        out["base_failed"] = (out["n_words"] < self.min_words) | (100 * out["n_repeat_words"] > self.max_repeat_percent * out["n_words"])
        band = self.limits[out["script"]]
        out["outside"] = np.column_stack([(out[c] < band[:, k, 0]) | (out[c] > band[:, k, 1]) for k, c in enumerate(self.names)])
        out["kept"] = ~out["base_failed"] & ~out["outside"].any(1)
        return out


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabularies: Mapping[str, str] | None = None,
    bands: Mapping[str, Mapping[str, Band]] | None = None,
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """Base and fertility measures of every whole text, and whether it is kept.

    base_failed: fewer than min_words words, or more than max_repeat_percent of the words in
    repeated 3-word windows. kept: not base_failed, and characters per token, byte-fallback
    share and token entropy of each vocabulary (name: path) lie in the band of the document's
    script (bands, "other" where a script has none). rejected_by lists the measures outside
    their bands. Words are encoded one by one, which drops white space; a word costs one
    encoding per batch however often it occurs. A null text counts as empty: no words,
    base_failed, not kept. Rows are independent: ties, repeats and extra columns change
    nothing, an empty table gives an empty result.
    """
    ensure_importable(docs.sparkSession)
    judge = _Judge(vocabularies, bands, min_words, max_repeat_percent)
    names = judge.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                m = judge(part.column("text"))
                by = [[c for c, x in zip(names, row, strict=True) if x] if row.any() else [] for row in m["outside"]]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(m[c], pa.int64()) for c in LONGS], pa.array(m["base_failed"]), pa.array(m["kept"]), *[pa.array(m[c], pa.float64()) for c in names], pa.array([judge.scripts[k] for k in m["script"]], pa.string()), pa.array(by, pa.list_(pa.string()))],
                    names=["doc_id", *LONGS, "base_failed", "kept", *names, "script", "rejected_by"],
                )

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, {', '.join(f'{c} long' for c in LONGS)}, base_failed boolean, kept boolean, {', '.join(f'{c} double' for c in names)}, script string, rejected_by array<string>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def rejections(judged: DataFrame) -> DataFrame:
    """(script, measure, rejected, documents) of a result of quality_rules, among the documents that pass the base rules."""
    passed = judged.where("not base_failed")
    total = passed.groupBy("script").agg(F.count("*").alias("documents"))
    by = passed.select("script", F.explode("rejected_by").alias("measure")).groupBy("script", "measure").agg(F.count("*").alias("rejected"))
    return by.withColumnRenamed("script", "b_script").join(total, F.col("b_script") == F.col("script")).select("script", "measure", "rejected", "documents")


def bands_of(judged: DataFrame, tail: float = 0.001) -> DataFrame:
    """(script, measure, low, high): quantiles of each measure among the documents that pass the base rules.

    What a fitted band would be: low and high leave a share of tail on either side. The
    quantiles are Spark's approximate ones, whose rank error is a tenth of tail at most.
    """
    names = [c for c in judged.columns if any(c.endswith(f"_{m}") for m in MEASURES)]
    long = judged.where("not base_failed").select("script", F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("measure", "x"))
    q = F.percentile_approx("x", [tail, 1 - tail], int(10 / tail))
    return long.groupBy("script", "measure").agg(q.alias("q")).select("script", "measure", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def keep_good(docs: DataFrame, text_col: str = "text", **rules) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns, whatever these are named, in one pass without a join."""
    ensure_importable(docs.sparkSession)
    judge = _Judge(rules.get("vocabularies"), rules.get("bands"), rules.get("min_words", 50), rules.get("max_repeat_percent", 50))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                kept = pa.array(judge(part.column("text"))["kept"])
                yield pa.RecordBatch.from_arrays([part.column("text").filter(kept), part.column("row").filter(kept)], names=["text", "row"])

    others = [c for c in docs.columns if c != text_col]
    filler = "_" * (1 + max(map(len, docs.columns)))  # longer than any name, so that it is none of them
    packed = docs.select(F.col(quoted(text_col)).alias("text"), F.struct(*[F.col(quoted(c)) for c in others], F.lit(0).alias(filler)).alias("row"))
    good = packed.mapInArrow(run, packed.schema)
    return good.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
