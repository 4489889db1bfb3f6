"""Helpers shared by the corpus operators: word splitting and tokenisation over Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import json
import os
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.scratch import ensure_importable

#: Bytes of text handled at once inside one Arrow batch.
CHUNK_BYTES = 4 << 20
#: Places in a worker's cache of words, and ids that it holds before it starts anew: 40 MB in all.
CACHE_WORDS, CACHE_IDS = 1 << 19, 5 << 20

_resident: dict[tuple, object] = {}


def resident(key: tuple, make: Callable[[], object]) -> object:
    """The object of this key, kept in this worker until another operator's task begins here."""
    if key not in _resident:
        lean()
        _resident[key] = make()
    return _resident[key]


def lean() -> None:
    """Give back to the system what earlier tasks of this worker kept: called as a task begins that has no use for it."""
    _resident.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_importable(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def quoted(name: str) -> str:
    """The name of a column as Spark's parser reads it, dots and back ticks included."""
    return "`" + name.replace("`", "``") + "`"


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(doc_id.cast("string")) % F.lit(modulus)


def texts_of(column: pa.Array, lower: bool = False) -> pa.Array:
    """Large-string array with nulls as empty texts, and with ASCII letters in lower case if asked.

    The array is built anew from offset zero: Arrow's ascii_lower reads the wrong bytes of a slice.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    texts = pc.fill_null(column, "").cast(pa.large_string())
    data, ends = utf8_bytes(texts)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(ends)), pa.py_buffer(np.ascontiguousarray(data)))


def mapped(column: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts of a column, nulls as empty, each byte replaced by its entry of a table of 256."""
    texts = texts_of(column)
    data, ends = utf8_bytes(texts)
    return table[data], np.ascontiguousarray(ends)


def of_bytes(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Large-string array of UTF-8 bytes cut at offsets."""
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))


def utf8_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a large-string array without nulls, and the offsets of each."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about limit bytes of text each; a longer row stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start, n = 0, batch.num_rows
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of an array of texts.

    offsets[i]:offsets[i+1] delimits document i in codes; codes index vocab.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts_of(texts, lower)
        lists = pc.ascii_split_whitespace(texts)
        flat = pc.list_flatten(lists)
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        before = np.concatenate([[0], np.cumsum(full, dtype=np.int64)])
        self.offsets = before[np.concatenate([[0], np.cumsum(lengths)])]
        coded = flat.filter(pa.array(full)).dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.vocab: pa.Array = coded.dictionary
        self.counts = np.diff(self.offsets)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start..start+length."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def word_hashes(words: pa.Array) -> np.ndarray:
    """Two independent 64-bit hashes of each of an array of strings, eight bytes of all words at a time."""
    import xxhash

    data, ends = utf8_bytes(words.cast(pa.large_binary()))
    raw = np.concatenate([data, np.zeros(8, np.uint8)]).tobytes()
    eight = np.ndarray(len(data) + 1, "<u8", raw, strides=(1,))
    start, size = ends[:-1], np.diff(ends)
    out = np.stack([size.astype(np.uint64) * _M1, ~size.astype(np.uint64) * _M2])
    at, skip = np.arange(len(size)), 0
    while skip < 256:
        at = at[size[at] > skip]
        if not len(at):
            break
        left = np.minimum(size[at] - skip, 8).astype(np.uint64)
        part = eight[start[at] + skip] & (~np.uint64(0) >> ((np.uint64(8) - left) * np.uint64(8)))
        for k, (m, turn) in enumerate(((_M1, 29), (_M2, 31))):
            x = (out[k, at] ^ part) * m
            x ^= x >> np.uint64(turn)
            out[k, at] = x * (_M2 if k == 0 else _M1)
        skip += 8
    for i in at[size[at] > skip].tolist():  # the rest of very long words
        rest = raw[start[i] + skip : ends[i + 1]]
        out[0, i] ^= np.uint64(xxhash.xxh3_64_intdigest(rest))
        out[1, i] ^= np.uint64(xxhash.xxh64_intdigest(rest))
    out ^= out >> np.uint64(32)
    return out


class WordEncoder:
    """Ids of words under a tokenizer that never joins text across ASCII white space.

    encode maps an array of words to their ids, one after the other, and the number of ids of
    each. What it gave is kept in a table of fixed size with one place for each hash, so
    memory is bounded whatever the vocabulary of the corpus: a word gives way to a later one
    of the same place, and all give way when the ids kept pass a limit. Words are told apart
    by 128 bits of hash.
    """

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], places: int = CACHE_WORDS, most: int = CACHE_IDS):
        self._encode, self._bits, self._most = encode, max(places - 1, 1).bit_length(), most
        self._keys = np.zeros((2, 1 << self._bits), np.uint64)
        self._at, self._n = np.zeros(1 << self._bits, np.int32), np.zeros(1 << self._bits, np.int32)
        self._pool, self._used = np.zeros(min(most, 1 << 16), np.uint32), 0

    def _keep(self, place: np.ndarray, hashes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        if len(ids) > self._most:
            return
        if self._used + len(ids) > self._most:
            self._keys[:], self._used = 0, 0
        while len(self._pool) < self._used + len(ids):
            self._pool = np.concatenate([self._pool, np.zeros(min(len(self._pool), self._most - len(self._pool)), np.uint32)])
        self._pool[self._used : self._used + len(ids)] = ids
        last = np.full(1 << self._bits, -1, np.int32)  # of words that share a place, one is kept
        last[place] = np.arange(len(place))
        one = last[place] == np.arange(len(place))
        self._keys[:, place[one]] = hashes[:, one]
        self._at[place[one]] = (self._used + np.cumsum(lengths) - lengths)[one]
        self._n[place[one]] = lengths[one]
        self._used += len(ids)

    def __call__(self, vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words of vocab concatenated, number of ids of each word)."""
        hashes = word_hashes(vocab)
        place = (hashes[0] >> np.uint64(64 - self._bits)).astype(np.int64)
        hit = (self._keys[0, place] == hashes[0]) & (self._keys[1, place] == hashes[1])
        lengths = np.where(hit, self._n[place], 0).astype(np.int64)
        known = self._pool[ragged(self._at[place[hit]].astype(np.int64), lengths[hit])]
        miss = np.flatnonzero(~hit)
        if not len(miss):
            return known, lengths
        ids, n = self._encode(vocab.take(pa.array(miss)))
        lengths[miss] = n
        starts = np.cumsum(lengths) - lengths
        out = np.zeros(int(lengths.sum()), np.uint32)
        out[ragged(starts[hit], lengths[hit])] = known
        out[ragged(starts[miss], lengths[miss])] = ids
        self._keep(place[miss], hashes[:, miss], ids, lengths[miss])
        return out, lengths


def each_word(encode: Callable[[list[str]], list[list[int]]]) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """encode for WordEncoder from a function of a list of words."""

    def run(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths = array("I"), []
        for at in range(0, len(words), 20_000):
            for one in encode(words.slice(at, 20_000).to_pylist()):
                ids.extend(one)
                lengths.append(len(one))
        return np.frombuffer(ids, np.uint32) if len(ids) else np.zeros(0, np.uint32), np.array(lengths, np.int64)

    return run


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: A run of letters whose lower case is one letter each, and one mark: two pre-tokens at most.
_PLAIN = "^(?P<stem>[A-Za-zÀ-ÖØ-Þß-öø-ÿ]+)(?P<mark>[.,;:!?]?)$"


def bpe_encoder(path: str) -> WordEncoder:
    """Word-wise encoder for a tokenizers file that drops white space and marks word ends.

    Resident in a worker, so tasks share its cache. Plain words are lower-cased, parted from
    a closing mark and encoded many in one call; the ids that end a word tell them apart
    again. All other words are encoded one by one.
    """
    return resident(("bpe", path), lambda: _bpe_encoder(path))


def _bpe_encoder(path: str) -> WordEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    fast = getattr(model, "encode_batch_fast", model.encode_batch)
    spec = json.loads(model.to_str())
    suffix = spec["model"].get("end_of_word_suffix")
    lowers = any(n.get("type") == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", []))
    one_by_one = each_word(lambda words: [e.ids for e in fast(words, add_special_tokens=False)])
    if not (suffix and lowers):
        return WordEncoder(one_by_one)
    vocab = model.get_vocab()
    ends = np.zeros(max(vocab.values()) + 1, bool)
    ends[[i for piece, i in vocab.items() if piece.endswith(suffix)]] = True
    marks = [m for m in ".,;:!?" if len(model.encode(m, add_special_tokens=False).ids) == 1]
    mark_ids = np.array([model.encode(m, add_special_tokens=False).ids[0] for m in marks], np.uint32)

    def together(stems: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths = [], []
        for at in range(0, len(stems), 2_000):
            part = stems.slice(at, 2_000)
            got = np.array(model.encode(" ".join(part.to_pylist()), add_special_tokens=False).ids, np.uint32)
            stop = np.flatnonzero(ends[got]) + 1
            if len(stop) != len(part):
                got, n = one_by_one(part)
            else:
                n = np.diff(stop, prepend=0)
            ids.append(got)
            lengths.append(n)
        return np.concatenate(ids), np.concatenate(lengths).astype(np.int64)

    stems = WordEncoder(together)

    def encode(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.extract_regex(words, pattern=_PLAIN)
        mark = pc.index_in(pc.struct_field(split, "mark"), pa.array(["", *marks], words.type))
        plain = pc.is_valid(mark).to_numpy(zero_copy_only=False)
        at, other = np.flatnonzero(plain), np.flatnonzero(~plain)
        lengths = np.zeros(len(words), np.int64)
        if len(at):
            coded = pc.utf8_lower(pc.struct_field(split, "stem").take(pa.array(at))).dictionary_encode()
            flat, n = stems(coded.dictionary)
            stem, closing = coded.indices.to_numpy().astype(np.int64), mark.take(pa.array(at)).to_numpy().astype(np.int64)
            first = (np.cumsum(n) - n)[stem]
            lengths[at] = n[stem] + (closing > 0)
        if len(other):
            rest, lengths[other] = one_by_one(words.take(pa.array(other)))
        starts = np.cumsum(lengths) - lengths
        out = np.zeros(int(lengths.sum()), np.uint32)
        if len(at):
            out[ragged(starts[at], n[stem])] = flat[ragged(first, n[stem])]
            closed = closing > 0
            out[starts[at][closed] + n[stem][closed]] = mark_ids[closing[closed] - 1]
        if len(other):
            out[ragged(starts[other], lengths[other])] = rest
        return out, lengths

    return WordEncoder(encode)


class DocumentIds:
    """Token ids of each text of an array, an end id appended: flat ids and offsets."""

    def __init__(self, texts: pa.Array, encoder: WordEncoder, end_id: int):
        words = Words(texts)
        flat, lengths = encoder(words.vocab)
        starts = np.cumsum(lengths) - lengths
        n_docs = len(words.counts)
        per_word = lengths[words.codes]
        sums = np.concatenate([[0], np.cumsum(per_word)])[words.offsets]
        self.offsets = sums + np.arange(n_docs + 1)
        self.ids = np.full(int(self.offsets[-1]), end_id, np.uint32)
        keep = np.ones(len(self.ids), bool)
        keep[self.offsets[1:] - 1] = False
        self.ids[keep] = flat[ragged(starts[words.codes], per_word)]


def bounded_sample(rows: DataFrame, bound: int, *key: str) -> DataFrame:
    """About bound rows, chosen by a hash of the key columns; all rows where there are fewer.

    The share is bound / count, so a rerun takes the same rows. Rows that repeat a key share
    its fate, so a caller that collects limits what it collects as well.
    """
    n = rows.count()
    if n <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(*key), F.lit(1 << 30)) < F.lit(int((1 << 30) * bound / n)))
