"""Language-model scoring by prediction by partial matching over byte contexts.

The model is a trie of all contexts of up to `order` bytes seen in the training texts, held
as counts of byte strings of order + 1 bytes. A symbol is coded at the longest context that
knows it; every longer context costs an escape (method C: as many escapes as it has distinct
symbols), and symbols of longer contexts are excluded from shorter ones. As counts are those
of all suffixes, the symbols of a context are among those of each of its suffixes, so what is
excluded at one order are just the symbols one order up.

The trie is never in one place. Texts are gathered into blocks of bounded size, in the order
in which they are read. A block names the strings and words it holds, with its training
counts, dealt into cells by a hash of the string; a cell sums the counts of all blocks that
name its strings. What is left, each different string of the corpus once, is dealt by the
last two context bytes, so that a group holds whole contexts and codes each string; the code
lengths go back to the cells, and the cells answer the blocks in the order in which they
asked. So the part that needs a context together grows with the different strings and not
with the blocks. Orders 0 and 1, at most 65,536 counts, are shared by all groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Words, chunks, lean, remainder, texts_of, utf8_bytes, word_hashes
from tidemark.scratch import drop, ensure_importable, table

ORDER = 5
#: Bytes of text in a block, and those handled at once inside it; blocks to a cell; different strings in a group of contexts.
BLOCK_BYTES, STEP_BYTES, CELL_BLOCKS, GROUP_STRINGS = 16 << 20, 1 << 20, 2, 1 << 18
END = b"\n"
#: Kinds of rows: words, strings, counts of two-byte strings, training documents (0) and words (1).
WORDS, STRINGS, PAIRS, TOTALS = range(4)


def stream(text: str) -> bytes:
    """The coded bytes: words `[^\\x20\\x09-\\x0D]+` in lower-case ASCII letters, parted by a blank, and an end."""
    return b" ".join(text.encode().lower().split()) + END


def strings(streams: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the streams, it and the order bytes before it as a number; and the streams' ends.

    A stream begins as if order ends stood before it.
    """
    pad = END * order
    data = np.frombuffer(b"".join(pad + s for s in streams), np.uint8)
    sizes = np.array([len(s) for s in streams], np.int64)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(len(data) - order, np.uint64)
    for k in range(order + 1):
        value = (value << np.uint64(8)) | data[k : len(data) - order + k]
    ends = np.cumsum(sizes)
    keep = np.ones(len(value), bool)
    for k in range(order):  # strings that end within the padding of the next stream
        keep[(ends + np.arange(len(sizes)) * order)[:-1] + k] = False
    return value[keep], ends


def _scatter(x: np.ndarray, n: int) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(20)).astype(np.int64) % n


def _group(keys: np.ndarray, n: int) -> np.ndarray:
    """Group of a string by the two context bytes next to its symbol."""
    return _scatter((keys >> np.uint64(8)) & np.uint64(0xFFFF), n)


def _split(home: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, places) of each different value of home, in ascending order; places ascend as well."""
    by = np.argsort(home, kind="stable")
    edges = np.flatnonzero(np.diff(home[by], prepend=-1))
    for places in np.split(by, edges[1:]) if len(by) else []:
        yield int(home[places[0]]), places


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.zeros(0, np.uint64), *[k for k, _ in parts]])
    counts = np.concatenate([np.zeros(0, np.int64), *[c for _, c in parts]])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """values where sorted keys equal wanted, else 0."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


class _Node:
    """Contexts of one order: totals, numbers of symbols, and counts of (context, symbol)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        seen = counts > 0
        self.keys, self.counts = keys[seen], counts[seen]
        context = self.keys >> np.uint64(8)
        self.first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, int)
        self.contexts = context[self.first]
        self.total = np.add.reduceat(self.counts, self.first) if len(self.first) else np.zeros(0, np.int64)
        self.symbols = np.diff(np.append(self.first, len(self.keys)))

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count of each string, and its context's total and number of symbols."""
        context = keys >> np.uint64(8)
        return _find(self.keys, self.counts, keys), _find(self.contexts, self.total, context), _find(self.contexts, self.symbols, context)

    def excluded(self, lower: _Node, mask: np.uint64) -> np.ndarray:
        """For each context, what its symbols count for in the context one byte shorter."""
        below = _find(lower.keys, lower.counts, self.keys & mask)
        return np.add.reduceat(below, self.first) if len(self.first) else np.zeros(0, np.int64)


def code_lengths(keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray, order: int) -> np.ndarray:
    """log10 probability of the last byte of each string after the bytes before it.

    keys are distinct and sorted and hold all strings of their contexts' last two bytes;
    pairs are the counts of all two-byte strings.
    """
    flat = np.arange(65536, dtype=np.uint64)
    single = pairs.reshape(256, 256).sum(0)
    nodes = [_Node(flat[:256], single), _Node(flat, pairs)]
    strings_of = []
    for k in range(order + 1):
        short = keys & np.uint64((1 << 8 * (k + 1)) - 1)
        strings_of.append(short)
        if k >= 2:
            nodes.append(_Node(*_merge([(short, counts)])))
    result = np.full(len(keys), -math.log10(256 - nodes[0].symbols.sum()) if nodes[0].symbols.sum() < 256 else 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(order + 1):
            count, total, symbols = nodes[k].of(strings_of[k])
            if k < order:
                above = nodes[k + 1]
                context = strings_of[k + 1] >> np.uint64(8)
                mask = np.uint64((1 << 8 * (k + 1)) - 1)
                total = total - _find(above.contexts, above.excluded(nodes[k], mask), context)
                symbols = symbols - _find(above.contexts, above.symbols, context)
            hit = np.log10(count / (total + symbols))
            escape = np.where(symbols > 0, np.log10(symbols / (total + symbols)), 0.0)
            result = np.where((count > 0) & (total > 0), hit, escape + result)
    return result


def _lookup(keys: np.ndarray, values: np.ndarray):
    """Function from strings to values by a direct table; strings that clash in it are searched."""
    bits = max(10, min(22, int(len(keys) * 4).bit_length()))
    slot = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
    held = np.zeros(1 << bits, np.int64)
    at = slot(keys)
    held[at] = np.arange(len(keys))

    def find(wanted: np.ndarray) -> np.ndarray:
        place = held[slot(wanted)]
        missed = np.flatnonzero(keys[place] != wanted)
        place[missed] = np.searchsorted(keys, wanted[missed])
        return values[place]

    return find


def _steps(texts: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        base = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, base + STEP_BYTES, side="right")))
        yield start, stop
        start = stop


def _frame(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unframe(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)


def _numbers(x: np.ndarray) -> bytes:
    """Frame of 8-byte numbers, the first bytes of all before the second: high bytes hardly differ."""
    return _frame(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T).tobytes())


def _read_numbers(raw: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unframe(raw), np.uint8).reshape(8, -1).T).reshape(-1).view(kind)


def _values(x: np.ndarray) -> bytes:
    """Frame of numbers of which many are equal: the different ones, and where each stands."""
    different, at = np.unique(x, return_inverse=True)
    return len(different).to_bytes(8, "little") + _frame(different.tobytes() + np.ascontiguousarray(at.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _read_values(raw: bytes, kind: type) -> np.ndarray:
    n, body = int.from_bytes(raw[:8], "little"), _unframe(raw[8:])
    at = np.ascontiguousarray(np.frombuffer(body, np.uint8, offset=8 * n).reshape(4, -1).T).reshape(-1).view("<u4")
    return np.frombuffer(body, kind, n)[at]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (block, size, doc_ids, held, ends, texts) of the rows (doc_id, held_out, text) of a task."""
    from pyspark import TaskContext

    lean()
    number, parts, size = TaskContext.get().partitionId() << 32, [], 0

    def block() -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        data, ends = utf8_bytes(texts_of(rows.column("text")))
        listed = [pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(c).combine_chunks()) for c in ("doc_id", "held_out")]
        frames = [pa.array([_numbers(ends[1:])], pa.binary()), pa.array([_frame(data.tobytes())], pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(data) + 64 * rows.num_rows], pa.int64()), *listed, *frames], names=["block", "size", "doc_ids", "held", "ends", "texts"])

    for batch in batches:
        for part in chunks(batch, "text", BLOCK_BYTES):
            more = (pc.sum(pc.binary_length(part.column("text"))).as_py() or 0) + 64 * part.num_rows
            if parts and size + more > BLOCK_BYTES:
                yield block()
                number, parts, size = number + 1, [], 0
            parts.append(part)
            size += more
    if parts:
        yield block()


def _counted(value: np.ndarray, learnt: bool) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and how often each occurs, or 0 if they are not learnt from."""
    value = np.sort(value)
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, int)
    return value[first], np.diff(np.append(first, len(value))) * learnt


def _word_table(words: Sequence[pa.Array], counts: Sequence[np.ndarray]) -> pa.Table:
    """The different words (w) in order and the sums of their counts (c)."""
    rows = pa.table({"w": pa.chunked_array(words, pa.large_binary()), "c": pa.chunked_array([pa.array(x, pa.int64()) for x in counts], pa.int64())})
    return rows.group_by("w", use_threads=False).aggregate([("c", "sum")]).rename_columns(["w", "c"]).sort_by("w").combine_chunks()


class _Block:
    """What a block holds: its texts' words and strings, and how they are dealt into cells."""

    def __init__(self, row: dict, order: int, cells: int):
        ends = _read_numbers(row["ends"], np.int64)
        raw = _unframe(row["texts"])
        texts = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(raw))
        self.train = ~np.array(row["held"], bool)
        self.words, self.streams = [], []
        parts, vocab, counts = [], [], []
        for a, b in _steps(texts):
            part, train = texts.slice(a, b - a), self.train[a:b]
            words = Words(part, lower=True)
            vocab.append(words.vocab.cast(pa.large_binary()))
            counts.append(np.bincount(words.codes[np.repeat(train, words.counts)], minlength=len(words.vocab)))
            coded = list(map(stream, part.to_pylist()))
            value, stops = strings(coded, order)
            learnt = np.repeat(train, np.diff(stops, prepend=0))
            parts += [_counted(value[learnt], True), _counted(value[~learnt], False)]
            self.words.append(words)
            self.streams.append(coded)
            if len(parts) > 16:
                parts = [_merge(parts)]
        self.keys, self.counts = _merge(parts)
        self.cells = list(_split(_scatter(self.keys, cells)))
        held = _word_table(vocab, counts)
        self.vocab, self.word_counts = held.column("w").combine_chunks(), held.column("c").to_numpy()
        self.word_cells = list(_split((word_hashes(self.vocab)[0] % np.uint64(cells)).astype(np.int64)))


_ASKED = "kind int, cell long, block long, keys binary, counts binary, n long"
_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64())


def _rows(rows: Sequence[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=["kind", "cell", "block", "keys", "counts", "n"])


def _ask(row: dict, order: int, cells: int) -> pa.RecordBatch:
    """What one block needs to know. Cells of words come after those of strings."""
    it, block = _Block(row, order, cells), row["block"]
    out = [(STRINGS, k, block, _numbers(it.keys[at]), _values(it.counts[at]), None) for k, at in it.cells]
    out += [(WORDS, cells + k, block, _frame(b"\n".join(it.vocab.take(pa.array(at)).to_pylist())), _values(it.word_counts[at]), None) for k, at in it.word_cells]
    seen = it.counts > 0
    two, c = _merge([(it.keys[seen] & np.uint64(0xFFFF), it.counts[seen])])
    out += [(PAIRS, int(k), block, None, None, int(v)) for k, v in zip(two, c, strict=True)]
    out += [(TOTALS, 0, block, None, None, int(it.train.sum())), (TOTALS, 1, block, None, None, int(it.word_counts.sum()))]
    return _rows(out)


def _sum_cell(group: pa.Table) -> pa.Table:
    """The different strings of a cell with their counts; n tells how many."""
    cell = group.column("cell")[0].as_py()
    asked = zip(group.column("keys").to_pylist(), group.column("counts").to_pylist(), strict=True)
    keys, n = _merge([(_read_numbers(k, np.uint64), _read_values(c, np.int64)) for k, c in asked])
    return pa.Table.from_batches([_rows([(STRINGS, cell, -1, _numbers(keys), _values(n), len(keys))])])


def _code_group(group: pa.Table, pairs: np.ndarray, order: int) -> pa.Table:
    """Code lengths of the strings of a group of contexts, one row for each cell that sent some."""
    cells = group.column("cell").to_pylist()
    lists = [_read_numbers(x, np.uint64) for x in group.column("keys").to_pylist()]
    keys, n = _merge(list(zip(lists, [_read_values(x, np.int64) for x in group.column("counts").to_pylist()], strict=True)))
    codes = code_lengths(keys, n, pairs, order)
    return pa.Table.from_batches([_rows([(STRINGS, c, -1, _numbers(x), _values(codes[np.searchsorted(keys, x)]), None) for c, x in zip(cells, lists, strict=True)])])


def _answer(asked: pa.Table, coded: pa.Table) -> pa.Table:
    """A cell's replies: values in the order asked, and for words how many different ones were trained on."""
    rows = []
    cell, kind = asked.column("cell")[0].as_py(), asked.column("kind")[0].as_py()
    questions = list(zip(asked.column("block").to_pylist(), asked.column("keys").to_pylist(), asked.column("counts").to_pylist(), strict=True))
    if kind == WORDS:
        lists = [pa.array(_unframe(k).split(b"\n"), pa.large_binary()) for _, k, _ in questions]
        total = _word_table(lists, [_read_values(x, np.int64) for _, _, x in questions])
        known, sums = total.column("w").combine_chunks(), total.column("c").to_numpy()
        for (block, _, _), mine in zip(questions, lists, strict=True):
            rows.append((WORDS, cell, block, None, _values(sums[pc.index_in(mine, known).to_numpy()]), None))
        rows.append((TOTALS, cell, -1, None, None, int((sums > 0).sum())))
    else:
        lists = [_read_numbers(x, np.uint64) for x in coded.column("keys").to_pylist()]
        keys, codes = np.concatenate(lists), np.concatenate([_read_values(x, np.float64) for x in coded.column("counts").to_pylist()])
        by = np.argsort(keys)
        keys, codes = keys[by], codes[by]
        for block, k, _ in questions:
            rows.append((STRINGS, cell, block, None, _values(codes[np.searchsorted(keys, _read_numbers(k, np.uint64))]), None))
    return pa.Table.from_batches([_rows(rows)])


def _score(blocks: pa.Table, replies: pa.Table, order: int, cells: int) -> pa.Table:
    row = blocks.to_pylist()[0]
    it = _Block(row, order, cells)
    got = {c: x for c, x in zip(replies.column("cell").to_pylist(), replies.column("counts").to_pylist(), strict=True)}
    known = np.zeros(len(it.vocab), np.int64)
    for k, at in it.word_cells:
        known[at] = _read_values(got[cells + k], np.int64)
    codes = np.zeros(len(it.keys))
    for k, at in it.cells:
        codes[at] = _read_values(got[k], np.float64)
    find = _lookup(it.keys, codes) if len(codes) else None
    out: list[list] = [[], [], [], []]
    for words, coded in zip(it.words, it.streams, strict=True):
        value, ends = strings(coded, order)
        of_word = pc.index_in(words.vocab.cast(pa.large_binary()), it.vocab).to_numpy(zero_copy_only=False).astype(np.int64)
        count = known[of_word][words.codes]
        doc, n = words.doc_of_word(), len(words.counts)
        out[0].append(words.counts + 1)
        out[1].append(np.bincount(doc, weights=count > 0, minlength=n).astype(np.int64))
        out[2].append(np.bincount(doc, weights=np.log10(count + 1), minlength=n))
        sums = np.concatenate([[0.0], np.cumsum(find(value))])
        out[3].append(np.diff(sums[np.concatenate([[0], ends])]))
    cols = [np.concatenate(x) if x else np.zeros(0) for x in out]
    return pa.table(
        {"doc_id": blocks.column("doc_ids").combine_chunks().flatten(), "held_out": blocks.column("held").combine_chunks().flatten(), "n_tokens": pa.array(cols[0], pa.int64()), "n_words_known": pa.array(cols[1], pa.int64()), "log_counts": pa.array(cols[2], pa.float64()), "score": pa.array(cols[3], pa.float64())}
    )


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, modulus: int = 7, held: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    Texts whose crc32(id as text) mod modulus is not held train both models. The text coded
    is its sequence of words, ASCII letters in lower case, parted by blanks and closed by an
    end, the same events that base_score has as tokens. score is its log10 probability under
    the trie (see the module); base_score adds log10((c + 1) / (N + V + 1)) over the tokens.
    A null text counts as empty and is its end alone; a null id is not held out; repeated
    rows train as often as they occur, and blocks are made by position, so rows of one id
    gather nowhere. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ensure_importable(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(remainder(F.col(id_col), modulus) == held, F.lit(False)).alias("held_out"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    blocks = table(rows.mapInArrow(_blocks, f"block long, size long, doc_ids array<{id_type}>, held array<boolean>, ends binary, texts binary"), "ppm-blocks")
    volume = blocks.agg(F.sum("size")).first()[0] or 0
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = max(shuffles, -(-volume // (BLOCK_BYTES * CELL_BLOCKS)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for k in range(batch.num_rows):
                yield _ask(batch.slice(k, 1).to_pylist()[0], order, cells)

    asked = table(blocks.mapInArrow(ask, _ASKED), "ppm-asked")
    pairs = np.zeros(65536, np.int64)
    for r in asked.where(F.col("kind") == PAIRS).groupBy("cell").agg(F.sum("n").alias("n")).collect():  # 65,536 rows at most
        pairs[r["cell"]] = r["n"]
    totals = {r["cell"]: r["n"] for r in asked.where(F.col("kind") == TOTALS).groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    train_docs, train_words = totals.get(0, 0), totals.get(1, 0)

    summed = table(asked.where(F.col("kind") == STRINGS).groupBy("cell").applyInArrow(lambda g: _sum_cell(g), _ASKED), "ppm-strings")
    groups = max(shuffles, -(-(summed.agg(F.sum("n")).first()[0] or 0) // GROUP_STRINGS))

    def regroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, k, c in zip(batch.column("cell").to_pylist(), batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                keys, n = _read_numbers(k, np.uint64), _read_values(c, np.int64)
                yield _rows([(STRINGS, cell, g, _numbers(keys[at]), _values(n[at]), None) for g, at in _split(_group(keys, groups))])

    # here block is the number of the group
    coded = table(summed.mapInArrow(regroup, _ASKED).groupBy("block").applyInArrow(lambda g: _code_group(g, pairs, order), _ASKED), "ppm-codes")
    drop(summed)
    questions = asked.where(F.col("kind") <= STRINGS)
    replies = table(questions.groupBy("cell").cogroup(coded.groupBy("cell")).applyInArrow(lambda a, c: _answer(a, c), _ASKED), "ppm-replies")
    drop(asked, coded)
    distinct = (replies.where(F.col("kind") == TOTALS).agg(F.sum("n")).first()[0] or 0) + (train_docs > 0)
    tokens = train_words + train_docs
    scored = blocks.groupBy("block").cogroup(replies.where(F.col("kind") <= STRINGS).select("cell", "block", "counts").groupBy("block")).applyInArrow(
        lambda b, r: _score(b, r, order, cells), f"doc_id {id_type}, held_out boolean, n_tokens long, n_words_known long, log_counts double, score double"
    )
    base = F.col("log_counts") + math.log10(train_docs + 1) - F.col("n_tokens") * math.log10(tokens + distinct + 1)
    known = F.col("n_words_known") + int(train_docs > 0)
    return scored.select(
        "doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score"
    )
