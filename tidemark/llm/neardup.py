"""MinHash near-duplicates with sequential Bayesian verification.

1. Every text becomes the set of its hashed five-word shingles; texts with equal sets are one
   class, and only classes go on, so copies cost nothing further.
2. Classes meet in the buckets of banded MinHash signatures.
3. Each bucket has a hub, its member with the most bucket mates. Hubs are compared with
   their bucket's members, so a group of any size costs as many comparisons as it has members.
4. Buckets whose members then still lie in several components compare all members of
   different components, in pairs of blocks, and emit links only.

A comparison reads the signatures batch by batch. It ends as soon as the posterior
probability that the similarity reaches the threshold falls below the miss probability;
survivors are verified exactly on the full sets. Components are found by minimum labels
with pointer jumping over scratch tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Words, chunks, lean, quoted, texts_of, word_hashes
from tidemark.scratch import drop, ensure_importable, table

SHINGLE, BANDS, ROWS, BATCH = 5, 32, 5, 32
HASHES = BANDS * ROWS
#: Members of a hub compared in one group, members of a block, and bytes of signatures and sets that one task compares.
SPLIT, BLOCK, UNIT_BYTES = 64, 256, 4 << 20

_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; fewer words than size make one shingle."""
    words = Words(texts, lower=True)
    of_word = word_hashes(words.vocab)[0]
    h = of_word[words.codes] if len(of_word) else np.zeros(0, np.uint64)
    poly = np.zeros(max(len(h) - size + 1, 0), np.uint64)
    for k in range(size):
        poly = poly * _P + h[k : k + len(poly)]
    poly = _mix(poly)
    sets = []
    for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
        if b - a >= size:
            sets.append(np.unique(poly[a : b - size + 1]))
        elif b > a:
            x = np.array([b - a], np.uint64)
            for k in range(a, b):
                x = _mix(x * _P + h[k : k + 1])
            sets.append(x)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima over the shingles."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), 512):
        out = np.minimum(out, (x[at : at + 512, None] * _A + _B).min(0))
    return out


def bands(sig: np.ndarray) -> list[int]:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for k in range(ROWS):
        key = _mix(key * _P + rows[:, k])
    return key.view(np.int64).tolist()


def least_matches(threshold: float, miss: float) -> np.ndarray:
    """For 1, 2, ... batches, the fewest agreeing hashes that leave a posterior probability of at least miss.

    With a uniform prior, similarity after m agreements in n has a Beta(m + 1, n - m + 1)
    posterior, and it reaches t with the probability that a Binomial(n + 1, t) is at most m.
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
        out.append(m)
    return np.array(out)


def survivors(one: np.ndarray, many: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Rows of the signatures many that may reach the threshold with the signature one."""
    alive, agreed = np.arange(len(many)), np.zeros(len(many), np.int64)
    for k, least in enumerate(limits):
        part = slice(k * BATCH, (k + 1) * BATCH)
        agreed = agreed + (many[alive, part] == one[part]).sum(1)
        keep = agreed >= least
        alive, agreed = alive[keep], agreed[keep]
        if not len(alive):
            break
    return alive


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _members(group: pa.Table) -> tuple[list, np.ndarray, list[np.ndarray]]:
    sigs = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
    return group.column("node").to_pylist(), sigs, [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]


def _runs(group: pa.Table, *keys: str) -> Iterator[pa.Table]:
    group = group.sort_by([(k, "ascending") for k in keys])
    rows = list(zip(*(group.column(k).to_pylist() for k in keys), strict=True))
    start = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i] != rows[start]:
            yield group.slice(start, i - start)
            start = i


def _edges(pairs: list[tuple]) -> pa.Table:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b): the smallest node it is connected with."""
    both = table(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = table(both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("low")), "labels-near")
        hooked = table(labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.least("label", "low").alias("label"), F.col("label").alias("old")), "labels-hooked")
        top = hooked.select(F.col("node").alias("t_node"), F.col("label").alias("t_label"))
        jumped = table(hooked.join(top, F.col("label") == F.col("t_node"), "left").select("node", F.coalesce("t_label", "label").alias("label"), (F.coalesce("t_label", "label") != F.col("old")).alias("moved")), "labels")
        drop(labels, near, hooked)
        labels = jumped
        if jumped.where("moved").isEmpty():
            drop(both)
            return labels


def _sketches(rows: DataFrame, id_type: str) -> DataFrame:
    """(doc_id, digest, n_shingles, node, keys) of rows (doc_id, text): digests of text and set, and band keys."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for part in chunks(batch, "text", 2 << 20):
                sets = shingle_sets(texts_of(part.column("text")))
                node = [hashlib.md5(s).digest() if len(s) else None for s in sets]
                keys = [bands(signature(s)) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("digest"), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "digest", "n_shingles", "node", "keys"],
                )

    asked = rows.select("doc_id", "text", F.unhex(F.md5("text")).alias("digest"))
    return table(asked.mapInArrow(sketch, f"doc_id {id_type}, digest binary, n_shingles long, node binary, keys array<long>"), "sketches")


def _sets(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """(k_node, bytes, sig, shingles) of the classes in candidates (c_node, rep)."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for part in chunks(batch, "text", 2 << 20):
                sets = shingle_sets(texts_of(part.column("text")))
                # a repeated id may bring a text of another class along
                keep = [i for i, (s, c) in enumerate(zip(sets, part.column("c_node").to_pylist(), strict=True)) if hashlib.md5(s).digest() == c]
                yield pa.RecordBatch.from_arrays(
                    [part.column("c_node").take(pa.array(keep, pa.int64())), pa.array([8 * len(sets[i]) + 4 * HASHES for i in keep], pa.int64()), pa.array([signature(sets[i]).tobytes() for i in keep], pa.binary()), pa.array([sets[i].tobytes() for i in keep], pa.binary())],
                    names=["k_node", "bytes", "sig", "shingles"],
                )

    # texts are never joined by a broadcast: the plan is the same at every size
    wanted = rows.join(candidates.hint("merge"), F.col("doc_id") == F.col("rep")).select("c_node", "text")
    return table(wanted.mapInArrow(full, "k_node binary, bytes long, sig binary, shingles binary").dropDuplicates(["k_node"]), "candidate-sets")


def _units(spark, rows: DataFrame, sizes: DataFrame, times: str) -> int:
    """Number of groups of about UNIT_BYTES for rows (node) that stand times each."""
    volume = rows.join(sizes, F.col("node") == F.col("k_node")).agg(F.sum(F.expr(times) * F.col("bytes"))).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(volume) // UNIT_BYTES))


def _class_components(rows: DataFrame, sketched: DataFrame, percent: int, miss: float) -> DataFrame:
    """Scratch table (f_node, label, component_id) of all classes of sketched rows with an id."""
    spark = rows.sparkSession
    limits = least_matches(percent / 100, miss)
    classes = table(
        sketched.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")),
        "classes",
    )
    exploded = classes.select("node", F.posexplode("keys").alias("band", "key"))
    shared = table(exploded.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").withColumnsRenamed({"band": "s_band", "key": "s_key"}), "buckets")
    inside = table(
        exploded.join(shared, (F.col("band") == F.col("s_band")) & (F.col("key") == F.col("s_key"))).select("node", "band", "key", "n"), "bucket-members"
    )
    drop(shared)
    degree = table(inside.groupBy("node").agg(F.sum(F.col("n") - 1).alias("degree")), "degrees")
    ranked = inside.join(degree.withColumnRenamed("node", "d_node"), F.col("node") == F.col("d_node"))
    hubs = table(
        ranked.groupBy("band", "key").agg(F.max(F.struct("degree", "node"))["node"].alias("hub")).withColumnsRenamed({"band": "h_band", "key": "h_key"}), "hubs"
    )
    candidates = degree.select(F.col("node").alias("c_node")).join(classes.select("node", "rep"), F.col("c_node") == F.col("node")).select("c_node", "rep")
    known = _sets(rows, candidates)
    sizes = known.select("k_node", "bytes")
    drop(degree)

    # hubs against the members of their buckets; a hub with many members is dealt over several groups
    pairs = table(
        inside.join(hubs, (F.col("band") == F.col("h_band")) & (F.col("key") == F.col("h_key")))
        .where(F.col("node") != F.col("hub")).select("hub", "node").distinct(),
        "hub-pairs",
    )
    drop(hubs)
    spread = table(pairs.groupBy("hub").agg(F.ceil(F.count("*") / SPLIT).cast("long").alias("parts")).withColumnRenamed("hub", "p_hub"), "hub-parts")
    dealt = pairs.join(spread, F.col("hub") == F.col("p_hub")).select("hub", "node", F.pmod(F.xxhash64("node"), "parts").alias("part"))
    centres = spread.select(F.col("p_hub").alias("hub"), F.col("p_hub").alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    star = dealt.union(centres).join(known, F.col("node") == F.col("k_node")).select("hub", "part", "node", "sig", "shingles")

    def compare_star(group: pa.Table) -> pa.Table:
        found = []
        for run in _runs(group, "hub", "part"):
            nodes, sigs, sets = _members(run)
            hub = run.column("hub")[0].as_py()
            if hub not in nodes:
                continue
            h = nodes.index(hub)
            found += [(hub, nodes[i]) for i in survivors(sigs[h], sigs, limits) if i != h and linked(sets[h], sets[i], percent)]
        return _edges(found)

    n_units = _units(spark, pairs, sizes, "2")
    first = table(
        star.withColumn("unit", F.pmod(F.xxhash64("hub", "part"), F.lit(n_units))).groupBy("unit").applyInArrow(lambda g: compare_star(g), "a binary, b binary"), "star-links"
    )
    drop(pairs, spread)
    labels = components(first)

    # buckets that several components still share
    named = inside.join(labels.withColumnRenamed("node", "l_node"), F.col("node") == F.col("l_node"), "left").select("node", "band", "key", F.coalesce("label", "node").alias("label"))
    named = table(named, "bucket-labels")
    drop(inside)
    mixed = table(
        named.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
        .where("low <> high").select(F.col("band").alias("m_band"), F.col("key").alias("m_key"), F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks")),
        "mixed-buckets",
    )
    open_ = table(
        named.join(mixed, (F.col("band") == F.col("m_band")) & (F.col("key") == F.col("m_key"))).select("node", "band", "key", "label", "blocks", F.pmod(F.xxhash64("node"), "blocks").alias("own")),
        "open-members",
    )
    drop(named, mixed)
    # block x meets block y >= x in group (x, y)
    met = open_.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("band", "key", "node", "label", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    met = met.join(known, F.col("node") == F.col("k_node")).drop("k_node", "bytes")

    def compare_blocks(group: pa.Table) -> pa.Table:
        found = []
        for run in _runs(group, "band", "key", "x", "y"):
            nodes, sigs, sets = _members(run)
            x, y, band = run.column("x")[0].as_py(), run.column("y")[0].as_py(), run.column("band")[0].as_py()
            own = np.array(run.column("own").to_pylist())
            codes = {c: i for i, c in enumerate(sorted(set(run.column("label").to_pylist())))}
            label = np.array([codes[c] for c in run.column("label").to_pylist()])
            forest = _Forest(len(codes))
            for i in range(len(nodes)):
                later = np.arange(i + 1, len(nodes)) if x == y else np.flatnonzero(own == y) if own[i] == x else np.zeros(0, int)
                later = later[label[later] != label[i]]
                if band and len(later):  # a pair is compared in the first bucket it shares
                    earlier = sigs[later, : band * ROWS] == sigs[i, : band * ROWS]
                    later = later[~earlier.reshape(len(later), band, ROWS).all(2).any(1)]
                for j in later[survivors(sigs[i], sigs[later], limits)]:
                    if forest.find(label[i]) != forest.find(label[j]) and linked(sets[i], sets[j], percent):
                        forest.join(label[i], label[j])
                        found.append((nodes[i], nodes[j]))
        return _edges(found)

    n_units = _units(spark, open_, sizes, "blocks")
    second = table(
        met.withColumn("unit", F.pmod(F.xxhash64("band", "key", "x", "y"), F.lit(n_units))).groupBy("unit").applyInArrow(lambda g: compare_blocks(g), "a binary, b binary"), "block-links"
    )
    drop(open_, known)
    if not second.isEmpty():
        drop(labels)
        labels = components(first.union(second))
    drop(first, second)
    reps = classes.select("node", "rep").join(labels.withColumnRenamed("node", "l_node"), F.col("node") == F.col("l_node"), "left")
    reps = table(reps.select("node", "rep", F.coalesce("label", "node").alias("label")), "class-labels")
    drop(classes, labels)
    lowest = table(reps.groupBy("label").agg(F.min("rep").alias("component_id")).withColumnRenamed("label", "c_label"), "component-ids")
    final = table(reps.join(lowest, F.col("label") == F.col("c_label")).select(F.col("node").alias("f_node"), "label", "component_id"), "class-components")
    drop(reps, lowest)
    return final


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 80,
    miss: float = 1e-6,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Documents are linked when 100 * common >= percent * union of their sets of five-word
    shingles (ASCII letters in lower case); component_id is the smallest id reachable, kept
    tells whether that is the document's own. With fewer words the whole sequence is one
    shingle; a null, empty or blank text has no shingle and links with nothing. A pair at the
    threshold escapes all bands with probability (1 - t**5)**32, 3e-6 at 0.8 and 7e-9 at 0.85,
    and is pruned wrongly with the posterior probability miss at each batch; accepted links
    are always verified on full sets of 64-bit shingle hashes. Rows with a null id are not
    linked: their component is null and they are kept. Rows that repeat an id each get the
    component of their own text. An empty table gives an empty result.
    """
    ensure_importable(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sketched = _sketches(rows, docs.schema[id_col].dataType.simpleString())
    final = _class_components(rows, sketched, percent, miss)
    out = sketched.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")).join(final, F.col("node") == F.col("f_node"), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """The rows of docs without those that a row of their group stands for, all columns kept.

    Groups are those of near_duplicates, decided by row: of each group the row with the
    smallest id stays, and of several with that id the one with the least digest of its text,
    once. So rows that repeat an id go only for their own text. Rows without an id and rows
    without words stay.
    """
    ensure_importable(docs.sparkSession)
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    sketched = _sketches(rows, docs.schema[id_col].dataType.simpleString())
    final = _class_components(rows, sketched, percent, miss)
    named = sketched.where(F.col("doc_id").isNotNull()).select("doc_id", "digest", "node").join(final, F.col("node") == F.col("f_node"))
    named = table(named.groupBy("label", "doc_id", "digest").agg(F.count("*").alias("n")), "group-rows")
    drop(sketched, final)
    # written by itself, so that Spark can split the rows of a large group in the join
    best = table(named.groupBy("label").agg(F.min(F.struct("doc_id", "digest")).alias("best")).select(F.col("label").alias("w_label"), "best"), "group-best")
    judged = named.join(best, F.col("label") == F.col("w_label")).select("doc_id", "digest", "n", (F.struct("doc_id", "digest") == F.col("best")).alias("stays"))
    judged = table(judged.where("not stays or n > 1").withColumnsRenamed({"doc_id": "j_id", "digest": "j_digest"}), "group-verdicts")
    drop(named, best)

    packed = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), F.col(quoted(id_col)).alias("doc_id"), F.unhex(F.md5(F.col(quoted(text_col)))).alias("digest"))
    same = (F.col("doc_id") == F.col("j_id")) & (F.col("digest") == F.col("j_digest"))
    kept = packed.join(judged.hint("merge"), same, "left_anti")
    again = judged.where("stays")
    if not again.isEmpty():  # rows repeated with id and text, of which one stays
        kept = kept.unionByName(packed.join(again.hint("merge"), same, "left_semi").dropDuplicates(["doc_id", "digest"]))
    return kept.select("row.*")


#: All pairs by an inverted index, and reachability, for small tables.
NEARDUP_SQL = """
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
  from documents),
shingles as (
  select doc_id, unnest(case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                             when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s
  from words),
sizes as (select doc_id, count(*)::bigint as n from shingles group by doc_id),
ids as (select s.s as s, list(s.doc_id) as docs from shingles s group by s.s having count(*) > 1),
pairs as (
  select a, b, count(*) as c from (select unnest(docs) as a, docs from ids), unnest(docs) as t(b)
  where a < b group by a, b),
links as (
  select a, b from pairs p join sizes x on x.doc_id = p.a join sizes y on y.doc_id = p.b where 100 * c >= 85 * (x.n + y.n - c)),
both_ways as (select a, b from links union select b, a from links),
reach(a, b) as (select a, b from both_ways union select r.a, l.b from reach r join both_ways l on r.b = l.a),
lowest as (select a, min(b) as low from reach group by a)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(l.low, d.doc_id)) as component_id,
       d.doc_id = least(d.doc_id, coalesce(l.low, d.doc_id)) as kept
from documents d left join sizes s on s.doc_id = d.doc_id left join lowest l on l.a = d.doc_id
"""
