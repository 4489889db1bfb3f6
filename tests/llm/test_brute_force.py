"""Operators against brute-force versions, round trips and held-out accuracy."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import binslack, common, dac, langid, media, neardup, ppm, queries, suffix

from .conftest import words


@pytest.fixture(scope="module")
def encoder():
    return common.bpe_encoder(common.tokenizer_path("word_bpe_49k.json"))


def plain_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(common.tokenizer_path("word_bpe_49k.json")).encode(text or "", add_special_tokens=False).ids


def test_word_wise_ids_equal_whole_text_ids(encoder):
    texts = ["It's don't WE'LL İstanbul ΣΑΣ ß ẞ ﬁ é <|endoftext|> a<|startoftext|>b 123abc's 日本 \x00 \x1c a\x85b ñ.Ñ, Éa! 's 't", "", None, "  ", "a.b,c", "...", "ÀÖØÞ÷× µª"]
    got = common.DocumentIds(pa.array(texts), encoder, 2)
    for k, text in enumerate(texts):
        assert got.ids[got.offsets[k] : got.offsets[k + 1]].tolist() == [*plain_ids(text), 2]


def test_lower_case_words_of_a_slice():
    texts = pa.array(["Éa B" * 50, "CD ef", None, "G\x0bH"] * 30)
    whole, part = common.Words(texts, lower=True), common.Words(texts.slice(41, 50), lower=True)
    a, b = whole.vocab.to_pylist(), part.vocab.to_pylist()
    assert [a[k] for k in whole.codes[whole.offsets[41] : whole.offsets[91]]] == [b[k] for k in part.codes]


@pytest.mark.parametrize("places,most", [(5, 100), (1 << 10, 40), (1 << 10, 1 << 20), (4, 3)])
def test_word_encoder_forgets_but_stays_right(places, most):
    rng = random.Random(places * most)
    calls = []
    enc = common.WordEncoder(common.each_word(lambda words: calls.append(len(words)) or [list(range(len(w) % 5)) + [len(w)] for w in words]), places, most)
    for _ in range(60):
        vocab = [("w" * rng.randint(0, 30)) + rng.choice(["", "é", "日" * 90]) for _ in range(rng.randint(0, 12))]
        vocab = list(dict.fromkeys(vocab))
        ids, lengths = enc(pa.array(vocab, pa.large_string()))
        assert ids.tolist() == [x for w in vocab for x in [*range(len(w) % 5), len(w)]] and lengths.tolist() == [len(w) % 5 + 1 for w in vocab]
    assert places < 1000 or most < 100 or sum(calls) <= 2 * 31 * 3  # a few share a place


def test_word_hashes_tell_words_apart():
    vocab = ["", "a", "a\x00", "a\x00\x00", "b", "abcdefgh", "abcdefgh\x00", "abcdefghi", "x" * 255, "x" * 256, "x" * 257, "x" * 300 + "y", "x" * 300 + "z", "é", "日本"]
    whole = common.word_hashes(pa.array(vocab, pa.large_string()))
    assert len(set(whole[0].tolist())) == len(set(whole[1].tolist())) == len(vocab)
    part = common.word_hashes(pa.array(["zz", *vocab], pa.large_string()).slice(1))
    assert (whole == part).all()


@pytest.mark.parametrize("widths", [(8, 8, 16), (4, 12, 16), (16, 16)])
def test_codes_give_any_token(widths):
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 1 << b, 700) for b in (3, 8, 14, 20, 32)]).astype(np.uint32)
    rng.shuffle(ids)
    ends = np.sort(rng.integers(0, len(ids), 40))
    ends[-1] = len(ids)
    segment = dac.Segment(dac.encode_segment(ids, ends, widths))
    assert [segment.token(k) for k in range(len(ids))] == ids.tolist()
    assert np.concatenate([segment.document(k) for k in range(len(ends))]).tolist() == ids.tolist()
    assert dac.Segment(dac.encode_segment(ids[:0], ends[:0], widths)).n_tokens == 0


def test_token_files_hold_the_documents(spark, small):
    docs = common.documents(spark, small)
    segments = dac.write_ids(docs, partitions=5).orderBy("part", "segment").collect()
    names = [i for s in segments for i in s["doc_ids"]]
    assert names == sorted(names)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for s in segments[:2]:
        read = dac.Segment(bytes(s["image"]))
        for k, i in enumerate(s["doc_ids"][:20]):
            assert read.document(k).tolist() == [*plain_ids(texts[i]), 2]


def test_fullest_combination():
    rng = random.Random(2)
    for _ in range(200):
        items = sorted({rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}.items(), reverse=True)
        capacity = rng.randint(1, 60)
        sums = {0}
        for length, n in items:
            for _ in range(n):
                sums |= {s + length for s in sums if s + length <= capacity}
        used = dict(binslack.fullest(items, capacity))
        assert sum(k * v for k, v in used.items()) == max(sums) and all(v <= dict(items)[k] for k, v in used.items())


def test_plans_use_each_piece_once():
    rng = random.Random(4)
    histogram = dict(Counter(rng.randint(1, 2048) for _ in range(3000)))
    plans = binslack.plan_bins(histogram, 2048)
    drawn = Counter()
    for times, used in plans:
        assert sum(k * n for k, n in used) <= 2048
        for k, n in used:
            drawn[k] += n * times
    assert drawn == Counter(histogram)
    assert sum(t for t, _ in plans) <= -(-sum(k * n for k, n in histogram.items()) // 2048) * 1.02 + 1


def test_packing_is_gapless(spark, small):
    rows = queries.op10_packing(spark, small).toPandas().sort_values(["sequence_id", "offset"])
    for _, x in rows.groupby("sequence_id"):
        assert x["offset"].tolist() == [0, *np.cumsum(x["length"])[:-1]] and x["length"].sum() <= 2048
    assert rows.sequence_id.nunique() <= -(-rows["length"].sum() // 2048) + 2


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(9)
    texts, base = [], [words(rng, 80).split() for _ in range(6)]
    for b in base:
        for _ in range(12):
            t = list(b)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = "w" + str(rng.randrange(99))
            texts.append(" ".join(t))
    texts += ["a b c", "A b C", "a b c d", "", None]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()) for w in ((t or "").lower().split() for t in texts)]
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs, percent=85).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]


def test_links_beyond_the_hubs(spark, monkeypatch):
    """Unlike texts around one passage share buckets; families among them are found, and nothing else."""
    monkeypatch.setattr(neardup, "BLOCK", 3)
    rng = random.Random(10)
    passage = words(rng, 60).split()
    texts = []
    for family in range(12):
        own = words(rng, 25).split()
        for copy in range(1 + family % 4):
            t = passage[:40] + own + passage[40:]
            if copy:
                t[rng.randrange(45, 60)] = f"w{family}{copy}"
            texts.append(" ".join(t))
    rng.shuffle(texts)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    for percent in (70, 80, 85):
        up = list(range(len(texts)))

        def find(i, up=up):
            while up[i] != i:
                i = up[i]
            return i

        for i in range(len(texts)):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    a, b = find(i), find(j)
                    up[max(a, b)] = min(a, b)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, percent=percent).collect()}
        assert [got[i] for i in range(len(texts))] == [find(i) for i in range(len(texts))] and len(set(got.values())) < len(texts)


def test_pruning_bound():
    limits = neardup.least_matches(0.85, 1e-6)
    assert len(limits) == neardup.HASHES // neardup.BATCH and all(b > a for a, b in zip(limits, limits[1:]))
    one = np.arange(neardup.HASHES, dtype=np.uint32)
    many = np.stack([one, one + 1, np.where(one % 10 == 0, 0, one).astype(np.uint32)])
    assert neardup.survivors(one, many, limits).tolist() == [0, 2]


def windows(pieces, n):
    count = Counter(p[i : i + n] for p in pieces for i in range(len(p) - n + 1))
    return [np.array([count[p[i : i + n]] > 1 for i in range(len(p) - n + 1)], bool) for p in pieces]


def test_suffix_sorting_against_counting():
    rng = random.Random(3)
    for trial in range(25):
        base = [bytes(rng.choices(b"abc \x00", k=rng.randint(0, 300))) for _ in range(6)] + [b"a" * 200, b"ab" * 90]
        pieces = []
        for _ in range(8):
            x = bytearray(b"".join(rng.sample(base, 2)))
            for _ in range(rng.randint(0, 3)):
                if x:
                    x[rng.randrange(len(x))] = 120
            pieces.append(bytes(x))
        got = suffix.repeated_windows(pieces, 40, bucket=(7, 100, 65536)[trial % 3])
        assert all((a == b).all() for a, b in zip(got, windows(pieces, 40)))
        home = {}
        for p in pieces:
            key, a, n = suffix.strands(np.frombuffer(p, np.uint8), 40, 10)
            assert n.sum() == max(len(p) - 39, 0) and (a[1:] == (a + n)[:-1]).all()
            for k, s, m in zip(key, a, n):
                assert all(home.setdefault(p[i : i + 40], k) == k for i in range(s, s + m))


@pytest.mark.parametrize("hot", [1 << 18, 500])
def test_repeats_against_counting(spark, small, hot, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", hot)
    docs = common.documents(spark, small).select("doc_id", "text")
    raw = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    flags = windows(list(raw.values()), 200)
    got = {r["doc_id"]: r for r in suffix.remove_repeats(docs, output="digest").collect()}
    for (i, b), f in zip(raw.items(), flags):
        gone = np.zeros(len(b) + 1, bool)
        for k in np.flatnonzero(f):
            gone[k : k + 200] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())


def test_ppm_against_plain_recursion(spark, small, monkeypatch):
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 1 << 16)
    order, docs = 3, common.documents(spark, small)
    rows = docs.select("doc_id", "text").collect()
    from zlib import crc32

    seen = {}
    for r in rows:
        if crc32(str(r["doc_id"]).encode()) % 7 != 2:
            s = b"\n" * order + ppm.stream(r["text"] or "")
            for p in range(order, len(s)):
                for k in range(order + 1):
                    seen.setdefault(s[p - k : p], Counter())[s[p]] += 1

    def code(text):
        s, total = b"\n" * order + ppm.stream(text or ""), 0.0
        for p in range(order, len(s)):
            out = set()
            for k in range(order, -2, -1):
                if k < 0:
                    total += math.log10(1 / (256 - len(out)))
                    break
                live = {a: n for a, n in seen.get(s[p - k : p], {}).items() if a not in out}
                t, d = sum(live.values()), len(live)
                if s[p] in live:
                    total += math.log10(live[s[p]] / (t + d))
                    break
                if d:
                    total += math.log10(d / (t + d))
                out |= set(seen.get(s[p - k : p], {}))
        return total

    got = {r["doc_id"]: r for r in ppm.score_texts(docs, order=order).collect()}
    for r in rows[:40]:
        assert math.isclose(got[r["doc_id"]]["score"], code(r["text"]), rel_tol=1e-9, abs_tol=1e-9)


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in common.documents(spark, sf).select("doc_id", "lang").collect()}
    rows = [r for r in queries.op2_language(spark, sf).collect() if r["held_out"] and truth[r["doc_id"]]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows]) > 0.95


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op3_quality(spark, sf).collect() if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows]) > 0.9


def test_pages_keep_order_and_captions():
    html = "<p>one</p><figure><img src='sha256:AB'><figcaption>cap &amp; tail</figcaption></figure><script>x</script>two<img src=x.png alt=alt><p>three"
    items = media.parse(html)
    assert [(i["kind"], i["text"], i["digest"], i["caption"]) for i in items] == [
        ("text", "one", None, None), ("media", None, "ab", "cap & tail"), ("text", "two", None, None), ("media", "x.png", None, "alt"), ("text", "three", None, None),
    ]
    assert [i["position"] for i in items] == list(range(5))


def test_resolving_keeps_unknown_references(spark):
    pages = spark.createDataFrame([(1, "<img src='sha256:aa' alt=p><img src='sha256:zz'>"), (2, None), (3, "<img src='sha256:aa'>")], "page_id long, html string")
    store = spark.createDataFrame([("aa", bytearray(b"1"))] * 2, "digest string, media binary")
    got = media.resolve(media.sequences(pages), media.one_each(store)).orderBy("page_id", "position").collect()
    assert [(r["page_id"], r["position"], r["caption"], r["media"]) for r in got] == [(1, 0, "p", b"1"), (1, 1, None, None), (3, 0, None, b"1")]


def test_language_windows_tile_texts():
    texts = common.texts_of(pa.array(["a" * 300, "", "é" * 10]))
    symbols, owner = langid.windows_of(*common.utf8_bytes(texts))
    assert owner.tolist() == [0, 0, 2] and (symbols[0] >= 3).all() and (symbols[1] >= 3).sum() == 300 - langid.WINDOW
