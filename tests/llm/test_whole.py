"""Results over whole tables and very long texts against plain-Python versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import binslack, common, dac, fertility, langid, media, mixing, neardup, ppm, qda, queries, suffix

from .conftest import words

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(common.tokenizer_path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r["doc_id"]: r["text"] or "" for r in common.documents(spark, small).collect()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# 1 quality rules -----------------------------------------------------------------------------


def plain_base(text):
    found = WORD.findall(text)
    grams = Counter(zip(found, found[1:], found[2:]))
    covered = {i + k for i, g in enumerate(zip(found, found[1:], found[2:])) if grams[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(found), sum(map(len, found)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def plain_measures(text):
    """Measures of both vocabularies, one word at a time."""
    import base64

    import public_tokenizers
    import sentencepiece
    import tiktoken

    piece = sentencepiece.SentencePieceProcessor(model_file=common.tokenizer_path("piece_bpe_32k.model"))
    with open(common.tokenizer_path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    multi = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = WORD.findall(text)
    out = {}
    for name, ids in (("piece", [i for w in found for i in piece.encode(w)]), ("multi", [i for w in found for i in multi.encode_ordinary(" " + w)])):
        byte = sum(piece.is_byte(i) and int(piece.id_to_piece(i)[3:5], 16) > 127 for i in ids) if name == "piece" else sum(len(b := multi.decode_single_token_bytes(i)) == 1 and b[0] > 127 for i in ids)
        parts = [ids[a : a + 64] for a in range(0, len(ids), 64) if a == 0 or len(ids) - a > 32]
        bits = [sum(-n / len(p) * math.log2(n / len(p)) for n in Counter(p).values()) / math.log2(max(len(p), 2)) for p in parts]
        out |= {f"{name}_chars_per_token": sum(map(len, found)) / max(len(ids), 1), f"{name}_byte_share": byte / max(len(ids), 1), f"{name}_entropy": sum(bits) / max(len(bits), 1)}
    return out


def test_quality_rules_against_plain_counts(spark, small, texts):
    rows = {r["doc_id"]: r for r in queries.op1_fertility(spark, small).collect()}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        r, (n, chars, symbols, lines, repeats) = rows[i], plain_base(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeats)
        assert r["base_failed"] == (n < 50 or 100 * repeats > 50 * n)
    for i in sorted(texts)[:25]:
        r, m = rows[i], plain_measures(texts[i])
        assert all(math.isclose(r[c], v, rel_tol=1e-9, abs_tol=1e-9) for c, v in m.items())
        outside = [c for c, v in m.items() if not (lo_hi := getattr(fertility.BANDS["latin"][c.split("_")[0]], c.split("_", 1)[1]))[0] <= v <= lo_hi[1]]
        assert r["script"] == "latin" and r["rejected_by"] == outside and r["kept"] == (not r["base_failed"] and not outside)


def test_each_measure_rejects_what_it_is_for(spark):
    rng = random.Random(8)
    clean = words(rng, 300)
    hexes = " ".join("".join(rng.choices("0123456789ABCDEFxq", k=24)) for _ in range(120))
    rare = " ".join("abc" + "".join(chr(rng.randint(0x10300, 0x1031F)) for _ in range(2)) for _ in range(200))
    junk = " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in ("the of and in to is was for that with as " * 30).split()[:: rng.choice([1])])
    shuffled = junk.split()
    rng.shuffle(shuffled)
    got = {r["doc_id"]: r for r in fertility.quality_rules(spark.createDataFrame([(0, clean), (1, hexes), (2, rare), (3, " ".join(shuffled))], "doc_id long, text string")).collect()}
    assert not any(got[k]["base_failed"] for k in range(4)), got
    assert any(x.endswith("chars_per_token") for x in got[1]["rejected_by"])
    assert any(x.endswith("byte_share") for x in got[2]["rejected_by"])
    assert any(x.endswith("entropy") for x in got[3]["rejected_by"])


def test_bands_hold_and_reject(spark):
    judged = fertility.quality_rules(common.documents(spark, "/root/testdata/sf0.01")).cache()
    by = {r["measure"]: r["rejected"] for r in fertility.rejections(judged).collect()}
    passed, kept = judged.where("not base_failed").count(), judged.where("kept").count()
    assert by.get("multi_entropy", 0) > 0.03 * passed and kept > 0.85 * passed
    fitted = {r["measure"]: (r["low"], r["high"]) for r in fertility.bands_of(judged, 0.01).collect()}
    assert set(fitted) == {f"{v}_{m}" for v in fertility.VOCABULARIES for m in fertility.MEASURES} and all(a <= b for a, b in fitted.values())
    judged.unpersist()


# 2 language, 3 quality -----------------------------------------------------------------------


def tiny_network():
    rng = np.random.default_rng(4)
    symbols = rng.integers(3, 30, (6, langid.WINDOW)).astype(np.uint8)
    return langid.train(symbols, np.array([0, 1, 2, 0, 1, 2]), 3, epochs=1, batch=3), symbols


def plain_forward(net, row):
    total = langid.FILTERS * len(langid.WIDTHS)
    best = np.full(total, -np.inf)
    span = max(langid.WIDTHS)
    for at in range(len(row) - span + 1):
        patch = np.concatenate([net.embed[s] for s in row[at : at + span]])
        best = np.maximum(best, patch @ net.filters)
    z = np.maximum(best + net.bias, 0) @ net.out + net.out_bias
    e = np.exp(z - z.max())
    return e / e.sum()


def test_network_forward_pass():
    net, symbols = tiny_network()
    assert np.allclose(net.probabilities(symbols), [plain_forward(net, s) for s in symbols], atol=1e-5)
    widths = np.repeat(langid.WIDTHS, langid.FILTERS)
    for f, width in enumerate(widths):  # a filter sees as many symbols as it is wide
        assert (net.filters[width * langid.DIMS :, f] == 0).all()


def test_network_learns_what_it_is_shown():
    rng = np.random.default_rng(6)
    base = rng.integers(3, 12, (240, langid.WINDOW)).astype(np.uint8)
    target = np.arange(240) % 3
    for row, t in zip(base, target):
        row[rng.integers(0, 250)] = 20 + t  # one symbol tells the class
    net = langid.train(base[:180], target[:180], 3, epochs=30)
    assert (net.probabilities(base[180:]).argmax(1) == target[180:]).mean() > 0.8


def test_letters_are_those_of_unicode():
    assert langid.has_letter("é") and langid.has_letter("日") and langid.has_letter("1 a") and langid.has_letter("ªʰ")
    assert not any(map(langid.has_letter, ["", "½ ² ³", "12 _ !", "٣", "Ⅷ", "́"]))


def test_log_densities_of_the_discriminant():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (300, len(qda.STATISTICS))) @ rng.normal(0, 1, (len(qda.STATISTICS),) * 2)
    y = (x[:, 0] + rng.normal(0, 1, 300) > 0).astype(int)
    model = qda._fit_classes(x, y, 0.2, 0.1)
    z = np.clip((x - model.shift) / model.scale, -12, 12)
    logs = []
    for mean, factor in zip(model.means, model.factors):
        cov = factor @ factor.T
        d = z - mean
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.difference(x), logs[1] - logs[0], rtol=1e-7, atol=1e-7)


# 4 language model ----------------------------------------------------------------------------


def plain_ppm(texts, train, order):
    """Score, base score and known tokens of each text."""
    tokens = {i: [*(w.encode().lower() for w in WORD.findall(t)), b"\n"] for i, t in texts.items()}
    unigram = Counter(w for i in train for w in tokens[i])
    total, kinds = sum(unigram.values()), len(unigram)
    seen = {}
    for i in train:
        s = b"\n" * order + b" ".join(tokens[i][:-1]) + b"\n"
        for p in range(order, len(s)):
            for k in range(order + 1):
                seen.setdefault(s[p - k : p], Counter())[s[p]] += 1
    out = {}
    for i, words_ in tokens.items():
        s, bits = b"\n" * order + b" ".join(words_[:-1]) + b"\n", 0.0
        for p in range(order, len(s)):
            gone = set()
            for k in range(order, -2, -1):
                if k < 0:
                    bits -= math.log10(256 - len(gone))
                    break
                here = seen.get(s[p - k : p], {})
                live = {a: n for a, n in here.items() if a not in gone}
                t, d = sum(live.values()), len(live)
                if s[p] in live:
                    bits += math.log10(live[s[p]] / (t + d))
                    break
                if d:
                    bits += math.log10(d / (t + d))
                gone |= set(here)
        base = sum(math.log10((unigram[w] + 1) / (total + kinds + 1)) for w in words_)
        out[i] = (len(words_), sum(unigram[w] > 0 for w in words_), total, base, bits)
    return out


def test_ppm_columns_against_plain_recursion(spark, texts, monkeypatch):
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 1 << 14)
    monkeypatch.setattr(ppm, "STEP_BYTES", 1 << 12)
    some = {i: t for i, t in list(texts.items())[:60]} | {-1: "", -2: "  \n", -3: "Ünï 日本 ÀB Z"}
    train = [i for i in some if zlib.crc32(str(i).encode()) % 7 != 2]
    docs = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    want = plain_ppm(some, train, 4)
    rows = ppm.score_texts(docs, order=4).collect()
    assert len(rows) == len(some)
    for r in rows:
        n, known, total, base, bits = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, r["doc_id"] not in train)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], bits, rel_tol=1e-9)


def test_ppm_frames_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 700):
        keys, codes = np.sort(rng.integers(0, 1 << 48, n).astype(np.uint64)), rng.choice(rng.normal(size=9), n)
        assert (ppm._read_numbers(ppm._numbers(keys), np.uint64) == keys).all() and (ppm._read_values(ppm._values(codes), np.float64) == codes).all()


# 6 token ids, 10 packing ---------------------------------------------------------------------


def test_read_ids_against_plain_tokens(spark, small, texts, tokenizer):
    rows = {r["doc_id"]: r for r in queries.op6_token_ids(spark, small).collect()}
    start = 0
    for i in sorted(texts):
        ids = [*tokenizer.encode(texts[i], add_special_tokens=False).ids, 2]
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)


def plain_pieces(i, text, tokenizer, capacity=2048):
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
    return [(i, k, a, len(ids[a : a + capacity]), crc(ids[a : a + capacity])) for k, a in enumerate(range(0, len(ids), capacity))]


def test_pieces_against_plain_tokens(spark, small, texts, tokenizer):
    got = sorted(tuple(r)[:5] for r in queries.op10_packing(spark, small).collect())
    assert got == sorted(p for i, t in texts.items() for p in plain_pieces(i, t, tokenizer))


# 8 media -------------------------------------------------------------------------------------


def test_sequences_of_real_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    rows = media.sequences(pages).collect()
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    assert len(rows) == len(html)
    for r in rows:
        assert [x["position"] for x in r["items"]] == list(range(len(r["items"])))
        at = 0
        plain = re.sub(r"\s+", " ", html[r["page_id"]] or "")
        for x in r["items"]:  # texts without entities or inner tags stand in the page in this order
            if x["kind"] == "text" and x["text"] in plain[at:]:
                at = plain.index(x["text"], at)


def test_media_keep_their_place(spark, small, texts):
    for r in queries.op8_media(spark, small).collect():
        assert r["position"] == 1 and r["caption"] == f"{len(texts[r['doc_id']].encode())} bytes" and r["n_bytes"] == len(texts[r["doc_id"]].encode())


# very long texts -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def long_rows():
    """Two texts of over 2 MB that share a passage across the operators' pieces, one word of 1 MB, and short ones."""
    rng = random.Random(21)
    passage = words(rng, 80)
    a = words(rng, 400_000)
    b = words(rng, 400_000)
    cut = (1 << 20) - 150
    return {1: f"{a[:cut]} {passage} {a[cut:]}", 2: f"{b[: 2 * cut]} {passage} {b[2 * cut :]}", 3: "Ab1" * 350_000, 4: passage, 5: words(rng, 90)}


def test_very_long_texts(spark, long_rows, tokenizer):
    assert len(long_rows[1]) > 2_000_000
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "de", "s") for i, t in long_rows.items()], "doc_id long, text string, lang string, source string")
    by = lambda df: {r["doc_id"]: r for r in df.collect()}
    got = by(fertility.quality_rules(docs))
    for i, t in long_rows.items():
        assert got[i]["n_words"] == len(WORD.findall(t)) and got[i]["word_chars"] == sum(map(len, WORD.findall(t)))
    assert set(by(langid.identify(docs))) == set(long_rows)
    assert all(0 <= r["score"] <= 1 for r in qda.quality_scores(docs, spark.createDataFrame([(1, 1), (2, 0), (4, 1)], "doc_id long, quality int")).collect())
    scored = by(ppm.score_texts(docs))
    assert all(scored[i]["n_tokens"] == len(WORD.findall(t)) + 1 and scored[i]["score"] < 0 for i, t in long_rows.items())
    near = by(neardup.near_duplicates(docs))
    for i, t in long_rows.items():
        found = WORD.findall(t.lower())
        assert near[i]["n_shingles"] == (len(set(zip(*(found[k:] for k in range(5))))) if len(found) >= 5 else 1) and near[i]["kept"]
    ids = {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in long_rows.items()}
    coded = by(dac.read_ids(dac.write_ids(docs)))
    assert all(coded[i]["ids_crc32"] == crc([*x, 2]) for i, x in ids.items())
    pieces = binslack.pack(docs).collect()
    assert Counter(r["doc_id"] for r in pieces) == {i: -(-(len(x) + 1) // 2048) for i, x in ids.items()}
    kept = by(media.text_media(docs))
    sizes = {r["doc_id"]: r["size"] for r in mixing.mix(docs).collect()}
    gone = by(suffix.remove_repeats(docs, output="digest"))
    for i, t in long_rows.items():
        raw = t.encode()
        body = raw + b"\xff" * (-len(raw) % 576)
        assert kept[i]["n_bytes"] == len(raw) and kept[i]["payload_sha256"] == hashlib.sha256(body).hexdigest()
        assert sizes[i] == len(WORD.findall(t))
        assert gone[i]["n_bytes"] == len(raw)
    passage = len(long_rows[4].encode())
    assert gone[4]["n_removed"] == passage and gone[5]["n_removed"] == 0 and gone[3]["n_removed"] == len(long_rows[3])
    assert all(passage <= gone[i]["n_removed"] <= passage + 40 and gone[i]["n_spans"] == 1 for i in (1, 2))


# the pipeline --------------------------------------------------------------------------------


def plain_links(sets, percent):
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = list(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def plain_repeats(texts, length=200):
    raw = {i: t.encode() for i, t in texts.items()}
    count = Counter(b[k : k + length] for b in raw.values() for k in range(len(b) - length + 1))
    out = {}
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        out[i] = bytes(x for x, g in zip(b, gone) if not g).decode(errors="ignore")
    return out


def plain_mix(sizes, sources):
    """How often each document is taken: thresholds over the documents sorted by hash."""
    names = sorted(set(sources.values()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    size = {s: sum(sizes[i] for i in sizes if sources[i] == s) for s in names}
    left, free, target = 1.5 * sum(size.values()), list(names), {}
    while True:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * level >= 2 * size[s]]
        if not full:
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
            free.remove(s)
    target |= {s: weight[s] * level for s in free}
    taken = {}
    for s in names:
        whole = math.floor(target[s] / size[s]) if size[s] else 0
        need, run = target[s] - whole * size[s], 0
        for i in sorted((i for i in sizes if sources[i] == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()[:9]):
            taken[i] = whole + (whole < 2 and (need - run) * 2 >= sizes[i])
            run += sizes[i]
    return {i: k for i, k in taken.items() if sizes[i] and k}


def test_pipeline_against_plain_python(spark, small, tokenizer, tmp_path):
    import corpus_pipeline

    rng = random.Random(77)
    found = common.documents(spark, small).orderBy("doc_id").collect()
    base = [r["text"] for r in found if 60 <= len((r["text"] or "").split()) <= 500][:55]
    shared = " ".join(base[0].split()[:45])
    rows = []
    for i, text in enumerate(base):
        if i % 7 == 0:
            text = f"{text[:300]} {shared} {text[300:]}"
        if i % 11 == 0 and i:
            text = rows[i - 5][1] + " extra end"  # a near copy
        if i % 13 == 0:
            text = "the same words again and again " * 20
        if i % 17 == 0:
            text = " ".join(text.split()[:20])
        rows.append((i, text, "en", f"src{rng.randrange(4)}", len(text)))
    rows += [(100, base[2], "en", "src1", 1), (101, None, None, None, None), (102, "", "en", "src2", 0)]
    sources = {r[0]: r[3] for r in rows}
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))

    texts = {}
    for i, text, *_ in rows:
        n, _, _, _, repeats = plain_base(text or "")
        if n < 50:
            continue
        inside = all((b := getattr(fertility.BANDS["latin"][c.split("_")[0]], c.split("_", 1)[1]))[0] <= v <= b[1] for c, v in plain_measures(text).items())
        if n >= 50 and 100 * repeats <= 50 * n and inside:
            texts[i] = text
    assert 30 < len(texts) < 55
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.lower().split()) for i, t in texts.items())}
    home = plain_links(sets, 80)
    assert any(i != h for i, h in home.items())
    once = plain_repeats({i: t for i, t in texts.items() if home[i] == i})
    assert any(once[i] != texts[i] for i in once)
    taken = plain_mix({i: len(WORD.findall(t)) for i, t in once.items()}, {i: sources[i] for i in once})
    want = sorted(p for i, k in taken.items() for p in plain_pieces(i, once[i], tokenizer) * k)

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(tuple(r)[:5] for r in got) == want
    bins = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == bins.get(r["sequence_id"], 0)
        bins[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(bins.values()) <= 2048 and len(bins) <= -(-sum(bins.values()) // 2048) + 1


def test_near_duplicates_go_by_row(spark):
    rng = random.Random(31)
    a, unique, x, y = (words(rng, 80) for _ in range(4))
    rows = [(1, a, 0, 0), (2, a, 0, 0), (2, unique, 0, 0), (7, x, 0, 0), (7, y, 0, 0), (7, y, 0, 0), (None, x, 0, 0), (9, None, 0, 0), (9, "", 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __gone int, __again int")
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r[0], r[1]) for r in kept.collect()), key=key) == sorted([(1, a), (2, unique), (7, x), (7, y), (None, x), (9, None), (9, "")], key=key)
