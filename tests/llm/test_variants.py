"""Spelling variants against all pairs in plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm import variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, damage=None, least=6):
    n = Counter()
    for i, text in rows:
        for run in RUN.findall((text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least:
                n[run] += 1
    return n


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(n, ratio=5):
    out, forms = {}, {}
    for w in n:
        near = [x for x in n if one_apart(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form = best if best is not None and n[best] >= ratio * n[w] else None
        forms[w], out[w] = form, (len(near), form, n[form] if form else None)
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] += (root,)
    return out


def found(df):
    return {r["word"]: (r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_words_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    words = {"".join(rng.choices("abé", k=rng.randint(5, 8))) for _ in range(220)} | {"aaaaaa", "aaaaaaa", "aabaaa"}
    n = {w: rng.choice([5, 5, 7, 25, 125, 700, 4000]) for w in words}
    rows = [(w, k) for w, k in n.items()]
    assert found(variants.variants(spark.createDataFrame(rows, "word string, n long").repartition(5))) == plain_variants(n)


def test_chains_are_followed_to_their_end(spark):
    chain = ["aaaaaaaa"[:k] + "bbbbbbbb"[k:] for k in range(9)]
    n = {w: 5 ** (k + 1) for k, w in enumerate(chain)}
    got = found(variants.variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert {r[3] for r in got.values()} == {"aaaaaaaa"} and got == plain_variants(n)


@pytest.mark.parametrize("damage", [None, 3])
def test_counts(spark, damage):
    rng = random.Random(8)
    pieces = ["House", "houSes", "Ünder", "über", "naïve", "œuvre", "x×y÷z", "日本語", "mot-a-mot", "ÀÉÎ", "wordword", "12word", "­", "ſharp"]
    rows = [(k, " ".join(rng.choices(pieces, k=40))) for k in range(60)] + [(None, "house " * 9), (None, None), (3, ""), (3, "wordword" * 20)]
    got = variants.word_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), damage=damage, least_length=1).collect()
    assert {r["word"]: r["n"] for r in got} == plain_counts(rows, damage, 1)


def test_whole_tables(spark, small, odd, empty):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    n = {w: k for w, k in plain_counts([(r["doc_id"], r["text"]) for r in docs.collect()], 199).items() if k >= 5}
    got = variants.spelling_variants(docs, damage=199)
    assert found(got) == plain_variants(n) and {r["word"]: r["n"] for r in got.collect()} == n
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert {r["word"]: r["n"] for r in variants.spelling_variants(odd).collect()} == {w: k for w, k in plain_counts(rows).items() if k >= 5}
    assert variants.spelling_variants(empty).collect() == [] == variants.spelling_variants(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()
