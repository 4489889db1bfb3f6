"""Every operator on odd rows, on an empty table, and on nothing but nulls."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm import binslack, dac, exact, fertility, langid, media, mixing, neardup, ppm, qda, suffix

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def labels_of(docs):
    from pyspark.sql import functions as F

    return docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))


OPERATORS = {
    "op1": lambda d: fertility.quality_rules(d),
    "op2": lambda d: langid.identify(d),
    "op3": lambda d: qda.quality_scores(d, labels_of(d)),
    "op4": lambda d: ppm.score_texts(d),
    "op5": lambda d: neardup.near_duplicates(d),
    "op6": lambda d: dac.read_ids(dac.write_ids(d, partitions=3)),
    "op7": lambda d: mixing.mix(d),
    "op8": lambda d: media.text_media(d),
    "op9": lambda d: suffix.remove_repeats(d.select("doc_id", "text"), output="digest"),
    "op10": lambda d: binslack.pack(d),
    "op12": lambda d: exact.exact_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_all_come_back(name, odd):
    got = OPERATORS[name](odd)
    ids = Counter(r["doc_id"] for r in got.collect() if name != "op10" or r["piece"] == 0)
    assert ids == Counter(r["doc_id"] for r in odd.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, empty):
    assert OPERATORS[name](empty).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_only_nulls(name, spark):
    rows = spark.createDataFrame([(None, None, None, None)] * 2, "doc_id long, text string, lang string, source string")
    assert len(OPERATORS[name](rows).collect()) == 2


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_quality_rules_values(odd):
    got = by_id(OPERATORS["op1"](odd))
    assert got[4]["n_words"] == 0 and got[4]["base_failed"] and not got[4]["kept"]
    assert got[14]["n_dup_lines"] == 79 and got[14]["n_repeat_words"] == 160 and got[14]["base_failed"]
    assert got[13]["n_symbols"] == 6 * 40 and not got[13]["kept"]
    assert got[8]["base_failed"]


def test_language_of_nothing(odd):
    got = by_id(OPERATORS["op2"](odd))
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (4, 5, 6))
    assert got[7]["lang_pred"] in ("en", "de") and 0 <= got[7]["score"] <= 1


def test_quality_scores_bounds(odd):
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in OPERATORS["op3"](odd).collect())


def test_ppm_base_of_empty(odd):
    got = OPERATORS["op4"](odd).collect()
    train = [r for r in odd.collect() if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2]
    counts = Counter(w for r in train for w in [*WORD.findall((r["text"] or "").encode().lower()), b"\n"])
    total = sum(counts.values())
    for r in got:
        assert r["train_tokens"] == total
        if r["doc_id"] == 4:
            assert r["n_tokens"] == r["n_known"] == 1
            assert math.isclose(r["base_score"], math.log10((len(train) + 1) / (total + len(counts) + 1)))


def test_near_duplicates_of_odd_rows(odd):
    rows = OPERATORS["op5"](odd).collect()
    got = {r["doc_id"]: r for r in rows}
    assert got[2]["component_id"] == got[3]["component_id"] == 1 and not got[2]["kept"] and not got[3]["kept"]
    assert all(got[k]["component_id"] == k and got[k]["kept"] and got[k]["n_shingles"] == 0 for k in (4, 5, 6))
    assert got[8]["n_shingles"] == 1 and got[None]["component_id"] is None and got[None]["kept"]


def test_media_round_trip(odd):
    got = by_id(OPERATORS["op8"](odd))
    for r in odd.collect():
        raw = (r["text"] or "").encode()
        body = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        g = got[r["doc_id"]]
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:]))
        stored = media.to_image(body)
        assert (g["media_bytes"], g["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest()) and media.from_image(stored) == body


def test_mix_budget(odd):
    rows = OPERATORS["op7"](odd).collect()
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    twins = [r["taken"] for r in rows if r["doc_id"] == 1]
    assert len(set(twins)) == 1
    assert math.isclose(sum({r["source"]: r["target"] for r in rows}.values()), 1.5 * sum(r["size"] for r in rows))
