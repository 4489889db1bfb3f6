import random

import pytest

#: Names that the operators use inside; documents may bring columns of these names.
CLASHING = ["key", "start", "node", "block", "held_out", "score", "size", "kept", "digest", "row", "spans", "x", "h", "unit", "piece", "length", "copies", "label", "__", "a.b", "keep_id", "digest.row", "place", "tick`ed"]


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, a long text, ties, near copies and repeated rows."""
    rng = random.Random(5)
    base = words(rng, 120)
    near = base.split()
    near[60] = "changed"
    passage = words(rng, 60)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), "en", "b"), (4, None, "de", None), (5, "", None, "b"), (6, " \n\t ", "de", "c"),
        (7, words(rng, 4000), "en", "c"), (8, words(rng, 3), "en", "a"), (9, f"{words(rng, 70)} {passage} {words(rng, 70)}", "de", "a"),
        (10, f"{words(rng, 80)}\n{passage}\n{words(rng, 60)}", "de", "b"), (None, words(rng, 60), "en", "a"), (11, "çé ñß 日本語 \U0001f600 " * 30, None, "a"),
        (12, "a" * 700, "en", "a"), (13, "###!!! 123 $$$ " * 40, "en", "a"), (1, base, "en", "a"), (14, "one line\n" * 80, "en", "a"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(*r, len(r[1]) if r[1] is not None else None) for r in odd_rows()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)])


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
