import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabloom.operators import keywords as kw


def brute(rows, k):
    words = [(i, re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(kw.UPPER, kw.LOWER)))) for i, t in rows]
    df = Counter(w for _, ws in words for w in set(ws))
    n = sum(bool(ws) for _, ws in words)
    out = []
    for i, ws in words:
        scored = sorted((-(c / len(ws)) * math.log((1 + n) / (1 + df[w])), w, c) for w, c in Counter(ws).items())
        out += [(i, rank + 1, w, c, df[w], round(-s, 9)) for rank, (s, w, c) in enumerate(scored[:k])]
    return sorted(out, key=str)


TEXTS = ["The cat sat on the mat. The CAT!", "a dog, a dog and the cat", "", None, "one", "ñandú Ñandú 漢字 x1 x1 x2", "the the the", "--- ...", "the end of the line the end"]


@pytest.mark.parametrize("share", [1, 5, 1000])
def test_equal_to_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(kw, "HOT_SHARE", share)
    rows = list(enumerate(TEXTS * 3))
    df = spark.createDataFrame(rows, "id long, body string").repartition(3)
    got = [(*r[:5], round(r[5], 9)) for r in kw.keywords(df, "id", "body", 3).collect()]
    assert sorted(got, key=str) == brute(rows, 3)


def test_word_times(spark):
    df = spark.createDataFrame([("b a b",), ("",), (None,), ("x",)], "t string")
    got = [[tuple(e) for e in r[0]] for r in df.select(kw.sorted_words(F.col("t")).alias("w")).select(kw.word_times("w")).collect()]
    assert got == [[("a", 1, 3), ("b", 2, 3)], [], [], [("x", 1, 1)]]


def test_shared_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "alpha alpha beta"), (1, "gamma delta"), (None, "alpha")], "id long, body string")
    got = kw.keywords(df, "id", "body", 1).collect()
    assert sorted((str(r["id"]), r["term"]) for r in got) == [("1", "beta" if math.log(4 / 2) / 3 > 2 * math.log(4 / 3) / 3 else "alpha"), ("1", "delta"), ("None", "alpha")]
    assert kw.keywords(df.limit(0), "id", "body").count() == 0
