import math
import random
import re

from pyspark.sql import functions as F

from tabloom.llm.quality import RULES, binomial_tail, features, judged, measure, thresholds

from .conftest import ODD

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(5)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)]


def test_counts_equal_brute_force(make):
    rng = random.Random(1)
    docs = [(i, "".join(rng.choice(["a", "b ", "c\n", " ", "#", "😀", "\x0b", "\r\n", "a b c d e "]) for _ in range(rng.randrange(90)))) for i in range(300)] + [r for r in ODD if r[0] != 7]
    got = sorted([r.doc_id or 0, *[r[c] for c in COLUMNS]] for r in features(make(docs, n_words=F.lit("clash"))).collect())
    assert got == sorted([i or 0, *brute(t)] for i, t in docs)


def test_long_repetitive_text(make):
    text = "one two three four five six " * 40_000
    row = features(make([(1, text)])).first()
    assert row.n_words == row.n_repeat_words == 240_000


def test_binomial_tail_is_exact(spark):
    rows = [(k, n) for n in (1, 7, 60, 900, 20_000) for k in sorted({0, 1, n // 200, n // 90}) if k <= n]
    df = spark.createDataFrame(rows, "k bigint, n bigint")
    for r in df.withColumn("p", binomial_tail(F.col("k"), F.col("n"), 0.02)).collect():
        want = sum(math.comb(r.n, i) * 0.02**i * 0.98 ** (r.n - i) for i in range(r.k + 1)) if r.n < 2000 else sum(
            math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.02) + (r.n - i) * math.log(0.98)) for i in range(r.k + 1))
        assert r.k > r.n * 0.02 or math.isclose(r.p, want, rel_tol=1e-8)


def corpus(make, spark, n=4000, noise=0):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30)]
        docs.append((i, " ".join(w + "$" if bad else w for w in words)))
        labels.append((i, int(not bad) if rng.random() >= noise else 1, 0))
    return make(docs), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_clean_documents_stay_and_junk_goes(make, spark):
    docs, labels = corpus(make, spark)
    measured = measure(docs)
    cutoffs = thresholds(measured, labels)
    assert [r.rule for r in cutoffs.collect()] == ["symbols"]
    assert all(r.kept == (r.doc_id % 5 > 0) for r in judged(measured, cutoffs).collect())


def test_no_cutoff_where_risk_is_not_bounded(make, spark):
    few, few_labels = corpus(make, spark, n=200)
    assert thresholds(measure(few), few_labels).count() == 0  # too few labels to prove anything
    mixed, mixed_labels = corpus(make, spark, noise=0.5)
    chosen = thresholds(measure(mixed), mixed_labels).collect()
    assert all(r.good_above / r.n_good < 0.04 / len(RULES) for r in chosen)


def test_odd_rows_and_empty_tables(make, spark):
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (4, 1, 1), (4, 0, 0)], "doc_id bigint, quality int, toxic int")
    measured = measure(make([r for r in ODD if r[0] != 7]).withColumn("lang", F.lit(None).cast("string")))
    rows = judged(measured, thresholds(measured, labels)).collect()
    assert len(rows) == 9 and all(r.base_failed == (r.n_words < 10) and not r.kept for r in rows)
    empty = measure(make([]))
    assert judged(empty, thresholds(empty, labels.limit(0))).count() == 0

