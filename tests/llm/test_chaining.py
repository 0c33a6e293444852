import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import chaining
from tabloom.llm.chaining import align, between, chain, passages, repeats, runs
from tabloom.llm.queries import op6_collinear_chains
from tabloom.llm.spans import merged, without_spans

from .conftest import ODD, corpus


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def fresh(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]


def covered(rows):
    """Words of each document in a passage, on both sides."""
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, set()).update(range(r.start, r.end))
        out.setdefault(r.first_id, set()).update(range(r.first_start, r.first_end))
    return out


def brute_exact(docs, size=50):
    """For each document the words in windows that occur more than once, at places that do not overlap."""
    seen = {}
    for doc_id, text in docs:
        w = words(text)
        for i in range(len(w) - size + 1):
            seen.setdefault(tuple(w[i : i + size]), []).append((doc_id, i))
    out = {}
    for places in seen.values():
        if len({d for d, _ in places}) > 1:
            for d, i in places:
                out.setdefault(d, set()).update(range(i, i + size))
    return out


def test_every_exact_repeat_of_the_documents_is_found(spark, sf):
    docs = sorted(corpus(spark, sf).items())
    found = {}
    for r in op6_collinear_chains(spark, sf).collect():
        found.setdefault(r.doc_id, set()).update(range(r.start_word, r.start_word + r.n_words))
        found.setdefault(r.first_doc_id, set()).update(range(r.first_start_word, r.first_start_word + r.first_n_words))
        assert r.n_words >= 50 and r.matches >= 0.8 * r.n_words
    want = brute_exact(docs)
    assert want
    for doc_id, places in want.items():
        assert places <= found.get(doc_id, set()), doc_id


@pytest.mark.parametrize("parts", [1, 5])
def test_planted_passages(make, parts):
    rng = random.Random(8)
    docs, passage = [], fresh(rng, 70)
    for i in range(30):
        own = fresh(rng, 120)
        if i < 20:
            copy = list(passage)
            if i % 2:  # fuzzy: replaced, dropped and added words
                copy[11], copy[45] = "changed", "changed too"
                del copy[30]
                copy.insert(60, "added")
            own[40:40] = copy
        docs.append((i, " ".join(own)))
    short = fresh(rng, 40)
    docs += [(50 + i, " ".join(fresh(rng, 60) + short + fresh(rng, 60))) for i in range(4)]
    docs.append((60, " ".join((own := fresh(rng, 60)) + fresh(rng, 10) + own)))
    rows = repeats(make(docs, parts, start=F.lit("clash"), num=F.lit(1))).collect()
    got = covered(rows)
    assert set(got) == {*range(20), 60}
    for i in range(20):
        assert len(got[i] & set(range(40, 110))) >= 66 and len(got[i] - set(range(38, 114))) == 0
    assert len({r.doc_id for r in rows}) == 20  # all but the first one, and the repeat inside one document


@pytest.mark.parametrize("between_them", [False, True])
def test_passage_whose_pieces_stand_in_other_documents(make, between_them):
    rng = random.Random(0)
    passage = fresh(rng, 80)
    pieces = lambda: [" ".join(fresh(rng, 40) + passage[i : i + 38] + fresh(rng, 40)) for i in range(0, 43, 6)]
    whole = lambda: " ".join(fresh(rng, 40) + passage + fresh(rng, 40))
    texts = [*pieces(), whole(), *(pieces() if between_them else []), whole()]
    rows = repeats(make(list(enumerate(texts)), 1).sortWithinPartitions("doc_id")).collect()
    last = len(texts) - 1
    assert {(r.doc_id, r.first_id) for r in rows} == {(last, 8)}
    assert covered(rows)[last] >= set(range(40, 120))


@pytest.mark.parametrize("every", [5, 6, 8, 10])
def test_passages_with_spread_errors(make, every):
    rng = random.Random(every)
    docs = []
    for i in range(0, 40, 2):
        passage = fresh(rng, 59)
        copy = [f"e{i}x{k}" if k % every == every - 1 else w for k, w in enumerate(passage)]
        docs += [(i, " ".join(fresh(rng, 40) + passage + fresh(rng, 40))), (i + 1, " ".join(fresh(rng, 40) + copy + fresh(rng, 40)))]
    got = covered(repeats(make(docs)).collect())
    assert all(len(got.get(i, set()) & set(range(40, 99))) >= 50 for i in range(40))


def test_odd_rows_and_empty_table(make):
    rows = repeats(make([*ODD, (11, "word " * 3000)])).collect()
    assert {r.doc_id for r in rows} <= {7, 11} and {r.doc_id for r in rows}
    assert repeats(make([])).count() == 0


def test_chains_follow_both_orders():
    # two collinear runs, one out of order, one far away
    segments = runs(np.array([0, 20, 40, 400]), np.array([100, 121, 10, 500]), 5, 60)
    lines = chain(segments, 0.1, 60)
    assert sorted(len(x) for x in lines) == [1, 1, 2] and {tuple(segments[i][[0, 2]]) for x in lines if len(x) == 2 for i in x} == {(0, 100), (20, 121)}


def brute_chain(segments, gap_cost):
    best = []
    for a, b, c, d in segments:
        gain = max([0.0, *(best[j] - gap_cost * ((a - segments[j][1]) + (c - segments[j][3])) for j in range(len(best)) if segments[j][1] <= a and segments[j][3] <= c)])
        best.append(b - a + gain)
    return max(best)


def test_best_chain_equals_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(100):
        at = np.sort(rng.integers(0, 120, 12))
        segments = runs(at, rng.integers(0, 120, 12), 5, 10)
        lines = chain(segments, 0.2, 10**6)
        line = [segments[i] for i in lines[0]]
        score = sum(s[1] - s[0] for s in line) - 0.2 * sum((y[0] - x[1]) + (y[2] - x[3]) for x, y in zip(line, line[1:]))
        assert abs(score - brute_chain(segments, 0.2)) < 1e-9


def test_alignments():
    assert between(np.array([1, 2, 3]), np.array([1, 3])).tolist() == [[1, 1, 1], [1, 0, 0], [1, 1, 1]]
    x = np.arange(100)
    y = np.concatenate([np.arange(900, 910), x[:40], [777], x[40:]])
    columns = align(x, y, np.array([[5, 30, 15, 40], [60, 80, 71, 91]]))
    assert columns[:, 0].sum() == 100 and columns[:, 1].sum() == 111
    assert passages(columns, 50, 0.8) == [(0, 100, 10, 111, 100)]


@pytest.mark.parametrize(("size", "gap", "blocks"), [(50, 24, 3), (50, 13, 12), (60, 20, 2)])
def test_exact_passages_between_different_words(size, gap, blocks):
    equal, other = np.ones((size, 3), dtype=np.int64), np.tile([1, 1, 0], (gap, 1))
    columns = np.concatenate([x for i in range(blocks) for x in ([other] * (i > 0) + [equal])])
    found = passages(columns, 50, 0.8)
    inside = {w for a, b, *_ in found for w in range(a, b)}
    assert inside >= {w for i in range(blocks) for w in range(i * (size + gap), i * (size + gap) + size)}
    assert all(m >= 0.8 * (b - a) and b - a >= 50 for a, b, _, _, m in found)


def test_cut_out(make, spark):
    docs = make([(1, "One, two; three. Four five!"), (2, None), (3, "é ü, ö end")])
    rows = docs.withColumn("key", F.unhex(F.md5(F.concat_ws("\u0001", F.col("doc_id").cast("string"), F.col("text").isNull().cast("string"), F.coalesce("text", F.lit(""))))))
    spans = rows.filter("doc_id <> 2").select("key", F.lit(1).alias("start"), F.lit(3).alias("end"))
    assert {r.doc_id: (r.text, r.n_chars) for r in without_spans(docs, spans).collect()} == {1: ("One, Four five!", 15), 2: (None, None), 3: ("é end", 5)}
    table = spark.createDataFrame([(1, 0, 5, "a"), (1, 3, 9, "b"), (1, 20, 30, "c"), (2, 1, 2, "d")], "id int, start int, end int, what string")
    assert sorted(map(tuple, merged(table, "id").collect())) == [(1, 0, 9, "b"), (1, 20, 30, "c"), (2, 1, 2, "d")]


def test_minimum_is_over_fifty_words():
    assert chaining.MIN_WORDS == 50
