import random

import pytest
from pyspark.sql import functions as F

from tabloom.llm import sparse_suffix
from tabloom.llm.queries import op10_sparse_suffixes
from tabloom.llm.sparse_suffix import repeats

from .conftest import ODD, corpus
from .test_chaining import fresh, words


def brute(docs, size=50):
    """For each document the words in windows of `size` words that occur at more than one place."""
    seen = {}
    for doc_id, text in docs:
        w = words(text)
        for i in range(len(w) - size + 1):
            seen.setdefault(tuple(w[i : i + size]), []).append((doc_id, i))
    out = {}
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                out.setdefault(d, set()).update(range(i, i + size))
    return out


def covered(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    return out


def test_documents_equal_brute_force(spark, sf):
    got = {}
    for r in op10_sparse_suffixes(spark, sf).collect():
        assert r.n_words >= 50
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.start_word + r.n_words))
    assert got == brute(sorted(corpus(spark, sf).items()))


@pytest.mark.parametrize("split", [12, 10_000])
def test_planted_passages(make, monkeypatch, split):
    monkeypatch.setattr(sparse_suffix, "SPLIT", split)
    rng = random.Random(9)
    docs = []
    for size in (49, 50, 51, 90, 400):
        passage = fresh(rng, size)
        for i in range(24 if size == 90 else 3):
            docs.append((len(docs), " ".join(fresh(rng, rng.randrange(3)) + passage + fresh(rng, rng.randrange(80)))))
    docs.append((200, " ".join((own := fresh(rng, 70)) + own)))
    got = covered(repeats(make(docs, 5, at=F.lit("clash"), num=F.lit(1))).collect())
    assert got == brute(docs)


def test_odd_rows_and_empty_table(make):
    rows = [*ODD, *[(12, " ".join(fresh(random.Random(1), 60)))] * 3]
    assert covered(repeats(make(rows)).collect()) == brute(rows)
    assert repeats(make([])).count() == 0


@pytest.mark.parametrize("split", [3, 10_000])
def test_fifty_words_around_a_footer(make, monkeypatch, split):
    """Forty documents end in one 49-word footer; pairs share the word before it, which makes 50 exact words."""
    monkeypatch.setattr(sparse_suffix, "SPLIT", split)
    rng = random.Random(5)
    footer = fresh(rng, 49)
    docs = [(i, " ".join(fresh(rng, 12) + ([f"pair{i // 2}"] if i < 12 else fresh(rng, 1)) + footer)) for i in range(40)]
    got = covered(repeats(make(docs, 5)).collect())
    assert got == brute(docs) and sorted(got) == list(range(12))


@pytest.mark.parametrize("split", [3, 10_000])
def test_repeats_whose_right_side_others_share(make, monkeypatch, split):
    monkeypatch.setattr(sparse_suffix, "SPLIT", split)
    rng = random.Random(6)
    docs = []
    for cut in range(2, 49, 4):  # A and C share 50 words, two other texts share A's right side and more
        left, right, more = fresh(rng, cut), fresh(rng, 50 - cut), fresh(rng, 30)
        for text in (left + right + more, left + right + fresh(rng, 30), fresh(rng, 20) + right + more, fresh(rng, 25) + right + more):
            docs.append((len(docs), " ".join(fresh(rng, 5) + text)))
    assert covered(repeats(make(docs, 5)).collect()) == brute(docs)


@pytest.mark.parametrize("split", [4, 10_000])
def test_few_different_words(make, monkeypatch, split):
    """Random texts over small alphabets repeat in all ways."""
    monkeypatch.setattr(sparse_suffix, "SPLIT", split)
    rng = random.Random(7)
    parts = [[rng.choice("abc") for _ in range(rng.randrange(20, 70))] for _ in range(12)]
    docs = [(i, " ".join(w for _ in range(rng.randrange(1, 7)) for w in rng.choice(parts))) for i in range(60)]
    got = covered(repeats(make(docs, 4)).collect())
    assert got == brute(docs)


def test_steps_end_where_blocks_end(make, monkeypatch):
    monkeypatch.setattr(sparse_suffix, "STEP", 16)
    rng = random.Random(8)
    shared = [fresh(rng, 80) for _ in range(9)]
    docs = [(i, " ".join(fresh(rng, 4) + rng.choice(shared) + fresh(rng, 4) + rng.choice(shared)[10:])) for i in range(40)]
    assert covered(repeats(make(docs, 3)).collect()) == brute(docs)
