import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import pseudo_lm
from tabloom.llm.pseudo_lm import CLASSES, GROUPS, SHAPES, class_table, forward, gradients, initial, pseudo_likelihood, score, train, vocabulary, windows
from tabloom.llm.queries import op9_masked_likelihood

from .conftest import ODD, corpus
from .test_chaining import words


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in initial(rng.integers(0, 50, CLASSES).astype(float)).items()}
    near, own = rng.integers(0, 9, (7, 4)), rng.integers(0, CLASSES, 7)
    g = gradients(p, near, own)
    for k in SHAPES:
        at = tuple(np.argwhere(np.abs(g[k]) == np.abs(g[k]).max())[0])
        sides = []
        for step in (1e-5, -1e-5):
            q = {**p, k: p[k].copy()}
            q[k][at] += step
            sides.append(forward(q, near, own).mean())
        assert np.isclose((sides[0] - sides[1]) / 2e-5, g[k][at], rtol=1e-3), k


def test_probabilities_add_up_to_one():
    p = initial(np.ones(CLASSES))
    near = np.tile([[1, 2, 3, 4]], (CLASSES, 1))
    assert np.isclose(np.exp(forward(p, near, np.arange(CLASSES))).sum(), 1, atol=1e-4)


def test_tables_of_a_step_stay_small():
    rng = np.random.default_rng(3)
    p = initial(rng.integers(0, 50, CLASSES).astype(float))
    near, own = rng.integers(0, CLASSES, (1 << 16, 4)), rng.integers(0, CLASSES, 1 << 16)
    for work, limit in ((forward, 8 << 20), (gradients, 48 << 20)):
        tracemalloc.start()
        work(p, near, own)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < limit, work.__name__


@pytest.mark.parametrize("far", [1.0, 1e4])
def test_step_over_many_rows_equals_row_by_row(far):
    rng = np.random.default_rng(4)
    p = {k: v.astype(np.float64) for k, v in initial(rng.integers(0, 50, CLASSES).astype(float)).items()}
    p["group"] *= far
    p["inside"] *= far
    n = 2 * pseudo_lm.ROWS + 5
    near, own = rng.integers(0, CLASSES, (n, 4)), rng.integers(0, CLASSES, n)
    assert np.allclose(forward(p, near, own), [forward(p, near[i : i + 1], own[i : i + 1])[0] for i in range(n)])
    whole, parts = gradients(p, near, own), [gradients(p, near[i : i + 500], own[i : i + 500]) for i in range(0, n, 500)]
    shares = [len(own[i : i + 500]) / n for i in range(0, n, 500)]
    for k in SHAPES:
        assert np.allclose(whole[k], sum(s * g[k] for s, g in zip(shares, parts)), atol=1e-8), k


def text(rng, n):
    """Words in a fixed order of six kinds, each kind with four words."""
    return " ".join(f"k{i % 6}w{rng.randrange(4)}" for i in range(n))


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(i, text(rng, 120)) for i in range(400)], "doc_id bigint, text string").repartition(3)
    vocabulary_of = vocabulary(rows)
    table = class_table(rows, *vocabulary_of[:2])
    start = initial(vocabulary_of[2])
    return vocabulary_of, start, train(table, start, rounds=3)


def test_held_out_documents(spark, trained):
    vocabulary_of, start, p = trained
    rng = random.Random(2)
    docs = [(i, text(rng, 90)) for i in range(30)]
    mixed = [(100 + i, " ".join(rng.sample(t.split(), 90))) for i, t in docs]
    table = class_table(spark.createDataFrame(docs + mixed, "doc_id bigint, text string"), *vocabulary_of[:2])
    mean = lambda q, ids: np.mean([r.mean_log_likelihood for r in score(table, q).collect() if (r.doc_id >= 100) == ids])
    assert mean(p, False) > -2.0 and mean(start, False) < -3.0  # 4 words a place, against 24 words without order
    assert mean(p, False) > mean(p, True) + 1


def test_scores_equal_word_by_word(spark, make, trained):
    vocabulary_of, _, p = trained
    docs = [(1, "k0w1 k1w2 unknown k3w0"), (2, None), (3, "k5w1"), (4, ""), (4, "")]
    table = class_table(make(docs, 2, n_words=F.lit(9)).select("doc_id", "text"), *vocabulary_of[:2])
    rows = {r.doc_id: (r.n_words, r.log_likelihood, r.mean_log_likelihood) for r in score(table, p).collect()}
    assert rows[2] == (0, 0.0, None) and rows[4] == (0, 0.0, None)
    for r in table.filter("n_words > 0").collect():
        ids = [0, 0, *np.frombuffer(r.classes, dtype="<u2").tolist(), 0, 0]
        total = 0.0
        for i in range(2, len(ids) - 2):
            h = np.tanh(p["shift"] + sum(p["near"][j][ids[i + s]] for j, s in enumerate((-2, -1, 1, 2))))
            a = h @ p["group"] + p["group_bias"]
            g, k = divmod(ids[i], GROUPS)
            b = (h + p["given"][g]) @ p["inside"] + p["inside_bias"][g]
            total += a[g] - np.log(np.exp(a).sum()) + b[k] - np.log(np.exp(b).sum())
        assert np.isclose(rows[r.doc_id][1], total, rtol=1e-4)


def test_windows_do_not_cross_texts():
    near, own = windows([np.array([5, 6], dtype=np.uint16), np.zeros(0, dtype=np.uint16), np.array([7], dtype=np.uint16)])
    assert near.tolist() == [[0, 0, 6, 0], [0, 5, 0, 0], [0, 0, 0, 0]] and own.tolist() == [5, 6, 7]


def test_documents(spark, sf):
    docs = corpus(spark, sf)
    rows = op9_masked_likelihood(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.n_words == len(words(docs[r.doc_id])) and r.log_likelihood < 0 for r in rows)


def test_odd_rows_and_empty_table(make, monkeypatch):
    monkeypatch.setattr(pseudo_lm, "BATCH", 100)
    rows = pseudo_likelihood(make(ODD, word=F.lit("clash"), n=F.lit(1))).collect()
    assert len(rows) == len(ODD) and all((r.mean_log_likelihood is None) == (r.n_words == 0) for r in rows)
    assert pseudo_likelihood(make([])).count() == 0
