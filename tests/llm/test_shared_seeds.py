import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabloom.llm import shared_seeds
from tabloom.llm.chaining import LEVELS, repeats
from tabloom.llm.common import texts_of
from tabloom.llm.shared_seeds import Chunk, chunks, linked, links, order_of, packed, unpacked
from tabloom.llm.words import Words, minimizers, window_hashes

from .test_chaining import covered, fresh


def repetitive(seed, n=60):
    """Texts of few words, copies, repeats inside a text, and short texts."""
    rng = random.Random(seed)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.choice([0, 3, 4, 7, 8, 9, 12, 45, 90]))) for _ in range(n)]
    passage = " ".join(fresh(rng, 60))
    return [*texts, passage, "x y " * 40, f"{passage} and {passage}", texts[5], "same " * 70, passage]


def brute_links(texts):
    at = {}
    for num, text in enumerate(texts):
        own = Words([text]).hashes
        for k, window in LEVELS:
            h = window_hashes(own, k)
            for i in minimizers(h, window).tolist():
                at.setdefault(int(h[i]), []).append((num, i, k))
    out = set()
    for places in at.values():
        places.sort()
        for i in range(1, len(places)):
            for first in (places[0], places[i - 1]):
                out.add((*places[i][:2], *first[:2], places[i][2]))
    return out


@pytest.mark.parametrize("size", [40, 700, 1 << 20])
def test_links_equal_brute_force_over_chunks(make, monkeypatch, size):
    monkeypatch.setattr(shared_seeds, "CHUNK", size)
    texts = repetitive(size)
    docs = make(list(enumerate(texts)), 1).sortWithinPartitions("doc_id")
    one_each = docs.repartitionByRange(len(texts), "doc_id").sortWithinPartitions("doc_id") if size == 40 else docs
    table = chunks(texts_of(one_each))
    rows = sorted(table.collect(), key=lambda r: r.base)
    assert len(rows) > (20 if size == 40 else 0)
    number = {r.base + i: doc_id for r in rows for i, doc_id in enumerate(r.ids)}
    answers, got = linked(table, LEVELS).collect(), []
    for r in rows:
        own = [a for a in answers if a.base == r.base]
        found = links(Chunk(r.base, r.words), pa.table({c: [a[c] for a in own] for c in ("kind", "part", "payload")}), LEVELS)
        got += [(number[r.base + d], a, number[b + e], f, k) for d, a, b, e, f, k in zip(*[x.tolist() for x in found])]
    assert len(got) == len(set(got)) and set(got) == brute_links(texts)


def test_a_hot_seed_costs_one_entry_a_chunk(make):
    """What is stored and shuffled for the seeds stays below the text, however often one occurs."""
    rng = random.Random(3)
    line = " ".join(fresh(rng, 12))
    texts = [f"{line} {' '.join(fresh(rng, 4))} " * 20 for _ in range(400)]
    table = chunks(texts_of(make(list(enumerate(texts)), 2)))
    size = linked(table, LEVELS).agg(F.sum(F.octet_length("payload"))).first()[0] + table.agg(F.sum(F.octet_length("words"))).first()[0]
    assert size < 0.25 * sum(map(len, texts))


def test_passages_over_chunks(make, monkeypatch):
    rng = random.Random(5)
    docs, passage = [], fresh(rng, 70)
    for i in range(24):
        own = fresh(rng, 120)
        if i % 2 == 0:
            own[40:40] = passage
        docs.append((i, " ".join(own)))
    whole = {tuple(r) for r in repeats(make(docs, 1)).collect()}
    monkeypatch.setattr(shared_seeds, "CHUNK", 10)
    rows = repeats(make(docs, 1)).collect()
    assert {tuple(r) for r in rows} == whole
    assert set(covered(rows)) == set(range(0, 24, 2))


def test_packed_arrays_come_back():
    rng = np.random.default_rng(1)
    arrays = [np.zeros(0, dtype=np.int64), rng.integers(0, 1 << 62, 1000).astype(np.uint64), np.arange(-5, 5, dtype=np.int32), np.array([True, False]).astype(np.uint8)]
    assert all(a.dtype == b.dtype and (a == b).all() for a, b in zip(arrays, unpacked(packed(*arrays)), strict=True))
    keys = rng.integers(0, 5, 300), rng.integers(-(1 << 62), 1 << 62, 300)
    assert all((k[order_of(*keys)] == k[np.lexsort(keys[::-1])]).all() for k in keys)
