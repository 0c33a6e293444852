import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabloom.catalog.common import scratch
from tabloom.llm import token_files
from tabloom.llm.queries import op5_mixing_coder
from tabloom.llm.token_codec import checksum, decode_blocks, encode_blocks, joined_checksum

from .conftest import ODD, corpus

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(docs):
    own, at, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in docs:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def test_documents(spark, sf):
    assert sorted(map(tuple, op5_mixing_coder(spark, sf).collect())) == brute(sorted(corpus(spark, sf).items()))


def written(spark, docs):
    folder = scratch(spark, "token-test")
    token_files.write_tokens(docs, folder, PATH)
    return folder


def test_odd_rows_over_many_blocks(spark, make, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 16)
    monkeypatch.setattr(token_files, "SHORTEST", 4)
    monkeypatch.setattr(token_files, "LANES", 8)
    folder = written(spark, make(ODD, shard=F.lit("clash"), doc=F.lit(1)))
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.document_digests(spark, folder).collect()), key=lambda r: r[1])
    assert got == brute(sorted(ODD, key=lambda r: -1 if r[0] is None else r[0]))
    assert token_files.read_blocks(spark, folder).filter("n > 16").count() == 0


def test_empty_table(spark, make):
    assert token_files.document_digests(spark, written(spark, make([]))).count() == 0


def test_damage_is_found(spark, make):
    folder = written(spark, make([(1, "some words to be damaged")], parts=1))
    bad = folder + "-bad"
    token_files.read_blocks(spark, folder).withColumn("crc", F.col("crc") + 1).write.parquet(bad)
    with pytest.raises(Exception, match="checksum"):
        token_files.read_stretches(spark, bad).collect()


def test_round_trip_of_many_kinds_of_blocks():
    rng = np.random.default_rng(7)
    blocks = [rng.integers(0, 65535, n).astype(np.uint16) for n in (0, 1, 2, 63, 64, 65, 700)] + [np.zeros(900, dtype=np.uint16), np.tile(np.arange(50, dtype=np.uint16), 40), rng.zipf(1.3, 3000).clip(0, 65534).astype(np.uint16)]
    payloads = encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(blocks, decode_blocks(payloads, [len(b) for b in blocks]), strict=True))
    assert len(payloads[7]) < 120 and len(payloads[8]) < 700  # what repeats costs little
    alone = decode_blocks(payloads[6:7], [700])[0]
    assert (alone == blocks[6]).all()


def test_checksums_join():
    rng = random.Random(2)
    ids = np.array([rng.randrange(50_000) for _ in range(100)])
    assert joined_checksum(checksum(ids[:37]), checksum(ids[37:]), 63) == checksum(ids)
