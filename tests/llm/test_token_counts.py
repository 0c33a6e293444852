from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabloom.llm.queries import op1_token_counts
from tabloom.llm.token_counts import count_tokens, length_table, shrink

from .conftest import ODD, corpus

PATH = public_tokenizers.path("byte_bpe_50k.json")


def want(text):
    return len((text or "").encode()), len(Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids)


def test_all_documents_equal_the_library(spark, sf):
    own = Tokenizer.from_file(PATH)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op1_token_counts(spark, sf).collect()}
    for doc_id, text in corpus(spark, sf).items():
        n = len(own.encode(text, add_special_tokens=False).ids)
        assert got.pop(doc_id) == (len(text.encode()), n, n > 1024)
    assert not got


def test_odd_rows(make):
    for size in (1, 4, 1 << 10):
        got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in count_tokens(make(ODD, n_tokens=F.lit("clash")), PATH, size).collect())
        assert got == sorted((i or 0, *want(t)) for i, t in ODD)


def test_empty_table(make):
    assert count_tokens(make([]), PATH).count() == 0


def test_table_holds_frequent_pieces_only(make):
    keys, lens = length_table(make([(i, "alpha beta gamma " * 50 + f"rare{i}") for i in range(6)]), PATH, 8)
    assert 3 <= len(keys) <= 8 and (lens > 0).all()


def test_shrink_keeps_the_heavy_ones():
    assert shrink(Counter(a=9, b=5, c=1, d=1), 2) == Counter(a=8, b=4)
