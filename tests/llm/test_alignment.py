import hashlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tabloom.llm import alignment
from tabloom.llm.queries import BPE, PIECES, QUERIES

from .conftest import ODD, corpus


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(BPE)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def brute(libraries, texts):
    """Token by token and document by document."""
    first, second = libraries
    decode = {chr(c): b for b, c in alignment._byte_chars().items()}
    found = []
    for text in texts:
        groups = []
        if text:
            a, b = first.encode(" " + text, add_special_tokens=False), second.encode(text)
            a_bytes = [bytes(decode[c] for c in t) for t in a.tokens]
            b_bytes = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, second.id_to_piece(i)) for i in b)]
            a_ids = a.ids
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                i = j = end_a = end_b = 0
                left, right = [], []
                while i < len(a_ids) or j < len(b):
                    if end_a <= end_b and i < len(a_ids):
                        left.append(a_ids[i])
                        end_a += len(a_bytes[i])
                        i += 1
                    else:
                        right.append(b[j])
                        end_b += len(b_bytes[j])
                        j += 1
                    if end_a == end_b:
                        groups.append((left, right))
                        left, right = [], []
        found.append(groups)
    links = [Counter(p for a, b in g for p in product(a, b)) for g in found]
    counts = Counter(p for k in links for p in k)
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for g, k in zip(found, links, strict=True):
        spelled = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((
            sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(k.values()), sum(n for p, n in k.items() if counts[p] == most[p[0]]),
            sum(counts[p] * n for p, n in k.items()), hashlib.sha256(spelled.encode()).hexdigest() if g else "",
        ))
    return out


def rows_of(df):
    return sorted(((r.doc_id is None, r.doc_id or 0), (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in df.collect())


def expected(libraries, rows):
    return sorted(((i is None, i or 0), x) for (i, _), x in zip(rows, brute(libraries, [t for _, t in rows]), strict=True))


def test_query_equals_brute_force(spark, sf, libraries):
    docs = sorted(corpus(spark, sf).items())
    assert rows_of(QUERIES["op13_fragment_alignment"](spark, sf)) == expected(libraries, docs)


LONG = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from here. " * 40), (2, "漢字かな交じり文" * 90), (3, "x" * 3000), (4, "a b" + " " * 700 + "c d"), (5, "no block ▁ spells this " * 60),
    (6, "short"), (7, "don't <|endoftext|> stop <s> now, 1234567 ñandú\n" * 50), (8, None), (9, ""), (10, "The quick brown fox jumps over the lazy dog and runs away from here. " * 40),
]


@pytest.mark.parametrize(("block", "width"), [(64, 16), (200, 7), (1000, 333)])
def test_long_documents_composed_over_tasks(make, libraries, block, width):
    got = alignment.align(make(LONG), BPE, PIECES, block=block, width=width)
    assert rows_of(got) == expected(libraries, LONG)


def test_rare_pairs_are_joined(make, libraries):
    assert rows_of(alignment.align(make(LONG), BPE, PIECES, table_size=8)) == expected(libraries, LONG)
    assert rows_of(alignment.align(make(LONG), BPE, PIECES, table_size=0)) == expected(libraries, LONG)


def test_odd_rows_and_empty_tables(make, libraries):
    got = alignment.align(make(ODD, n_a=F.lit("clash"), row=F.lit("clash"), pairs=F.lit(1)), BPE, PIECES, block=500, width=100)
    assert rows_of(got) == expected(libraries, ODD)
    assert alignment.align(make([]), BPE, PIECES).count() == 0
    assert rows_of(alignment.align(make([(1, None)]), BPE, PIECES)) == expected(libraries, [(1, None)])


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_composition_is_associative(data):
    """However a row of ranges is put together, the same groups close in the same places."""
    total = data.draw(st.integers(1, 40))
    ends = [np.unique([*data.draw(st.lists(st.integers(1, total), max_size=20)), total]) for _ in range(2)]
    ids = [np.arange(len(e)) for e in ends]
    width = data.draw(st.integers(1, 15))
    items = []
    for k in range((total - 1) // width + 1):
        part = [slice(*np.searchsorted(e, [k * width + 1, (k + 1) * width + 1])) for e in ends]
        fragment, closed = alignment.range_fragment(k, ids[0][part[0]], ends[0][part[0]], ids[1][part[1]], ends[1][part[1]])
        items.append((fragment, {(fragment.cut, 1): closed} if len(closed.n_a) else {}))
    while len(items) > 1:
        i = data.draw(st.integers(0, len(items) - 2))
        (left, a), (right, b) = items[i], items[i + 1]
        both, closed = left + right
        items[i : i + 2] = [(both, a | b | ({(right.cut, 0): closed} if closed is not None else {}))]
    last, texts = items[0]
    texts[last.cut, 0] = alignment.one_group(last.prefix)
    got = b"".join(texts[k].spelled()[0].tobytes() for k in sorted(texts))
    whole, common = alignment.cut_groups(ids[0], ends[0], ids[1], ends[1])
    assert got == whole.spelled()[0].tobytes() and len(last.suffix[0]) == len(last.suffix[1]) == 0


def test_wide_groups_count_every_link():
    rng = np.random.default_rng(5)
    groups = alignment.Groups(rng.integers(0, 9, 300), rng.integers(0, 7, 220), np.array([290, 10]), np.array([215, 5]))
    _, keys, times = groups.pairs(np.zeros(2, dtype=np.int64))
    want = Counter(int(a) << alignment.LOW | int(b) for x, y in ((slice(0, 290), slice(0, 215)), (slice(290, 300), slice(215, 220))) for a in groups.a[x] for b in groups.b[y])
    assert dict(zip(keys.tolist(), times.tolist(), strict=True)) == want
