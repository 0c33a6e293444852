import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tabloom.llm import shingle_join
from tabloom.llm.components import connected
from tabloom.llm.queries import op2_lsh_forest
from tabloom.llm.shingle_join import join_classes, shortest_prefix

from .conftest import ODD, corpus


def shingle_set(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(docs):
    """Classes as sets of ids, by all pairs of different texts."""
    texts = defaultdict(list)
    for doc_id, text in docs:
        texts[text].append(doc_id)
    sets = {t: shingle_set(t) for t in texts}
    by_shingle, parent = defaultdict(list), {t: t for t in texts}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for t, s in sets.items():
        near = {u for x in s for u in by_shingle[x]}
        for u in near:
            both = len(s & sets[u])
            if both / (len(s) + len(sets[u]) - both) >= 0.8:
                parent[find(t)] = find(u)
        for x in s:
            by_shingle[x].append(t)
    classes = defaultdict(list)
    for t, ids in texts.items():
        if sets[t]:
            classes[find(t)] += ids
    return sorted(sorted(c) for c in classes.values())


def grouped(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.class_id].append(r.doc_id)
    assert all(k == min(v) for k, v in out.items())
    return sorted(sorted(v) for v in out.values())


def test_documents_against_all_pairs(spark, sf):
    assert grouped(op2_lsh_forest(spark, sf).collect()) == brute(list(corpus(spark, sf).items()))


@pytest.mark.parametrize("parts", [1, 7])
def test_chains_and_large_groups(make, parts):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    docs = [(i, " ".join(base)) for i in range(60)]
    for i in range(60, 160):  # near copies of one text
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        docs.append((i, " ".join(w)))
    w = [f"c{i}" for i in range(100)]
    for i in range(200, 215):  # each is like its neighbours only
        w[(i * 7) % 100] = f"y{i}"
        docs.append((i, " ".join(w)))
    docs += [(300 + i, " ".join(rng.choice("abcdefghij") for _ in range(60))) for i in range(40)]
    rows = join_classes(make(docs, parts, class_id=F.lit("clash"))).collect()
    assert grouped(rows) == brute(docs)
    assert all(r.n_copies == 59 and r.n_links > 0 for r in rows if r.doc_id < 60)
    assert all(r.n_links > 0 for r in rows if r.doc_id < 215)


@pytest.mark.parametrize(("parts", "block"), [(1, 256), (6, 256), (6, 16)])
def test_every_pair_of_a_template_family_is_counted(make, monkeypatch, parts, block):
    monkeypatch.setattr(shingle_join, "BLOCK", block)
    rng = random.Random(5)
    frame = [f"t{i}" for i in range(90)]
    docs = []
    for i in range(40):  # siblings at about 0.7, each with two copies at about 0.9
        own = frame + [f"s{i}x{k}" for k in range(16)]
        for j in range(3):
            w = list(own)
            if j:
                w[rng.randrange(3)] = f"y{i}x{j}"
            docs.append((len(docs), " ".join(w)))
    w = [f"c{i}" for i in range(100)]
    docs += [(1000 + i, " ".join([*w[:50], f"z{i}", *w[51:]])) for i in range(60)]
    rows = join_classes(make(docs, parts)).collect()
    sets = {i: shingle_set(t) for i, t in docs}
    want = {i: sum(len(s & o) / len(s | o) >= 0.8 for j, o in sets.items() if j != i) for i, s in sets.items()}
    assert {r.doc_id: r.n_links for r in rows} == want and min(want.values()) >= 2
    assert grouped(rows) == brute(docs)


def test_odd_rows(make):
    rows = join_classes(make([*ODD, (9, "repeat me!"), (10, None)])).collect()
    got = sorted((r.doc_id or 0, r.class_id or 0, r.n_links, r.n_copies) for r in rows)
    lone = [(i, i, 0, 0) for i in (0, 1, 2, 3, 4, 6, 7, 8, 10)]
    assert got == sorted([*lone, (5, 5, 1, 1), (5, 5, 1, 1), (9, 5, 1, 0)])


def test_empty_table(make):
    assert join_classes(make([])).count() == 0


def test_prefix_is_shortened_until_the_recall():
    assert shortest_prefix(0.8, 16, 8, 0.999) == 4
    assert shortest_prefix(1.0, 16, 8, 0.999) == 8


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.root for r in connected(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
