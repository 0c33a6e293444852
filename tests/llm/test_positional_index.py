import random
import re

from pyspark.sql import functions as F

from tabloom.llm.common import texts_of
from tabloom.llm.positional_index import build_index, contamination, find_windows, item_windows

from .conftest import ODD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, size):
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, names = set(), set()
        for item_id, item in items:
            t = words(item)
            for k in range(max(len(t) - size, 0) + 1 if t else 0):
                win = t[k : k + size]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        names.add(str(item_id))
        out.append((doc_id or 0, len(w), len(hit), sorted(names)))
    return sorted(out)


def rows(df):
    return sorted((r.doc_id or 0, r.n_words, r.n_hit, r.item_ids) for r in df.collect())


def items_table(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit("clash"))


def test_random_texts(spark, make):
    rng = random.Random(2)
    line = lambda n: " ".join(rng.choice(["a", "B", "c,", "é", "dd"]) for _ in range(n))
    docs = [(i, line(rng.randrange(0, 60))) for i in range(80)] + [(90, "a"), (90, "a")]
    items = [(i, line(rng.randrange(0, 9))) for i in range(25)] + [(3, "dd dd"), (30, None)]
    assert rows(contamination(make(docs), items_table(spark, items), size=4)) == brute(docs, items, 4)


def test_odd_rows(spark, make):
    items = [(1, "repeat me"), (2, ""), (3, None), (4, "word " * 12), (5, "absent words only")]
    assert rows(contamination(make(ODD, n_words=F.lit(1)), items_table(spark, items), size=10)) == brute(ODD, items, 10)


def test_empty_tables(spark, make):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert rows(contamination(make([(1, "a b c")]), none)) == [(1, 3, 0, [])]
    assert contamination(make([]), items_table(spark, [(1, "a")])).count() == 0


def test_segments_and_buckets_change_nothing(spark, make):
    docs = [(i, f"lead{i} the common phrase of all documents ends here tail{i}") for i in range(30)]
    items = texts_of(spark.createDataFrame([(7, "the common phrase of all documents")], "doc_id bigint, text string"))
    cut = item_windows(items, 3)
    index = build_index(texts_of(make(docs)), 5, segment_words=40)
    assert index.filter("term IS NULL").count() > 5
    found = find_windows(index, cut, 5, per_bucket=1)
    assert found.count() == 30 * 4 and {r.start for r in found.collect()} == {1, 2, 3, 4}


def test_proximity(spark, make):
    docs = [(1, "x alpha beta gamma"), (2, "x alpha so beta gamma"), (3, "alpha one two three beta gamma")]
    index = build_index(texts_of(make(docs, parts=1)), 6)
    cut = item_windows(texts_of(spark.createDataFrame([(1, "alpha beta gamma")], "doc_id bigint, text string")), 3)
    near = sorted((r.doc, r.exact) for r in find_windows(index, cut, 6, slop=1).collect())
    assert [x for x in near if x[1]] == [(near[0][0], True)] and len(near) == 2
