import zlib

import pytest
from pyspark.sql import functions as F

from tabloom.llm import toxicity
from tabloom.llm.queries import QUERIES
from tabloom.llm.toxicity import Lexicon, Matcher, fold_term, folded, learn, score_texts

from .conftest import ODD


def fold(text):
    return "".join(folded(text))


def test_folding():
    assert fold("You 1d10t, ＩＤＩＯＴ! іdіоt í​diót") == " you idiot idiot idiot idiot "
    assert fold("tr@sh $tupid m0r0n!!! 2010 a|b x") == " trash stupid moron 2010 a b x "
    assert fold("LOSER l0ser") == " ioser ioser " and fold("") == fold(None) == "" and fold("!?") == " "
    assert fold("漢字 123 ñandú") == " 漢字 123 nandu "


def test_long_texts_are_folded_in_parts(monkeypatch):
    text = "some w0rds, and a tr@sh can " * 50
    whole = fold(text)
    monkeypatch.setattr(toxicity, "STEP", 37)
    assert "".join(folded(text)).split() == whole.split()
    assert Matcher(Lexicon({" trash ": 1.0})).count(text) == ({0: 50}, 50 * 6)


def brute(lexicon, text):
    """Word by word: hits that no exception covers."""
    words = "".join(folded(text)).split()
    line = "".join(" " + w for w in words) + " "
    excused = set()
    for phrase in lexicon.exceptions:
        at = line.find(phrase)
        while at >= 0:
            excused.update(range(at, at + len(phrase)))
            at = line.find(phrase, at + 1)
    hits, at = 0, 0
    for w in words:
        for term in lexicon.terms:
            if f" {w} ".startswith(term) and not set(range(at, at + len(term))) <= excused:
                hits += 1
        at += len(w) + 1
    return hits


def test_hits_equal_brute_force(make):
    lexicon = Lexicon({fold_term("trash"): 2.0, fold_term("idio", whole=False): 3.0, fold_term("scum"): 1.0}, (fold_term("trash can"), fold_term("the idiot box")), (-3.0, 1.0, 0.0, 0.2))
    texts = ["trash", "trash can", "a TRASH can and trash", "idiotic idiots watch the idiot box", "scumbag scum", "the idi0t box tr@sh cans", "trash trash can trash"]
    got = {r.doc_id: r for r in score_texts(make(list(enumerate(texts))), lexicon).collect()}
    assert [got[i].n_hits for i in range(len(texts))] == [brute(lexicon, t) for t in texts] == [1, 0, 1, 2, 1, 1, 2]
    assert got[0].score > got[2].score > got[1].score and got[3].terms == ["idio"]


def test_held_out_documents(spark, sf):
    """Learnt on two thirds of the labels, judged on the rest."""
    where = sf.replace("0.001", "0.1")
    rows = QUERIES["op11_weighted_lexicon"](spark, where).collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{where}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    judged = [(truth[r.doc_id], r.predicted, r.score) for r in rows if r.held_out and r.doc_id in truth]
    toxic, clean = [p for t, p, _ in judged if t], [p for t, p, _ in judged if not t]
    assert len(toxic) > 100 and sum(toxic) / len(toxic) > 0.85 and sum(clean) / len(clean) < 0.01
    scores = sorted((s, t) for t, _, s in judged)
    below = won = 0
    for _, t in scores:
        won, below = (won + below, below) if t else (won, below + 1)
    assert won / (len(toxic) * len(clean)) > 0.93


def test_labels_of_held_out_rows_are_not_read(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    from tabloom.llm.queries import training_labels

    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert learn(docs, training_labels(labels), least=2.0) == learn(docs, training_labels(turned), least=2.0)


def test_learnt_exceptions(make, spark):
    toxic = [(i, f"word{i} you are trash today") for i in range(40)]
    clean = [(100 + i, f"word{i} you put it in the trash can today") for i in range(60)] + [(200 + i, f"you are here today number{i}") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in toxic + clean], "doc_id long, toxic int")
    lexicon = learn(make(toxic + clean), labels)
    assert " trash can " in lexicon.exceptions
    got = {r.doc_id: r.score for r in score_texts(make([(1, "some trash here"), (2, "one trash can here")]), lexicon).collect()}
    assert got[1] > 0.7 > got[2]


def test_odd_rows_and_empty_tables(make, spark):
    labels = spark.createDataFrame([(4, 1), (7, 0), (None, 1), (8, None)], "doc_id long, toxic int")
    rows = score_texts(make(ODD, score=F.lit("clash"), n_words=F.lit(1)), learn(make(ODD), labels)).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    nothing = learn(make(ODD), labels.limit(0))
    assert nothing == Lexicon() and {r.score for r in score_texts(make(ODD), nothing).collect()} == {0.5}
    assert score_texts(make([]), nothing).count() == 0 and learn(make([]), labels) == Lexicon()


@pytest.mark.parametrize(("k1", "n1", "k0", "n0"), [(0, 5, 0, 5), (5, 5, 0, 5), (3, 10, 3, 10), (0, 0, 3, 4)])
def test_telling_at_the_borders(k1, n1, k0, n0):
    value = toxicity.telling(k1, n1, k0, n0)
    assert value > 3 if (k1, k0) == (5, 0) else value == 0
