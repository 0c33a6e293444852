import pytest
from pyspark.sql import functions as F

from tabloom.llm.licences import ISC, MIT, canonical, known_licences, scan

from .conftest import ODD


@pytest.fixture(scope="module")
def known(spark):
    return known_licences(spark)


def found(make, known, docs, **more):
    return {r.doc_id: (r.licence, r.notices) for r in scan(make(docs, **more), known).collect()}


def test_equivalent_texts_have_one_digest(make, known):
    docs = [
        (1, MIT), (2, "Copyright (c) 2021 Someone\nAll rights reserved.\n\n" + MIT.upper()), (3, MIT.replace(",", "").replace('"', "“")), (4, "© 2019 A. Body\n" + ISC.replace("\n", "  \r\n")),
        (5, MIT + "\nand one sentence more"), (6, MIT.replace("sublicense", "sub-license")), (7, MIT.replace("merge, ", "")),
    ]
    got = found(make, known, docs)
    assert [got[i][0] for i in range(1, 8)] == ["MIT", "MIT", "MIT", "ISC", None, "MIT", None]


def test_notices_inside_documents(make, known):
    docs = [(1, "Some words.\nReleased under the MIT Licence!\nMore words."), (2, "licensed under CC-BY-NC 4.0\nRELEASED UNDER THE MIT LICENSE"), (3, "Not released under the MIT License.")]
    assert found(make, known, docs) == {1: (None, ["MIT"]), 2: (None, ["CC-BY-NC-4.0", "MIT"]), 3: (None, [])}


def test_odd_rows_and_empty_tables(make, known, spark):
    rows = scan(make(ODD, licence=F.lit("clash"), digest=F.lit("clash")), known).collect()
    assert len(rows) == len(ODD) and all(r.licence is None and r.notices == [] for r in rows)
    assert len({r.digest for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert scan(make([]), known).count() == 0
    assert scan(make([(1, MIT)]), spark.createDataFrame([], known.schema)).first().licence is None


def test_canonical_form(spark):
    row = spark.sql("SELECT '  The LICENCE,  version 2.0 -- Non-Commercial\n(C) 2020 me' AS t").select(canonical(F.col("t")).alias("c")).first()
    assert row.c == "the license v2 noncommercial"
