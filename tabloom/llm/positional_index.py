"""Contamination by test items, from a distributed positional inverted index of the documents.

`build_index` stores the index: documents are gathered into segments of about `segment_words` words; a segment has one
row per term with the ascending places of the term in the segment, and one row with its documents. Places of two
documents are `gap` apart, so a phrase cannot reach from one to the next. `find_windows` looks up the items' windows:
a window is first looked for by its rarest term in the corpus (document-wide counts from the index), in the segments
that have the term; the lists of its other terms, shifted by their place in the window, are intersected from rare to
frequent. With `slop` > 0 each other term may stand up to that many words from its place: proximity matches.
Segments bound what a task holds; many windows are dealt over buckets. Terms are 64-bit fingerprints, so a phrase is
accepted on equal fingerprints of all its words.

Null, empty and wordless texts and items have no words and match nothing; equal windows of several items count for
each; an item shorter than a window is one window; repeated rows and ids give their own rows; null ids stay null
(a null item id is written as an empty string); empty tables give no hits; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tabloom.llm.common import stored, text_chunks, texts_of
from tabloom.llm.words import Words

INDEX = "segment bigint, term bigint, n bigint, places binary, doc_ids array<bigint>, doc_words array<bigint>"


def _segment(number: int, docs: list, counts: np.ndarray, hashes: np.ndarray, gap: int) -> pa.RecordBatch:
    """Rows of one segment: the documents first, then the terms."""
    shift = np.repeat(np.arange(len(counts)) * gap, counts)
    order = np.argsort(hashes, kind="stable")
    terms, first = np.unique(hashes[order], return_index=True)
    ends = np.append(first[1:], len(order))
    places = (np.arange(len(hashes)) + shift)[order].astype("<i4")
    offsets = np.concatenate([[0, 0], ends * 4]).astype(np.int32)
    rows = len(terms) + 1
    absent = [None] * len(terms)
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(rows, number)), pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(terms.view(np.int64))]), pa.array(np.append(0, ends - first)),
        pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(places)]),
        pa.array([docs, *absent], pa.list_(pa.int64())), pa.array([counts.tolist(), *absent], pa.list_(pa.int64())),
    ], names=["segment", "term", "n", "places", "doc_ids", "doc_words"])


def build_index(docs: DataFrame, gap: int, segment_words: int = 1 << 20) -> DataFrame:
    """The stored index. gap: at least the longest window plus the slop of later searches."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        docs, counts, hashes, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            return _segment(number, docs, np.concatenate(counts), np.concatenate(hashes), gap)

        for ids, texts in text_chunks(batches, min(segment_words, 1 << 19)):
            words = Words(texts)
            docs.extend(ids)
            counts.append(np.diff(words.bounds))
            hashes.append(words.hashes)
            size += len(words.hashes) + len(ids) * gap
            if size >= segment_words:
                yield flush()
                number += 1
                docs, counts, hashes, size = [], [], [], 0
        if docs:
            yield flush()

    return stored(texts_of(docs).mapInArrow(index, INDEX), "positional-index", compression="zstd")


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """(item_id, window, terms): the items' windows; `window` names equal windows alike."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_chunks(batches, 1 << 16):
            words = Words(texts)
            items, terms = [], []
            for i, (a, b) in enumerate(zip(words.bounds[:-1], words.bounds[1:], strict=True)):
                own = words.hashes[a:b].view(np.int64)
                for k in range(max(len(own) - size, 0) + 1 if len(own) else 0):
                    items.append(ids[i])
                    terms.append(own[k : k + size])
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(terms, pa.list_(pa.int64()))], names=["item_id", "terms"])

    cuts = items.mapInArrow(cut, "item_id bigint, terms array<bigint>").distinct()
    return stored(cuts.select("item_id", F.xxhash64("terms").alias("window"), "terms"), "item-windows")


def _near(places: np.ndarray, wanted: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Which wanted places have one of `places` within `slop`, and which have it exactly."""
    at = np.searchsorted(places, wanted)
    after = places[np.minimum(at, len(places) - 1)]
    exact = after == wanted
    if not slop:
        return exact, exact
    before = places[np.maximum(at - 1, 0)]
    return (np.abs(after - wanted) <= slop) | (np.abs(before - wanted) <= slop), exact


def search_segment(windows: pd.DataFrame, postings: pd.DataFrame, gap: int, slop: int) -> pd.DataFrame:
    """Matches of windows in one segment: document number, first word, words, window, exact. One of the rows of
    `postings` has the documents' numbers of words instead of places (no null is used: pandas would turn terms to floats)."""
    lists = {t: np.frombuffer(p, dtype="<i4") for t, p in zip(postings["term"], postings["places"], strict=True) if p is not None}
    counts = np.asarray(postings.loc[postings["places"].isna(), "doc_words"].iloc[0], dtype=np.int64)
    begins = np.cumsum(counts) - counts + np.arange(len(counts)) * gap
    found = []
    for window, terms, offsets, size in zip(windows["window"], windows["plan_terms"], windows["plan_offsets"], windows["size"], strict=True):
        if not all(t in lists for t in terms):
            continue
        start = lists[terms[0]] - offsets[0]
        exact = np.ones(len(start), dtype=bool)
        for t, o in zip(terms[1:], offsets[1:], strict=True):
            ok, same = _near(lists[t], start + o, slop)
            start, exact = start[ok], (exact & same)[ok]
            if not len(start):
                break
        if len(start):
            doc = np.searchsorted(begins, start + offsets[0], side="right") - 1
            found.append(pd.DataFrame({"doc": doc, "start": start - begins[doc], "size": size, "window": window, "exact": exact}))
    out = pd.concat(found, ignore_index=True) if found else pd.DataFrame({"doc": [], "start": [], "size": [], "window": [], "exact": []})
    return out.assign(segment=postings["segment"].iloc[0])


def find_windows(index: DataFrame, windows: DataFrame, gap: int, slop: int = 0, per_bucket: int = 50_000) -> DataFrame:
    """(segment, doc, start, size, window, exact): where the windows occur. `windows` is what item_windows gives."""
    distinct = windows.select("window", "terms").distinct()
    places = distinct.select("window", F.posexplode("terms").alias("offset", "term"))
    terms = places.select("term").distinct()
    postings = index.filter("term IS NOT NULL").select("segment", "term", "n", "places")
    wanted = postings.join(terms, "term")
    counts = wanted.groupBy("term").agg(F.sum("n").alias("total"))
    ranked = (
        places.join(counts, "term").groupBy("window")
        .agg(F.array_sort(F.collect_list(F.struct("total", "offset", "term"))).alias("plan"))
        .join(distinct.select("window", F.size("terms").alias("size")), "window").filter(F.size("plan") == F.col("size"))  # all terms occur
    )
    buckets = 1 + ranked.count() // per_bucket
    plans = stored(ranked.select(
        "window", "size", F.col("plan.term").alias("plan_terms"), F.col("plan.offset").alias("plan_offsets"), F.pmod("window", F.lit(buckets)).alias("bucket"), F.col("plan")[0]["term"].alias("term"),
    ), "window-plans")
    candidates = postings.select("segment", "term").join(plans, "term").select(F.col("segment").alias("place"), F.col("bucket").alias("part"), "window", "size", "plan_terms", "plan_offsets")
    heads = index.filter("term IS NULL").select("segment", F.lit(0).cast("bigint").alias("term"), F.lit(None).cast("binary").alias("places"), "doc_words")
    lists = wanted.select("segment", "term", "places", F.lit(None).cast("array<bigint>").alias("doc_words")).unionByName(heads)
    lists = lists.withColumn("bucket", F.explode(F.expr(f"sequence(0L, {buckets - 1}L)")))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["segment", "doc", "start", "size", "window", "exact"]
        if left.empty or right.empty:
            return pd.DataFrame(columns=columns)
        return search_segment(left, right, gap, slop)[columns].astype({c: "int64" for c in columns[:5]} | {"exact": bool})

    schema = "segment bigint, doc bigint, start bigint, size bigint, window bigint, exact boolean"
    return candidates.groupBy("place", "part").cogroup(lists.groupBy("segment", "bucket")).applyInPandas(search, schema)


def covered_words(matches: DataFrame) -> DataFrame:
    """(segment, doc, n_hit): words inside at least one match."""
    spans = matches.select("segment", "doc", "start", (F.col("start") + F.col("size")).alias("end")).distinct()
    before = Window.partitionBy("segment", "doc").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    return spans.withColumn("fresh", fresh).groupBy("segment", "doc").agg(F.sum("fresh").alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, slop: int = 0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, item_ids (sorted as strings), n_near (proximity matches that are not exact)."""
    gap = size + slop + 1
    index = build_index(texts_of(docs, id_col, text_col), gap)
    cut = item_windows(items.select(F.col(f"`{item_col}`").cast("bigint").alias("doc_id"), F.col(f"`{item_text_col}`").cast("string").alias("text")), size)
    matches = stored(find_windows(index, cut, gap, slop), "window-matches")
    exact = matches.filter("exact")
    names = (
        exact.select("segment", "doc", "window").distinct().join(cut.select("window", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")).distinct(), "window")
        .groupBy("segment", "doc").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    )
    near = matches.filter("NOT exact").groupBy("segment", "doc").agg(F.count("*").alias("n_near"))
    rows = index.filter("term IS NULL").select("segment", F.posexplode(F.arrays_zip("doc_ids", "doc_words")).alias("doc", "head")).select("segment", F.col("doc").cast("bigint").alias("doc"), "head")
    key = ["segment", "doc"]
    return rows.join(covered_words(exact), key, "left").join(names, key, "left").join(near, key, "left").select(
        F.col("head.doc_ids").alias("doc_id"), F.col("head.doc_words").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )
