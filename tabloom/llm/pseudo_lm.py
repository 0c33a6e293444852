"""Document scores by masked pseudo-likelihood: a small network predicts every word from the words on both sides.

1. `word_counts` counts the words of all documents; the KNOWN most frequent ones get their own class, the others share
   hashed classes. Class 0 stands outside a text.
2. `train` passes over all documents `rounds` times. In each round every partition goes on from the common parameters
   with stochastic gradient steps (Adagrad) on its own documents; the results are averaged, weighted by words, in a tree
   over the cluster. The driver holds one set of parameters, whose size does not depend on the corpus.
3. `score` adds log P(word | two words before, two words after) over all words of a document.

The network: a vector for each neighbour's class and place, added and squashed by tanh, predicts the group of the class
(64 groups) and then, given the group, the class in it. Biases start from the word frequencies, so an untrained network
is the unigram model.

Null, empty and wordless texts have 0 words, log-likelihood 0 and no mean. Repeated rows train and are scored each; null
ids are kept; an empty table gives no rows; other columns are not read. Long texts are handled in batches of words.
Words are those of `words`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabloom.llm.common import stored, text_chunks, texts_of
from tabloom.llm.words import Words

GROUPS = 64
CLASSES = GROUPS * GROUPS
KNOWN = 3072
SIDES = (-2, -1, 1, 2)
SIZE = 16
BATCH = 8192
#: Rows of a batch that are computed together, few enough for their tables to stay in a core's cache.
ROWS = 1024
SHAPES = {"near": (len(SIDES), CLASSES, SIZE), "shift": (SIZE,), "group": (SIZE, GROUPS), "group_bias": (GROUPS,), "given": (GROUPS, SIZE), "inside": (SIZE, GROUPS), "inside_bias": (GROUPS, GROUPS)}


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents; words by 64-bit fingerprints, added up in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = [], []

        def added() -> tuple[np.ndarray, np.ndarray]:
            flat, order = np.unique(np.concatenate(words), return_inverse=True)
            return flat, np.bincount(order, weights=np.concatenate(n), minlength=len(flat)).astype(np.int64)

        def rows() -> pa.RecordBatch:
            w, k = added()
            return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(k)], names=["word", "n"])

        waiting = 0
        for _, texts in text_chunks(batches):
            own, k = np.unique(Words(texts).hashes, return_counts=True)
            words.append(own)
            n.append(k)
            waiting += len(own)
            if waiting > 1 << 20:
                w, k = added()
                words, n, waiting = [w], [k], len(w)
                if waiting > 1 << 19:
                    yield rows()
                    words, n, waiting = [], [], 0
        if words:
            yield rows()

    return docs.mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted fingerprints of the known words, their classes, and the number of words in every class."""
    counts = stored(word_counts(docs), "word-counts")
    top = [(r.word, r.n) for r in counts.orderBy(F.desc("n"), "word").limit(KNOWN).collect()]
    words = np.array([w for w, _ in top], dtype=np.int64)
    order = np.argsort(words)
    classes = (order + 1).astype(np.uint16)
    total = counts.agg(F.sum("n")).first()[0] or 0
    per_class = np.zeros(CLASSES)
    per_class[1 : len(top) + 1] = [n for _, n in top]
    per_class[KNOWN + 1 :] = (total - per_class.sum()) / (CLASSES - KNOWN - 1)
    return words[order], classes, per_class


def classes_of(hashes: np.ndarray, words: np.ndarray, classes: np.ndarray) -> np.ndarray:
    own = hashes.view(np.int64)
    out = (KNOWN + 1 + (hashes >> np.uint64(20)) % np.uint64(CLASSES - KNOWN - 1)).astype(np.uint16)
    if len(words):
        at = np.minimum(np.searchsorted(words, own), len(words) - 1)
        known = words[at] == own
        out[known] = classes[at[known]]
    return out


def class_table(docs: DataFrame, words: np.ndarray, classes: np.ndarray) -> DataFrame:
    """(doc_id, n_words, classes): a stored row per document, its classes as little-endian unsigned 16-bit."""
    known = docs.sparkSession.sparkContext.broadcast((words, classes))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_chunks(batches):
            own = Words(texts)
            flat = classes_of(own.hashes, *known.value).astype("<u2")
            offsets = pa.py_buffer((own.bounds * 2).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(own.bounds)), pa.Array.from_buffers(pa.binary(), len(ids), [None, offsets, pa.py_buffer(flat)])], names=["doc_id", "n_words", "classes"])

    return stored(docs.mapInArrow(convert, "doc_id bigint, n_words bigint, classes binary"), "word-classes", compression="zstd")


def initial(per_class: np.ndarray) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(11)
    p = {k: (rng.normal(0, 0.05, s)).astype(np.float32) for k, s in SHAPES.items()}
    share = np.log((per_class + 0.5) / (per_class.sum() + 0.5 * CLASSES)).reshape(GROUPS, GROUPS)
    groups = np.log(np.exp(share).sum(axis=1))
    p["group_bias"], p["inside_bias"], p["shift"] = groups.astype(np.float32), (share - groups[:, None]).astype(np.float32), np.zeros(SIZE, dtype=np.float32)
    p["group"] *= 0.1
    p["inside"] *= 0.1
    return p


def packed(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def unpacked(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[k] = flat[at : at + n].reshape(shape).astype(np.float32)
        at += n
    return out


def windows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For all words of some texts, one after the other: the classes of the neighbours (0 outside the text), and their own."""
    gap = np.zeros(2, dtype=np.uint16)
    stream = np.concatenate([gap, *[x for t in texts for x in (t, gap)]]).astype(np.int64)
    n = np.array([len(t) for t in texts])
    at = np.arange(n.sum()) + 2 * (1 + np.repeat(np.arange(len(texts)), n))
    return np.stack([stream[at + s] for s in SIDES]).T, stream[at]


def _hidden(p: dict[str, np.ndarray], near: np.ndarray) -> np.ndarray:
    return np.tanh(p["shift"] + sum(np.take(p["near"][j], near[:, j], axis=0) for j in range(len(SIDES))))


def _exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """Exponentials of z less a top value, their sums by row, and the top: one for all rows, or one a row where rows lie far apart."""
    one, top = np.ones(z.shape[1], dtype=z.dtype), z.max()
    e = np.exp(z - top)
    total = e @ one
    if total.min() < 1e-30:
        top = z.max(axis=1)
        e = np.exp(z - top[:, None])
        total = e @ one
    return e, total, top


def _log_probability(z: np.ndarray, own: np.ndarray) -> np.ndarray:
    _, total, top = _exponentials(z)
    return z[np.arange(len(own)), own] - top - np.log(total)


def forward(p: dict[str, np.ndarray], near: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Log-probability of every word."""
    out = np.empty(len(own), dtype=p["near"].dtype)
    for at in range(0, len(own), ROWS):
        rows = slice(at, at + ROWS)
        group, inside = np.divmod(own[rows], GROUPS)
        h = _hidden(p, near[rows])
        out[rows] = _log_probability(h @ p["group"] + p["group_bias"], group)
        out[rows] += _log_probability((h + p["given"][group]) @ p["inside"] + p["inside_bias"][group], inside)
    return out


def _less_expected(z: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """One at the true class less the probabilities, over n."""
    e, total, _ = _exponentials(z)
    e *= (-1 / (n * total))[:, None]
    e[np.arange(len(own)), own] += 1 / n
    return e


def _rows_added(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Rows of values added up by index."""
    width = values.shape[1]
    flat = (index[:, None] * width + np.arange(width)).ravel()
    return np.bincount(flat, weights=values.ravel(), minlength=size * width).reshape(size, width).astype(np.float32)


def gradients(p: dict[str, np.ndarray], near: np.ndarray, own: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean log-likelihood, upwards. Words of one group are put side by side, so that their rows are added as one stretch."""
    n = len(own)
    order = np.argsort((own // GROUPS).astype(np.uint8), kind="stable")
    near, own = near[order], own[order]
    dh = np.empty((n, SIZE), dtype=p["near"].dtype)
    out = {k: np.zeros(s, dtype=p["near"].dtype) for k, s in SHAPES.items() if k != "near"}
    for at in range(0, n, ROWS):
        rows = slice(at, at + ROWS)
        group, inside = np.divmod(own[rows], GROUPS)
        h = _hidden(p, near[rows])
        g = h + p["given"][group]
        d1 = _less_expected(h @ p["group"] + p["group_bias"], group, n)
        d2 = _less_expected(g @ p["inside"] + p["inside_bias"][group], inside, n)
        dg = d2 @ p["inside"].T
        dh[rows] = (d1 @ p["group"].T + dg) * (1 - h * h)
        one = np.ones(len(group), dtype=h.dtype)
        out["group"] += h.T @ d1
        out["group_bias"] += one @ d1
        out["inside"] += g.T @ d2
        begins = np.flatnonzero(np.diff(group, prepend=-1))
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(group)], strict=True):
            out["given"][group[a]] += one[a:b] @ dg[a:b]
            out["inside_bias"][group[a]] += one[a:b] @ d2[a:b]
    out["shift"] = dh.sum(axis=0)
    out["near"] = np.stack([_rows_added(near[:, j], dh, CLASSES) for j in range(len(SIDES))])
    return out


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Texts of about BATCH words together; longer texts are cut."""
    texts, size = [], 0
    for batch in batches:
        for value in batch.column("classes"):
            whole = np.frombuffer(value.as_py(), dtype="<u2")
            for at in range(0, len(whole), BATCH):
                texts.append(whole[at : at + BATCH])
                size += len(texts[-1])
                if size >= BATCH:
                    yield texts
                    texts, size = [], 0
    if size:
        yield texts


def train(table: DataFrame, p: dict[str, np.ndarray], rounds: int = 2, rate: float = 0.1) -> dict[str, np.ndarray]:
    for _ in range(rounds):
        common = table.sparkSession.sparkContext.broadcast(packed(p))

        def learn(batches: Iterator[pa.RecordBatch], common=common) -> Iterator[pa.RecordBatch]:
            own, seen = unpacked(common.value), 0
            squares = {k: np.full(s, 1e-6, dtype=np.float32) for k, s in SHAPES.items()}
            for texts in _batches(batches):
                near, target = windows(texts)
                for k, g in gradients(own, near, target).items():
                    squares[k] += g * g
                    own[k] += rate * g / np.sqrt(squares[k])
                seen += len(target)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([packed(own).tobytes()], pa.binary())], names=["n", "parameters"])

        parts = table.select("classes").mapInArrow(learn, "n bigint, parameters binary").rdd
        sums = parts.map(lambda r: (r.n, np.frombuffer(r.parameters, dtype=np.float32).astype(np.float64) * r.n)).treeAggregate(
            (0, 0.0), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda a, b: (a[0] + b[0], a[1] + b[1]), depth=2)
        if sums[0]:
            p = unpacked(sums[1] / sums[0])
    return p


def score(table: DataFrame, p: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, n_words, log_likelihood, mean_log_likelihood)."""
    common = table.sparkSession.sparkContext.broadcast(packed(p))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = unpacked(common.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64)
                texts = [np.frombuffer(x, dtype="<u2") for x in rows.column("classes").to_pylist()]
                near, target = windows(texts)
                logs = np.concatenate([np.zeros(1), *[forward(own, near[i : i + BATCH], target[i : i + BATCH]).astype(np.float64) for i in range(0, len(target), BATCH)]])
                ends = np.cumsum([len(t) for t in texts])
                total = np.diff(np.append(0, np.cumsum(logs)[ends]))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("n_words"), pa.array(total)], names=["doc_id", "n_words", "log_likelihood"])

    scored = table.mapInArrow(add, "doc_id bigint, n_words bigint, log_likelihood double")
    return scored.withColumn("mean_log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))


def pseudo_likelihood(docs: DataFrame, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on all documents and score each of them."""
    rows = texts_of(docs, id_col, text_col)
    words, classes, per_class = vocabulary(rows)
    table = class_table(rows, words, classes)
    return score(table, train(table, initial(per_class), rounds))
