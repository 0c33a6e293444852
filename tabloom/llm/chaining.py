"""Fuzzy repeated passages by collinear chaining of shared k-mer seeds.

1. Seeds: the fingerprints of each document's runs of `k` words at content-selected places (minimisers), for each
   (k, window) of `levels`, so that two places with `k + window - 1` equal words in a row share one.
2. Anchors (`shared_seeds`): seeds that occur more than once are linked with the first occurrence of the seed in the corpus
   and with the previous one. Short seeds are often first elsewhere; the long seeds across such pieces are shared only by
   documents that have the pieces in the same order, and link those. The number of anchors is at most twice that of the
   seeds, however often a passage is repeated.
3. `chain`: the anchors of a pair of documents are merged into runs on one diagonal and chained in both documents' order.
   A chain needs two anchors at least; its score is the matched words less a cost per word of gap; a Fenwick tree over the ends in the first document
   gives the best predecessor of each run in logarithmic time.
4. `align`: chains are aligned word by word: on the diagonal of a run, by an edit alignment between runs, and up to
   `pad` words beyond both ends. The stretches with the best balance of matches and errors are the passages: at least
   `min_words` words of the later document with at least `identity` matches per column.

A passage is reported for the later occurrence, with the place of the earlier one (in the order in which the documents
are read; a repeat inside one document too). Null, empty and short texts have no passages. Rows equal in id and text are
told apart as occurrences, and their spans are reported once. Null ids stay null. An empty table gives no rows; other
columns are not read. Words are compared by 32-bit fingerprints. A task holds one chunk of documents (about a million
words, or one longer text) and its anchors, at most two per seed, with the stretches of words that they lead to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabloom.llm.common import texts_of
from tabloom.llm.shared_seeds import Chunk, by_chunk, by_frequency, chunks, distinct, linked, links, order_of, packed, ranked, unpacked

MIN_WORDS = 50
#: (words of a seed, places among which one is selected), short seeds first. Of 50 words with 40 equal ones, the equal
#: runs have at least 7 places with four equal words in a row, wherever the errors are, so all places are seeds.
#: Pieces of a passage that stand elsewhere are too short to be passages: any 50 equal words have a seed of 40.
LEVELS = ((4, 1), (8, 4), (16, 9), (40, 11))
#: Anchors of one diagonal at most so many words apart are one run.
REACH = 18
COLUMNS = ("key", "doc_id", "start", "end", "first_key", "first_id", "first_start", "first_end", "matches")


class Fenwick:
    """Prefix maxima with the entry that has them."""

    def __init__(self, n: int):
        self.best = [(-np.inf, -1)] * (n + 1)

    def put(self, i: int, value: float, who: int) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i][0]:
                self.best[i] = (value, who)
            i += i & -i

    def upto(self, i: int) -> tuple[float, int]:
        """The largest value put at 0 .. i - 1."""
        found = (-np.inf, -1)
        while i:
            found = max(found, self.best[i])
            i -= i & -i
        return found


def runs(at: np.ndarray, first_at: np.ndarray, k: int, reach: int) -> np.ndarray:
    """Anchors as runs (start, end, first_start, first_end): neighbours on one diagonal at most `reach` apart are one run."""
    order = np.lexsort((at, at - first_at))
    at, first_at = at[order], first_at[order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(at - first_at) != 0) | (np.diff(at) > reach)
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(at)) - 1
    out = np.stack([at[start], at[last] + k, first_at[start], first_at[last] + k], axis=1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def chain(segments: np.ndarray, gap_cost: float, max_gap: int) -> list[list[int]]:
    """Chains of runs, best first, each run in one chain. A chain is cut where its runs are more than max_gap apart."""
    n = len(segments)
    if n == 1:
        return [[0]]
    start, end, fstart, fend = (segments[:, i].tolist() for i in range(4))
    ends = distinct(segments[:, 3])
    rank_of_end = np.searchsorted(ends, segments[:, 3]).tolist()
    before = np.searchsorted(ends, segments[:, 2], side="right").tolist()  # ends up to the run's start
    tree = Fenwick(len(ends))
    score, back = [0.0] * n, [-1] * n
    waiting = sorted(range(n), key=end.__getitem__)
    w = 0
    for i in range(n):  # in the order of the starts
        while w < n and end[waiting[w]] <= start[i]:
            j = waiting[w]
            tree.put(rank_of_end[j], score[j] + gap_cost * (end[j] + fend[j]), j)
            w += 1
        score[i] = end[i] - start[i]
        best, j = tree.upto(before[i])
        if j >= 0 and (gain := best - gap_cost * (start[i] + fstart[i])) > 0:
            score[i] += gain
            back[i] = j
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        line = []
        while i >= 0 and not used[i]:
            used[i] = True
            if line and max(start[line[-1]] - end[i], fstart[line[-1]] - fend[i]) > max_gap:
                out.append(line[::-1])
                line = []
            line.append(i)
            i = back[i]
        if line:
            out.append(line[::-1])
    return out


def between(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Edit alignment of two short stretches, as columns (word of x used, word of y used, equal)."""
    cost = np.zeros((len(x) + 1, len(y) + 1), dtype=np.int32)
    cost[:, 0], cost[0] = np.arange(len(x) + 1), np.arange(len(y) + 1)
    steps = np.arange(len(y) + 1)
    for i in range(len(x)):
        row = np.minimum(cost[i, 1:] + 1, cost[i, :-1] + (y != x[i]))
        cost[i + 1] = np.minimum.accumulate(np.append(i + 1, row) - steps) + steps
    out, i, j = [], len(x), len(y)
    cost, x, y = cost.tolist(), x.tolist(), y.tolist()
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (x[i - 1] != y[j - 1]):
            out.append((1, 1, int(x[i - 1] == y[j - 1])))
            i, j = i - 1, j - 1
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            out.append((1, 0, 0))
            i -= 1
        else:
            out.append((0, 1, 0))
            j -= 1
    return np.array(out[::-1], dtype=np.int64).reshape(-1, 3)


def diagonal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), 3), dtype=np.int64)
    out[:, 2] = x == y
    return out


def one_sided(i: int, j: int) -> np.ndarray:
    """Columns of i words of x alone, then j words of y alone."""
    out = np.zeros((i + j, 3), dtype=np.int64)
    out[:i, 0] = 1
    out[i:, 1] = 1
    return out


def diagonals(x_at: np.ndarray, y_at: np.ndarray, i: np.ndarray, j: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The whole diagonals through (i, j) of many pairs of slices of x and y (from, to), one after the other: for each word whether it is equal in
    both, where the diagonals begin in that, and where in their slices."""
    lead = np.minimum(i, j)
    n = np.minimum(x_at[1] - x_at[0] - i, y_at[1] - y_at[0] - j) + lead
    begin = np.append(0, np.cumsum(n))
    steps = np.arange(begin[-1])
    equal = x[steps + np.repeat(x_at[0] + i - lead - begin[:-1], n)] == y[steps + np.repeat(y_at[0] + j - lead - begin[:-1], n)]
    return equal, begin, i - lead, j - lead


def align(x: np.ndarray, y: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Alignment of two slices along a chain of runs (places inside the slices), with the ends extended on their diagonals."""
    lead = int(min(segments[0, 0], segments[0, 2]))
    i, j = int(segments[0, 0]) - lead, int(segments[0, 2]) - lead
    parts = [one_sided(i, j)]
    for a, b, c, d in segments.tolist():
        a, c = max(a, i), max(c, j)
        gap = diagonal(x[i:a], y[j:c]) if a - i == c - j else None
        if gap is None or np.count_nonzero(gap[:, 2] == 0) > 2 and parts[1:]:
            gap = between(x[i:a], y[j:c])
        parts.append(gap)
        size = min(b - a, d - c)
        parts.append(diagonal(x[a : a + size], y[c : c + size]))
        i, j = a + size, c + size
    tail = min(len(x) - i, len(y) - j)
    parts.append(diagonal(x[i : i + tail], y[j : j + tail]))
    return np.concatenate(parts)


def passages(columns: np.ndarray, min_words: int, identity: float) -> list[tuple[int, int, int, int, int]]:
    """(x start, x end, y start, y end, matches) of the best stretches of an alignment."""
    found = np.zeros(len(columns) + 1, dtype=np.int64)
    np.cumsum(columns[:, 2], out=found[1:])
    if found[-1] < identity * min_words:
        return []
    px, py = np.zeros_like(found), np.zeros_like(found)
    np.cumsum(columns[:, 0], out=px[1:])
    np.cumsum(columns[:, 1], out=py[1:])
    return [(int(px[a]), int(px[b]), int(py[a]), int(py[b]), n) for a, b, n in stretches(found, px, min_words, identity)]


def diagonal_passages(equal: np.ndarray, i: int, j: int, min_words: int, identity: float) -> list[tuple[int, int, int, int, int]]:
    """`passages` of a diagonal that begins at (i, j)."""
    found = np.zeros(len(equal) + 1, dtype=np.int64)
    np.cumsum(equal, out=found[1:])
    return [(i + a, i + b, j + a, j + b, n) for a, b, n in stretches(found, np.arange(len(found)), min_words, identity)]


def stretches(found: np.ndarray, px: np.ndarray, min_words: int, identity: float) -> list[tuple[int, int, int]]:
    """(from, to, matches) of the best stretches of columns, from the matches and words of x before each column."""
    value = 3 * found - 2 * np.arange(len(found))  # 1 for a match, -2 for another column
    out, todo = [], [(0, len(found) - 1)]
    while todo:
        lo, hi = todo.pop()
        if px[hi] - px[lo] < min_words or found[hi] - found[lo] < identity * min_words:
            continue  # no passage fits into it
        part = value[lo : hi + 1]
        to = lo + int((part - np.minimum.accumulate(part)).argmax())
        fro = lo + int(value[lo : to + 1].argmin())
        if to <= fro:
            continue
        matches = int(found[to] - found[fro])
        todo += [(lo, fro), (to, hi)]
        if px[to] - px[fro] < min_words:
            continue
        if matches >= identity * (to - fro):
            out.append((fro, to, matches))
        else:  # too many errors inside: the parts beside the worst gap
            high = np.maximum.accumulate(value[fro : to + 1])
            end = fro + int((high - value[fro : to + 1]).argmax())
            todo += [(fro, fro + int(value[fro : end + 1].argmax())), (end, to)]
    return sorted(out)


def runs_of_pairs(pair: np.ndarray, at: np.ndarray, first_at: np.ndarray, size: np.ndarray, k: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """`runs` of many pairs of documents at once: the pairs, and their runs, in the order of the pairs. A long seed is short ones at both ends."""
    if not len(pair):
        return pair, np.zeros((0, 4), dtype=np.int64)
    long = np.flatnonzero(size > k)
    more = size[long] - k
    pair, at, first_at = np.append(pair, pair[long]), np.append(at, at[long] + more), np.append(first_at, first_at[long] + more)
    order = order_of(pair, at - first_at, at)
    pair, at, first_at = pair[order], at[order], first_at[order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(pair) != 0) | (np.diff(at - first_at) != 0) | (np.diff(at) > reach)
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(at)) - 1
    out = np.stack([at[start], at[last] + k, first_at[start], first_at[last] + k], axis=1)
    order = order_of(pair[start], out[:, 0], out[:, 2])
    return pair[start][order], out[order]


def lines(pair: np.ndarray, segments: np.ndarray, k: int, gap_cost: float, max_gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All chains of more than one short seed: their pairs, how many runs each has, and the runs, chain after chain."""
    begins = np.flatnonzero(np.append(True, np.diff(pair) != 0)) if len(pair) else np.zeros(0, dtype=np.int64)
    n = np.diff(np.append(begins, len(pair)))
    sizes = segments[:, 1] - segments[:, 0]
    alone = begins[(n == 1) & (sizes[begins] > k)]
    several = [x for a, m in zip(begins[n > 1].tolist(), n[n > 1].tolist()) for x in ([a + i for i in line] for line in chain(segments[a : a + m], gap_cost, max_gap)) if len(x) > 1 or sizes[x[0]] > k]
    first = np.append(alone, np.array([x[0] for x in several], dtype=np.int64))
    n_runs = np.append(np.ones(len(alone), dtype=np.int64), np.array([len(x) for x in several], dtype=np.int64))
    return pair[first], n_runs, segments[np.append(alone, np.array([i for x in several for i in x], dtype=np.int64))]


def pieces(bounds: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of texts of a chunk from lo to hi (or the end), sorted by where they begin: the places of their words in the
    chunk, each once, and where each stretch begins and ends in that list."""
    start = bounds[doc] + lo
    end = np.minimum(bounds[doc] + hi, bounds[doc + 1])
    most = np.maximum.accumulate(end)
    new = np.append(True, start[1:] > most[:-1])
    first = np.flatnonzero(new)
    n = most[np.append(first[1:], len(start)) - 1] - start[first]
    shift = (start[first] - np.cumsum(n) + n)
    at = shift[np.cumsum(new) - 1]
    return np.arange(n.sum()) + np.repeat(shift, n), start - at, end - at


def repeats(docs: DataFrame, levels: tuple[tuple[int, int], ...] = LEVELS, gap_cost: float = 0.1, max_gap: int = 60, min_words: int = MIN_WORDS, identity: float = 0.8, pad: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc_id, start, end, first_key, first_id, first_start, first_end, matches): fuzzy passages that occurred before."""
    table = chunks(texts_of(docs, id_col, text_col))
    k = levels[0][0]

    def link(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        for base, words in zip(chunk.column("base").to_pylist(), chunk.column("words")):
            doc, at, first_base, first_doc, first_at, size = links(Chunk(base, words.as_py()), answers, levels)
            firsts, code = np.unique(first_base + first_doc, return_inverse=True)  # rows of a chunk are numbered from its base
            bases = np.zeros(len(firsts), dtype=np.int64)
            bases[code] = first_base
            n_docs = int(doc.max(initial=0)) + 1
            pair, n_runs, segments = lines(*runs_of_pairs(code * n_docs + doc, at, first_at, size, k, REACH), k, gap_cost, max_gap)
            end = np.cumsum(n_runs)
            begin = end - n_runs
            lo, hi = np.maximum(segments[begin, 0] - pad, 0), segments[end - 1, 1] + pad
            first_lo, first_hi = np.maximum(segments[begin, 2] - pad, 0), segments[end - 1, 3] + pad
            order = order_of(pair // n_docs, first_lo)  # stretches of one chunk together, of one document side by side
            order = order[(hi - lo >= min_words)[order]]
            other = bases[pair[order] // n_docs]
            edges = np.append(np.flatnonzero(np.append(True, other[1:] != other[:-1])), len(other)) if len(other) else [0]
            for a, b in zip(edges[:-1], edges[1:]):
                own, of = order[a:b], int(other[a])
                runs_at = np.repeat(begin[own] - np.cumsum(n_runs[own]) + n_runs[own], n_runs[own]) + np.arange(n_runs[own].sum())
                columns = (pair[own] % n_docs, firsts[pair[own] // n_docs] - of, lo[own], hi[own], first_lo[own], first_hi[own], n_runs[own], segments[runs_at].ravel())
                for column, v in zip(out, (base, of, packed(*(x.astype(np.int32) for x in columns))), strict=True):
                    column.append(v)
        return pa.table({"own": pa.array(out[0], pa.int64()), "base": pa.array(out[1], pa.int64()), "payload": pa.array(out[2], pa.binary())})

    def cut(chunk: pa.Table, wanted: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        for base, words, keys, ids in zip(chunk.column("base").to_pylist(), chunk.column("words"), chunk.column("keys"), chunk.column("ids")):
            first = Chunk(base, words.as_py())
            for own, payload in zip(wanted.column("own").to_pylist(), wanted.column("payload")):
                doc, lo, hi = (x.astype(np.int64) for x in (unpacked(payload.as_py())[i] for i in (1, 4, 5)))
                places, begin, end = pieces(first.bounds, doc, lo, hi)
                used, code = ranked(first.codes[places], len(first.known))
                order, code = by_frequency(code, len(used))
                used = used[order]
                named = pa.array(distinct(doc))
                for column, v in zip(out, (own, payload.as_py(), packed(begin.astype(np.int32), (end - begin).astype(np.int32), first.known[used].astype("<u4"), code), keys.values.take(named).to_pylist(), ids.values.take(named).to_pylist()), strict=True):
                    column.append(v)
        return pa.table({"base": pa.array(out[0], pa.int64()), "payload": pa.array(out[1], pa.binary()), "words": pa.array(out[2], pa.binary()), "keys": pa.array(out[3], pa.list_(pa.binary())), "ids": pa.array(out[4], pa.list_(pa.int64()))})

    def compare(chunk: pa.Table, cuts: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(9)]
        for base, words, keys, ids in zip(chunk.column("base").to_pylist(), chunk.column("words"), chunk.column("keys").to_pylist(), chunk.column("ids").to_pylist()):
            later = Chunk(base, words.as_py())
            x_words = later.known.astype("<u4")[later.codes]
            for payload, first_words, first_keys, first_ids in zip(cuts.column("payload"), cuts.column("words"), cuts.column("keys").to_pylist(), cuts.column("ids").to_pylist()):
                *columns, n_runs, segments = (x.astype(np.int64) for x in unpacked(payload.as_py()))
                doc, first_doc, lo, hi, first_lo, first_hi = columns
                begin, n, known, code = unpacked(first_words.as_py())
                y_at = np.stack([begin, begin + n]).astype(np.int64)
                x_at = np.stack([later.bounds[doc] + lo, np.minimum(later.bounds[doc] + hi, later.bounds[doc + 1])])
                y_words = known[code]
                names = np.searchsorted(distinct(first_doc), first_doc)
                edges = np.append(0, np.cumsum(4 * n_runs))

                # chains of one run lie on one diagonal; few have enough equal words on it
                single = np.flatnonzero(n_runs == 1)
                run = edges[single]
                equal, begins, i0, j0 = diagonals(x_at[:, single], y_at[:, single], segments[run] - lo[single], segments[run + 2] - first_lo[single], x_words, y_words)
                matched = np.append(0, np.cumsum(equal))
                matched = matched[begins[1:]] - matched[begins[:-1]]
                todo = np.flatnonzero(matched >= identity * min_words)
                results = [(single[t], diagonal_passages(equal[begins[t] : begins[t + 1]], int(i0[t]), int(j0[t]), min_words, identity)) for t in todo.tolist()]
                inside = segments.reshape(-1, 4) - np.repeat(np.stack([lo, lo, first_lo, first_lo], axis=1), n_runs, axis=0)
                several = np.flatnonzero(n_runs > 1)
                for t, a, b, c, e, f, g in zip(several.tolist(), *x_at[:, several].tolist(), *y_at[:, several].tolist(), (edges[several] // 4).tolist(), (edges[several + 1] // 4).tolist()):
                    results.append((t, passages(align(x_words[a:b], y_words[c:e], inside[f:g]), min_words, identity)))
                for t, found in results:
                    for a, b, c, e, matches in found:
                        d, a0, b0, name = int(doc[t]), int(lo[t]), int(first_lo[t]), int(names[t])
                        for values, v in zip(out, (keys[d], ids[d], a0 + a, a0 + b, first_keys[name], first_ids[name], b0 + c, b0 + e, matches), strict=True):
                            values.append(v)
        kinds = [pa.binary() if c.endswith("key") else pa.int64() for c in COLUMNS]
        return pa.table({c: pa.array(v, t) for c, v, t in zip(COLUMNS, out, kinds, strict=True)})

    chains = by_chunk(table.select("base", "words"), linked(table, levels)).applyInArrow(link, "own bigint, base bigint, payload binary")
    cuts = by_chunk(table, chains).applyInArrow(cut, "base bigint, payload binary, words binary, keys array<binary>, ids array<bigint>")
    return by_chunk(table, cuts).applyInArrow(compare, ", ".join(f"`{c}` {'binary' if c.endswith('key') else 'bigint'}" for c in COLUMNS)).distinct()
