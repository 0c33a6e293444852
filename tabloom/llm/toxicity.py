"""Toxicity by a weighted lexicon: folded texts, Aho-Corasick, exception phrases, normalised by length.

Folding makes one spelling of look-alikes: compatibility forms, case, accents, Cyrillic and Greek letters that look like
Latin ones, digits inside words (1d10t), single signs before a letter (tr@sh), l as i; invisible characters vanish. Words
are runs of letters and digits; a folded text is its words with one space before, between and behind them. A term of the
lexicon begins at a word's beginning and is a whole word or the beginning of longer ones. A hit inside an exception
phrase does not count. The score is a logistic function of the hits' summed weights, the number of words, and the sum
per word.

`learn` takes the terms from labelled documents: beginnings and whole words that stand (once, or twice and more) in
clearly more toxic than clean documents (signed root of the likelihood ratio), the most telling first, and no term that
contains or is contained in one taken before. Their weights are log ratios of rates per word, at least `min_weight`:
in a large corpus even a tiny difference is significant. Phrases of a hit and a
neighbour word that mark clean documents become exceptions. At most `max_labelled` labelled documents are used, the ones
with the least hashes; a term is looked for in clean documents only when it stands in `min_share` of the toxic ones
(3 at least), which bounds the candidates by the terms of 1 / min_share toxic documents.

Null and empty texts have no words, hence no hits, and get the score of that. Every row gives one row, repeated rows
too; the id may be null; other columns are not read. Without labels the lexicon is empty and every score is 0.5. Texts
are folded in parts of STEP characters, cut between words, so long ones are read whole in bounded memory.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabloom.llm.common import stored, texts_of

STEP = 1 << 20
SHORTEST, LONGEST_STEM = 4, 10
#: Letters of other scripts that look like Latin ones, digits and signs that stand for letters.
LOOK_ALIKES = dict(zip("авекмнорстухіјѕԁԛԝґөαβεικνορτυχηγωıłøđħɡ", "abekmhopctyxijsdqwroabeiknoptuxnywilodhg", strict=True))
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "+": "t", "€": "e"}
#: Signs that may also begin a word.
_LEADING = [ord("@"), ord("$")]
_GONE, _BREAK, _WORD, _DIGIT, _SIGN = range(5)


class Folder:
    """Tables of the folded character and its kind, filled in as characters come up."""

    def __init__(self):
        self.to = np.zeros(0x110000, dtype=np.uint32)
        self.kind = np.full(0x110000, 255, dtype=np.uint8)

    def learn(self, codes: np.ndarray) -> None:
        for code in np.unique(codes[self.kind[codes] == 255]).tolist():
            self.to[code], self.kind[code] = self.one(chr(code))

    @staticmethod
    def one(c: str) -> tuple[int, int]:
        if c in DIGITS or c in "26":
            return ord(DIGITS.get(c, c)), _DIGIT
        if c in SIGNS:
            return ord(SIGNS[c]), _SIGN
        if unicodedata.category(c) in ("Mn", "Me", "Cf"):
            return 0, _GONE
        plain = [x for x in unicodedata.normalize("NFKD", c).casefold() if unicodedata.category(x) not in ("Mn", "Me", "Cf")]
        first = LOOK_ALIKES.get(plain[0], plain[0]) if plain else " "
        if first in DIGITS or first in "26":
            return ord(DIGITS.get(first, first)), _DIGIT
        return (ord("i" if first == "l" else first), _WORD) if first.isalnum() else (32, _BREAK)

    def fold(self, text: str) -> str:
        """The words of a text, each with a space before it, and one behind the last."""
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        self.learn(codes)
        kind = self.kind[codes]
        codes, kind = codes[kind != _GONE], kind[kind != _GONE]
        inside = (kind == _WORD) | (kind == _DIGIT)
        before, after = np.append(_BREAK, kind)[:-1], np.append(kind, _BREAK)[1:]
        sign = (kind == _SIGN) & ((before == _WORD) | (before == _BREAK) & np.isin(codes, _LEADING))
        inside |= sign & (after == _WORD)
        out = np.where(inside, self.to[codes], 32)
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        if (digits := inside & (kind == _DIGIT)).any():  # words without a letter keep their digits
            letters = np.add.accumulate(np.append(0, kind == _WORD))
            starts, ends = edge[::2], edge[1::2]
            number = np.zeros(len(codes) + 1, dtype=np.int8)
            bare = letters[ends] == letters[starts]
            number[starts[bare]] = 1
            number[ends[bare]] -= 1
            keep = digits & (np.cumsum(number)[:-1] > 0)
            out[keep] = codes[keep]
        return f" {' '.join(out.astype('<u4').tobytes().decode('utf-32-le').split())} " if len(edge) else " "


_folder: list[Folder] = []


def folded(text: str | None) -> Iterator[str]:
    """A text's folded parts; a part ends where a word ends."""
    if not _folder:
        _folder.append(Folder())
    text = text or ""
    at = 0
    while at < len(text):
        stop = min(at + STEP, len(text))
        while stop < len(text) and not text[stop].isspace():
            stop += 1
        yield _folder[0].fold(text[at:stop])
        at = stop


def fold_term(term: str, whole: bool = True) -> str:
    """A term as the lexicon holds it: ' word ' or, for the beginning of words, ' word'."""
    made = "".join(folded(term))
    return made if whole else made[:-1]


@dataclass(frozen=True)
class Lexicon:
    """Folded terms with weights, folded exception phrases, and the four coefficients of the score."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    coefficients: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)


class Matcher:
    """Aho-Corasick automaton of a lexicon."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon = lexicon
        self.terms = list(lexicon.terms)
        self.weights = np.array([lexicon.terms[t] for t in self.terms])
        self.machine = ahocorasick.Automaton()
        for phrase in lexicon.exceptions:
            self.machine.add_word(phrase, (-1, len(phrase)))
        for number, term in enumerate(self.terms):
            if term not in self.machine:
                self.machine.add_word(term, (number, len(term)))
        if len(self.machine):
            self.machine.make_automaton()

    def hits(self, part: str) -> list[tuple[int, int, int]]:
        """(term, start, end) of all hits that no exception covers."""
        found, excused = [], []
        if len(self.machine):
            for last, (number, size) in self.machine.iter(part):
                (found if number >= 0 else excused).append((number, last + 1 - size, last + 1))
        if not excused or not found:
            return found
        starts = np.array([e[1] for e in sorted(excused, key=lambda e: e[1])])
        reach = np.maximum.accumulate([e[2] for e in sorted(excused, key=lambda e: e[1])])
        at = np.searchsorted(starts, [f[1] for f in found], side="right") - 1
        return [f for f, k in zip(found, at, strict=True) if k < 0 or reach[k] < f[2]]

    def count(self, text: str | None) -> tuple[Counter, int]:
        """Hits per term, and the number of words."""
        counts: Counter = Counter()
        words = 0
        for part in folded(text):
            words += part.count(" ") - 1
            counts.update(number for number, _, _ in self.hits(part))
        return counts, words

    def features(self, counts: Counter, words: int) -> list[float]:
        total = float(sum(self.weights[k] * n for k, n in counts.items()))
        return [1.0, np.log1p(total), np.log1p(words), np.log1p(1000 * total / max(words, 1))]

    def score(self, counts: Counter, words: int) -> float:
        return float(1 / (1 + np.exp(-np.dot(self.features(counts, words), self.lexicon.coefficients))))


def stems(word: str) -> tuple[str, ...]:
    """What the lexicon could hold of a word: the whole word and its beginnings."""
    return (f" {word} ", *(f" {word[:size]}" for size in range(SHORTEST, min(len(word), LONGEST_STEM) + 1)))


def labelled(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """(text, toxic) of at most max_labelled labelled ids, the ones with the least hashes."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    return docs.join(F.broadcast(some), "doc_id").select("text", "toxic")  # at most max_labelled rows of 9 bytes


def _counted(rows: DataFrame, candidates: list[str] | None) -> DataFrame:
    """(term, once, twice, times): documents with a term, those with it at least twice, and its occurrences, 5 at most of each."""
    shared = rows.sparkSession.sparkContext.broadcast(None if candidates is None else set(candidates))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice, times = Counter(), Counter(), Counter()
        wanted = shared.value
        known: dict[str, tuple[str, ...]] = {}  # words that came before; emptied when it has grown large
        for batch in batches:
            for text in batch.column("text").to_pylist():
                words = Counter(w for part in folded(text) for w in part.split())
                found: Counter = Counter()
                for word, n in words.items():
                    terms = known.get(word)
                    if terms is None:
                        terms = stems(word) if wanted is None else tuple(t for t in stems(word) if t in wanted)
                        if len(known) > 1 << 19:
                            known.clear()
                        known[word] = terms
                    for term in terms:
                        found[term] += n
                for term, n in found.items():
                    once[term] += 1
                    times[term] += min(n, 5)
                    if n > 1:
                        twice[term] += 1
        terms = list(once)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in (once, twice, times))], names=["term", "once", "twice", "times"])

    parts = rows.select("text").mapInArrow(count, "term string, once bigint, twice bigint, times bigint")
    return parts.groupBy("term").agg(*(F.sum(c).alias(c) for c in ("once", "twice", "times")))


def telling(k1: int, n1: int, k0: int, n0: int) -> float:
    """Signed root of the likelihood ratio of two shares k1 / n1 and k0 / n0."""

    def fit(k: int, n: int, p: float) -> float:
        return (k * np.log(p) if k else 0.0) + ((n - k) * np.log1p(-p) if n > k else 0.0)

    if not n1 or not n0:
        return 0.0
    both = (k1 + k0) / (n1 + n0)
    gain = fit(k1, n1, k1 / n1) + fit(k0, n0, k0 / n0) - fit(k1, n1, both) - fit(k0, n0, both)
    return float(np.sign(k1 * n0 - k0 * n1) * np.sqrt(max(2 * gain, 0.0)))


def chosen_terms(toxic: dict[str, tuple], clean: dict[str, tuple], n1: int, n0: int, words1: int, words0: int, least: float, min_weight: float, max_terms: int) -> dict[str, float]:
    """Weights of the terms taken. toxic, clean: (once, twice, times) of each term."""
    ranked = []
    for term, (once, twice, times) in toxic.items():
        o, t, m = clean.get(term, (0, 0, 0))
        value = max(telling(once, n1, o, n0), telling(twice, n1, t, n0))
        if value >= least:
            ranked.append((-value, not term.endswith(" "), -len(term), term, np.log((times + 0.5) / words1) - np.log((m + 0.5) / words0)))
    taken: dict[str, float] = {}
    begun: set[str] = set()  # all beginnings of the terms taken
    for *_, term, weight in sorted(ranked):
        if weight >= min_weight and len(taken) < max_terms and term not in begun and not any(term[:k] in taken for k in range(1, len(term))):
            taken[term] = float(weight)
            begun.update(term[:k] for k in range(1, len(term) + 1))
    return taken


def exception_phrases(rows: DataFrame, terms: dict[str, float], least: float) -> tuple[str, ...]:
    """Phrases of a hit's word and a neighbour that stand in clean documents clearly more often than the hit does elsewhere."""
    shared = rows.sparkSession.sparkContext.broadcast(Lexicon(terms))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        found: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                held = set()
                for part in folded(text):
                    for number, start, _ in matcher.hits(part):
                        stop = part.index(" ", start + 1)
                        before = part.rfind(" ", 0, start) if start else -1
                        after = part.find(" ", stop + 1)
                        held.add((matcher.terms[number], ""))
                        if before >= 0:
                            held.add((matcher.terms[number], part[before : stop + 1]))
                        if after >= 0:
                            held.add((matcher.terms[number], part[start : after + 1]))
                found.update((*h, toxic) for h in held)
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([found[k] if k[2] else 0 for k in keys], pa.int64()), pa.array([0 if k[2] else found[k] for k in keys], pa.int64())], names=["term", "phrase", "toxic", "clean"])

    counts = rows.mapInArrow(count, "term string, phrase string, toxic bigint, clean bigint").groupBy("term", "phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    rows = counts.filter("phrase = '' OR clean >= 3 AND clean > 4 * toxic").collect()
    alone = {r.term: (r.toxic, r.clean) for r in rows if not r.phrase}
    out = set()
    for r in rows:
        if not r.phrase:
            continue
        toxic, clean = alone[r.term]
        if telling(r.clean, clean, r.toxic, toxic) >= least:
            out.add(r.phrase)
    return tuple(sorted(out))


def fitted(features: np.ndarray, toxic: np.ndarray, penalty: float = 1e-2) -> tuple[float, float, float, float]:
    """Coefficients of a logistic regression by Newton steps."""
    beta = np.zeros(features.shape[1])
    ridge = penalty * np.eye(len(beta))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ beta, -30, 30)))
        step = np.linalg.solve((features * (p * (1 - p) + 1e-9)[:, None]).T @ features + ridge, features.T @ (toxic - p) - ridge @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = 100_000, max_terms: int = 2048, least: float = 4.5, min_weight: float = 1.0, min_share: float = 0.002, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """The lexicon of the labelled documents (labels: doc_id, toxic)."""
    rows = stored(labelled(texts_of(docs, id_col, text_col), labels, max_labelled), "labelled")
    n_words = F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"))
    sizes = {r.toxic: (r.n, r.words) for r in rows.groupBy("toxic").agg(F.count("*").alias("n"), F.sum(n_words).alias("words")).collect()}
    (n1, words1), (n0, words0) = sizes.get(True, (0, 0)), sizes.get(False, (0, 0))
    if not n1 or not n0:
        return Lexicon()
    often = max(3, int(np.ceil(min_share * n1)))
    toxic = {r.term: (r.once, r.twice, r.times) for r in _counted(rows.filter("toxic"), None).filter(F.col("once") >= often).collect()}
    clean = {r.term: (r.once, r.twice, r.times) for r in _counted(rows.filter("NOT toxic"), list(toxic)).collect()}
    terms = chosen_terms(toxic, clean, n1, n0, words1, words0, least, min_weight, max_terms)
    draft = Lexicon(terms, exception_phrases(rows, terms, least))
    shared = rows.sparkSession.sparkContext.broadcast(draft)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for batch in batches:
            found = [matcher.features(*matcher.count(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column("toxic")], names=["x", "toxic"])

    # at most max_labelled rows of five numbers
    table = rows.mapInArrow(measured, "x array<double>, toxic boolean").toPandas()
    points = np.column_stack([np.array(table.x.tolist()), table.toxic.to_numpy(dtype=float)])
    points = points[np.lexsort(points.T)]  # the sums do not depend on the order of arrival
    return Lexicon(draft.terms, draft.exceptions, fitted(points[:, :-1], points[:, -1]))


def score_texts(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_words, n_hits and the terms hit, of every row."""
    docs = texts_of(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for batch in batches:
            found = [matcher.count(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([matcher.score(c, n) for c, n in found], pa.float64()), pa.array([n for _, n in found], pa.int64()),
                    pa.array([sum(c.values()) for c, _ in found], pa.int64()), pa.array([sorted(matcher.terms[k].strip() for k in c) for c, _ in found], pa.list_(pa.string())),
                ],
                names=["doc_id", "score", "n_words", "n_hits", "terms"],
            )

    return docs.mapInArrow(scored, "doc_id bigint, score double, n_words bigint, n_hits bigint, terms array<string>")
