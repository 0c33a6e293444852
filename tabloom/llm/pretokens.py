"""Vectorised byte-level BPE encoding: pieces are found with numpy, each distinct piece is encoded once per worker.

The tokenizers library splits a text by a pattern into pieces (pre-tokens) and merges within a piece only, so the
ids of a text are the ids of its pieces, one after the other. `split_pieces` finds the pieces of many texts at once
from the classes of their characters; `PieceCoder` looks them up by a 64-bit fingerprint in a fixed-size cache and
asks the library for the rest. Texts with a special token in them, or with characters whose class changed between
Unicode versions, are encoded whole by the library, so the result never depends on this module's tables.
"""

from __future__ import annotations

import copy
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np

LETTER, NUMBER, OTHER, SPACE, UNSURE = range(5)
#: Characters per vectorised step; longer texts are cut where the pattern always cuts.
STEP = 1 << 18
#: Widest piece, in ids, that the cache holds; wider ones are encoded again in each step.
WIDE = 10
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_SAFE_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
_tables: dict[str, np.ndarray] = {}
# The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def kinds() -> np.ndarray:
    """Class of every code point; UNSURE where an old and the present Unicode table differ."""
    if "kinds" not in _tables:
        old = unicodedata.ucd_3_2_0
        table = np.full(0x110000, UNSURE, dtype=np.uint8)
        group = {"L": LETTER, "N": NUMBER, "Z": SPACE}
        for code in range(0x110000):
            c = chr(code)
            category = unicodedata.category(c)
            if category == old.category(c) and category != "Cn":
                table[code] = group.get(category[0], OTHER)
        table[[9, 10, 11, 12, 13]] = SPACE
        table[[0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0x180E, 0x200B]] = UNSURE
        _tables["kinds"] = table
    return _tables["kinds"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and their inverses."""
    if len(_tables.get("powers", ())) < n:
        size = max(n, STEP + 1)
        with np.errstate(over="ignore"):
            for name, base in (("powers", _MULTIPLIER), ("inverses", pow(_MULTIPLIER, -1, 1 << 64))):
                values = np.full(size, base, dtype=np.uint64)
                values[0] = 1
                _tables[name] = np.multiply.accumulate(values)
    return _tables["powers"], _tables["inverses"]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the spans [start, end) of small integers, from one prefix sum."""
    powers, inverses = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers[: len(values)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def split_pieces(codes: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Start of every piece. codes: code points of all texts; first: the places where texts begin."""
    n = len(codes)
    begins = np.zeros(n, dtype=bool)
    begins[first] = True
    run = begins.copy()
    run[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    piece = run & space
    word = np.flatnonzero(run & ~space)
    after_space = np.zeros(len(word), dtype=bool)
    inner = (word > 0) & ~begins[word]
    after_space[inner] = space[word[inner] - 1]
    piece[word[after_space] - 1] = True  # the last space stands alone or leads the word
    joined = after_space.copy()
    joined[after_space] = codes[word[after_space] - 1] == 32
    piece[word[~joined]] = True
    # 's 't 'm 'd 're 've 'll begin at an apostrophe that begins a piece and stand before the rest of the letters
    for i in word[(codes[word] == 39) & ~joined]:
        if i + 1 < n and not begins[i + 1] and kind[i + 1] == LETTER:
            one = chr(codes[i + 1])
            two = one + chr(codes[i + 2]) if i + 2 < n and not begins[i + 2] else one
            size = 2 if one in "stmd" else 3 if two in ("re", "ve", "ll") else 0
            if size:
                piece[i + 1] = False
                if i + size < n:
                    piece[i + size] = True
    return np.flatnonzero(piece)


def safe_parts(text: str) -> list[str]:
    """A long text in parts of about STEP characters, cut before a space between two letters."""
    parts, at = [], 0
    while len(text) - at > STEP:
        cut = _SAFE_CUT.search(text, at + STEP)
        if not cut:
            break
        parts.append(text[at : cut.start()])
        at = cut.start()
    parts.append(text[at:])
    return parts


class Pieces:
    """The pieces of a list of texts: fingerprints, and for each piece the text it belongs to."""

    def __init__(self, texts: list[str]):
        self.joined = "".join(texts)
        codes = np.frombuffer(self.joined.encode("utf-32-le"), dtype=np.uint32)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        begins = np.cumsum(lengths) - lengths
        kind = kinds()[codes]
        unsure = np.zeros(len(texts), dtype=bool)
        if (odd := np.flatnonzero(kind == UNSURE)).size:
            unsure[np.searchsorted(begins + lengths, odd, side="right")] = True
        self.whole = unsure  # texts for the library itself
        self.starts = split_pieces(codes, kind, begins[lengths > 0]) if len(codes) else np.zeros(0, dtype=np.int64)
        self.ends = np.append(self.starts[1:], len(codes)) if len(self.starts) else self.starts
        self.hashes = span_hashes(codes, self.starts, self.ends)
        self.bounds = np.searchsorted(self.starts, np.append(begins, len(codes)))  # of each text in the list of pieces

    def string(self, i: int) -> str:
        return self.joined[self.starts[i] : self.ends[i]]

    def some(self, which: np.ndarray) -> Pieces:
        """Only these pieces, for a lookup."""
        part = copy.copy(self)
        part.starts, part.ends, part.hashes = self.starts[which], self.ends[which], self.hashes[which]
        return part


class PieceCoder:
    """Ids of texts as the tokenizers library gives them, through a cache of fixed size.

    A piece has two places in the cache, one for each end of its fingerprint; a piece whose places are taken is
    encoded once per step instead. Null counts as the empty text.
    """

    def __init__(self, path: str, bits: int = 21):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = re.compile("|".join(re.escape(t.content) for t in added.values())) if added else None
        self.bits = np.uint64(bits)
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.lens = np.zeros(1 << bits, dtype=np.uint8)
        self.ids = np.zeros((1 << bits, WIDE), dtype=self.dtype)

    def library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def encode_piece(self, piece: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(BYTE_CHARS))]

    def slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two places where a piece may be."""
        return (h >> (np.uint64(64) - self.bits)).astype(np.int64), (h & np.uint64((1 << int(self.bits)) - 1)).astype(np.int64)

    def _keep(self, h: np.ndarray, n: np.ndarray, table: np.ndarray) -> None:
        """Put new pieces into free places; what finds none is encoded again when it comes again."""
        left = np.flatnonzero(n <= WIDE)
        for which in (0, 1):
            place = self.slots(h[left])[which]
            free = self.lens[place] == 0
            self.keys[place[free]] = h[left[free]]
            won = free & (self.keys[place] == h[left])  # of two for one place the last has it
            self.lens[place[won]], self.ids[place[won]] = n[left[won]], table[left[won]]
            left = left[~won]

    def lookup(self, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, dict[int, list[int]]]:
        """For each piece its number of ids and the ids; those of the wide ones apart."""
        h = pieces.hashes
        place, second = self.slots(h)
        miss = np.flatnonzero((self.keys[place] != h) | (self.lens[place] == 0))
        place[miss] = second[miss]
        miss = miss[(self.keys[place[miss]] != h[miss]) | (self.lens[place[miss]] == 0)]
        lens = self.lens[place].astype(np.int64)
        rows = self.ids[place]
        wide: dict[int, list[int]] = {}
        if miss.size:
            fresh, at, back = np.unique(h[miss], return_index=True, return_inverse=True)
            found = [self.encode_piece(pieces.string(i)) for i in miss[at]]
            n = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            table = np.zeros((len(found), WIDE), dtype=self.dtype)
            short = n <= WIDE
            few = [x for x in found if len(x) <= WIDE]
            table[np.repeat(np.flatnonzero(short), n[short]), np.concatenate([np.arange(len(x)) for x in few] or [n[:0]])] = np.fromiter((i for x in few for i in x), dtype=self.dtype, count=int(n[short].sum()))
            lens[miss], rows[miss] = n[back], table[back]
            for k in np.flatnonzero(~short[back]):
                wide[int(miss[k])] = found[back[k]]
            self._keep(fresh, n, table)
        return lens, rows, wide

    def encode_step(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts, and their numbers of ids."""
        pieces = Pieces(texts)
        lens, rows, wide = self.lookup(pieces)
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        if wide:
            flat = np.empty(total, dtype=self.dtype)
            small = lens <= WIDE
            mask = np.arange(WIDE) < lens[small][:, None]
            flat[((ends - lens)[small][:, None] + np.arange(WIDE))[mask]] = rows[small][mask]
            for i, ids in wide.items():
                flat[ends[i] - lens[i] : ends[i]] = ids
        else:
            flat = rows[np.arange(WIDE) < lens[:, None]]
        bounds = np.append(0, ends)[pieces.bounds]
        counts = np.diff(bounds)
        for i in np.flatnonzero(pieces.whole):
            own = self.library(texts[i])
            at = counts[:i].sum()
            flat = np.concatenate([flat[:at], own, flat[at + counts[i] :]])
            counts[i] = len(own)
        return flat, counts

    def steps(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[str], bool]]:
        """Positions and texts of about STEP characters together. The last value is true for a text that holds a special
        token, which goes to the library whole. Null is the empty text and comes in no step."""
        step: list[str] = []
        owner: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            special = bool(self.special and self.special.search(text))
            for part in (text,) if special or len(text) <= STEP else safe_parts(text):
                if step and (special or size + len(part) > STEP):
                    yield owner, step, False
                    owner, step, size = [], [], 0
                if special:
                    yield [i], [part], True
                else:
                    owner.append(i)
                    step.append(part)
                    size += len(part)
        if step:
            yield owner, step, False

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts, and their numbers of ids."""
        flats = [np.zeros(0, dtype=self.dtype)]
        counts = np.zeros(len(texts), dtype=np.int64)
        for owner, step, special in self.steps(texts):
            if special:
                flat = self.library(step[0])
                n = np.array([len(flat)])
            else:
                flat, n = self.encode_step(step)
            flats.append(flat)
            np.add.at(counts, owner, n)
        return np.concatenate(flats), counts


_coders: dict[str, PieceCoder] = {}


def coder(path: str) -> PieceCoder:
    """The worker's coder; it stays for later tasks."""
    if path not in _coders:
        _coders[path] = PieceCoder(path)
    return _coders[path]
