import random

import public_tokenizers
import pytest

from tabloom.llm import pretokens
from tabloom.llm.pretokens import PieceCoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "the", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "'LL", "don't", "x'velvet", "12", "é", "ñandú", "!!", "...", "&&&", " ", "　", "漢字", "ß", "😀", "١٢", "½",
         "​", "᠎", "\x1c", "\x85", "\r\n", "<|endoftext|>", "\U0001fae0", "İ", "_", "á", "supercalifragilisticexpialidocious" * 3, "zq" * 40, " "]


@pytest.fixture(scope="module")
def own():
    return PieceCoder(PATH, bits=8)


def check(own, texts):
    flat, counts = own.encode(texts)
    at = 0
    for text, n in zip(texts, counts, strict=True):
        want = own.tokenizer.encode(text or "", add_special_tokens=False).ids
        assert flat[at : at + n].tolist() == want, repr(text)
        at += n
    assert at == len(flat)


def test_random_mixtures_equal_the_library(own):
    rng = random.Random(5)
    check(own, ["".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 14))) for _ in range(4000)] + [None, "", " ", "\n\n"])


def test_long_texts_are_cut_where_the_pattern_cuts(own, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(pretokens, "STEP", 50)
    check(own, [" ".join(rng.choice(PARTS) for _ in range(400)) for _ in range(20)] + ["x" * 500, "   " * 300])
