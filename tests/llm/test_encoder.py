import random

import pyarrow as pa
import pytest

from hapframe.llm import tokens

HARD = [
    "İ'x İ,b", "क़, a", "יִ'a", "don't DON'T x's We'Re", "a\tb\x0bc", "ŉ'a ǅ'b", "Ω'd ſ's K'x", "", "  \n ", "a\xa0b　c'd", "l'été d’un", "x" * 5000 + "!!",
    "a <|", "ß'ẞ'", "Å' ΐ'", "a\x01b \x01 c", "\x01", "№1'2", "각'x", "1,000.50 ...--", "A B\nA  B", "qzx" * 60,
]


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.vocabulary_path())


def check(encoder, texts):
    want = [e.ids for e in encoder.model.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    assert [ids.tolist() for ids in encoder.encode(pa.array(texts, pa.string()))] == want


def test_hard_texts(encoder):
    check(encoder, [None, *HARD])
    check(encoder, [])


def test_random_texts(encoder):
    pick = random.Random(5)
    signs = [chr(c) for c in [*range(32, 127), *range(32, 127), *range(0xA0, 0x250), *range(0x370, 0x530), *range(0x900, 0x970), 1, 0x1100, 0x1161, 0x212A]]
    check(encoder, ["".join(pick.choices(signs, k=120)) for _ in range(400)])


def test_small_cache_forgets_words_and_stays_right(encoder, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 7)
    pick = random.Random(6)
    for _ in range(20):
        check(encoder, [" ".join("".join(pick.choices("abc,1É", k=3)) for _ in range(40))])
    assert len(encoder.known) <= 7


@pytest.mark.parametrize("lost", ["plain", "between"])
def test_other_ways_agree(lost):
    other = tokens.Encoder(tokens.vocabulary_path())
    setattr(other, lost, None)
    if lost == "between":
        other.plain = False
    check(other, HARD)
