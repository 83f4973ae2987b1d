import numpy as np

from airmetrics.llm import common
from tests.llm.helpers import words


def test_words_are_hashed_alike_wherever_they_stand():
    one, two = common.word_hashes("Été, the fox_1"), common.word_hashes("fox_1 THE été")
    assert one.tolist() == two.tolist()[::-1]


def test_words_match_a_regular_expression():
    for text in ("", None, "?!", "a", "Zu und. Dieüauß 42!", "x" * 50, "日本 語 text", "\ud800 lone"):
        assert len(common.word_hashes(text)) == len(words(text))


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = " ".join(f"word{k}" for k in range(500))
    whole = common.word_hashes(text)
    monkeypatch.setattr(common, "PIECE_CHARS", 37)
    assert np.array_equal(common.word_hashes(text), whole)


def test_short_texts_have_one_shingle():
    assert len(common.shingle_set("one two three")) == 1
    assert len(common.shingle_set("a b c d e f")) == 2
    assert len(common.shingle_set("...")) == 0
