"""The word encoder asks the library for few words, and answers as it does."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from codeloom.llm import planes

PATH = public_tokenizers.path("word_bpe_49k.json")
MARKS = ["'", "''", ".", "?!", "$$$", "_", "-", "`", "\\", "|", ">", "<", "|>", "̸", "́", "]", '"', "'.", "\x1c", "²", "="]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@given(st.lists(st.tuples(st.sampled_from(["a", "don't", "we'LL", "x'", "ñé", "é", "ß", "İ", "Œ", "ª", "7", "a1", "ΑΣ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "日本", "(a", "ab_cd", ""]), st.lists(st.sampled_from(MARKS), max_size=3), st.sampled_from([" ", "", "\n", "s "])), max_size=8))
@settings(max_examples=25, deadline=None)
def test_words_with_marks_equal_library(library, parts):
    text = "".join(base + "".join(marks) + space for base, marks, space in parts)
    got = next(planes.WordEncoder(PATH)([text.encode()]))
    assert got.tolist() == library.encode(text, add_special_tokens=False).ids


def test_forgotten_words_equal_library(library, monkeypatch):
    monkeypatch.setattr(planes.WordEncoder, "KEPT", 5)
    encoder = planes.WordEncoder(PATH)
    texts = [" ".join(f"{chr(97 + (i * k) % 26)}word{'é' * (k % 2)}{'.,!'[: k % 4]}" for k in range(40)) for i in range(6)]
    assert [x.tolist() for x in encoder([t.encode() for t in texts])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_marks_are_asked_for_once():
    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer, self.model, self.calls = tokenizer, tokenizer.model, 0

        def encode(self, *args, **options):
            self.calls += 1
            return self.tokenizer.encode(*args, **options)

    encoder = planes.WordEncoder(PATH)
    encoder.tokenizer = counted = Counted(encoder.tokenizer)
    text = " ".join(f"{a}{b}{c}{end}" for a in "abcdé" for b in "abcdé" for c in "abcdé" for end in ("###", "!!", ",&&&"))
    assert next(encoder([text.encode()])).tolist() == counted.tokenizer.encode(text, add_special_tokens=False).ids
    assert counted.calls <= 3
