from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabgate.llm.tokens import Encoder, encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def whole(text: str) -> list[int]:
    return encoder(PATH).tokenizer.encode(text, add_special_tokens=False).ids


def ids_of(texts: list) -> list[list[int]]:
    ids, offsets = encoder(PATH).encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t\r'sé.,<|>ABcd09ß  \x1c日"), st.characters(exclude_categories=["Cs"]))), max_size=6))
def test_ids_are_those_of_whole_texts(texts):
    assert ids_of(texts) == [whole(t) + [0] for t in texts]


@pytest.mark.parametrize("text", [
    "", " ", "  two  spaces ", "a \nb", "a\n b", "tab\t x", "it's they're I'll", "<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|> y",
    "één-twee 12.5% C'est l'été", "é" * 500, "1 " * 300, "日本 語", "x y z", "f\x0b g",
])
def test_cases(text):
    assert ids_of([text, None, text]) == [whole(text) + [0], [0], whole(text) + [0]]


def test_words_are_dropped_at_the_bound(monkeypatch):
    monkeypatch.setattr("tabgate.llm.tokens.KEPT_WORDS", 3)
    for word in ("one two three four five", "six seven eight nine"):
        assert ids_of([word, word]) == [whole(word) + [0]] * 2


def test_no_texts():
    ids, offsets = encoder(PATH).encode(pa.array([], pa.string()))
    assert len(ids) == 0 and np.array_equal(offsets, [0])


def test_words_of_one_token_share_its_bytes():
    """Kept words hold no bytes of their own for an id; line feeds and letters beyond ASCII are written as before."""
    e = Encoder(PATH)
    first, again = e.encode_words([" the", "the"]), e.encode_words([" the"])
    assert first[0] is e.ids[int.from_bytes(first[0], "little")] and again[0] is first[0]
    for word in (" the", "the\nend", " caf\u00e9", " x\n", " a1b"):
        want = e.tokenizer.encode(word, add_special_tokens=False).ids
        assert b"".join(i.to_bytes(4, "little") for i in want) == e.encode_words([word])[0]
