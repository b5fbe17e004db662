import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ridemill.llm import pretokens, spans

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PIECES = st.sampled_from([" ", "  ", "\n", "\t", "'s", "'re", "'", "''ll", "'lx", "a", "Zoë", "ß", "12", "½", "!!", "…", " ", "\u0085", "漢字", "🙂",
                          "<|endoftext|>", "᠎", "\u0000", "ǅ", "٣", "ẞ", " ", "\x1c", " 's", "x's's"])


def check(texts):
    ids, counts = pretokens.encoder(PATH).encode(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    for text, end, count in zip(texts, ends, counts):
        assert ids[end - count : end].tolist() == LIBRARY.encode(text or "", add_special_tokens=False).ids, text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), max_size=6))
def test_same_ids_as_the_library(texts):
    check(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=4))
def test_any_characters(texts):
    check(texts)


def test_every_character_between_letters_and_spaces():
    for block in range(0, 0x20000, 0x100):
        chars = [chr(c) for c in range(block, block + 0x100) if not 0xD800 <= c < 0xE000]
        check([f"a{c}{c}1 {c}b" for c in chars])


def test_nulls_empty_long():
    check([None, "", "x" * 70_000, "don't " * 9_000, None])
    check([])


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_pre_tokenisers_go_to_the_library(name):
    own, library = pretokens.Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    ids, counts = own.encode(pa.array(["Hello there", "", "x y"]))
    assert ids.tolist() == [i for t in ("Hello there", "", "x y") for i in library.encode(t, add_special_tokens=False).ids]


def test_full_memo(monkeypatch):
    monkeypatch.setattr(pretokens, "MEMO", 3)
    own = pretokens.Encoder(PATH)
    for text in ("one two three four five", "five six one", "six seven " + "y" * 80):
        assert own.encode(pa.array([text]))[0].tolist() == LIBRARY.encode(text).ids
    assert len(own.slot) <= 3


def test_code_points_and_words():
    texts = ["añ€🙂", "", " a  b\n", "c"]
    data, offsets = spans.flat(pa.array(texts))
    points, at = spans.code_points(data)
    assert "".join(map(chr, points)) == "".join(texts)
    starts, ends, counts = spans.words(data, offsets)
    assert [bytes(data[s:e]).decode() for s, e in zip(starts, ends)] == ["añ€🙂", "a", "b", "c"] and counts.tolist() == [1, 0, 2, 1]
