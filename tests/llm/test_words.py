"""Word hashes and tables, token ids by words, the merge agenda, binary frames."""

import io
import random
import struct

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelnet.llm import sentence_pieces, token_records, word_tokens, words

ODD = ["", " ", "  ", "a ", " a", " a  b ", "▁", "a▁b", "\n", "\n\n a", "x\ty", "日本語 テキスト", "😀 a😀", "<s> </s>", "<0x41> a", "á é", "\x00b", "     lots    of     space   ", "<|endoftext|> x", "A'S it's IT'RE", "ΣΑΣ σας", "Ǆ İ", "\x1cx y\x1d", "1234 5.67", "don't!!$$$ a_b", "ﬁ ﷺ", "a　b", "x" * 300]
TEXT = st.text(st.sampled_from(list("abcdeéßAB 12.,▁\n'<>|$ \tñ語😀")), max_size=60)


@pytest.fixture(scope="module")
def coder():
    return sentence_pieces.pieces(public_tokenizers.path(sentence_pieces.MODEL))


@pytest.fixture(scope="module")
def ids():
    return word_tokens.word_ids(word_tokens.vocabulary_path())


def _same_pieces(coder, text):
    got = coder.encode([text])[0].tolist()
    assert got == coder.library.encode(text)
    assert coder.decode(got).decode() == coder.library.decode(got)


@pytest.mark.parametrize("text", ODD)
def test_agenda_is_the_library(coder, text):
    _same_pieces(coder, text)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_agenda_is_the_library_on_any_text(coder, text):
    _same_pieces(coder, text)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_word_ids_are_the_library(ids, text):
    want = ids.library.encode(text, add_special_tokens=False).ids
    assert ids.ids(ids.words([text])[0], 1).tolist() == [*want, 1]


def test_many_texts_at_once(ids, coder):
    want = [ids.library.encode(t, add_special_tokens=False).ids for t in ODD]
    assert [ids.ids(w, 2)[:-1].tolist() for w in ids.words(ODD)] == want
    assert [x.tolist() for x in coder.encode(ODD)] == [coder.library.encode(t) for t in ODD]


def test_a_wrong_score_is_noticed():
    wrong = sentence_pieces.Pieces(public_tokenizers.path(sentence_pieces.MODEL))
    wrong.score["th"], wrong.score["he"] = -1e6, 0.0
    assert wrong.merge("▁weather") == ["▁weather"]  # other merges, the same pieces: nothing to notice
    assert wrong.merge("▁lighthouse") != wrong.library.encode("lighthouse", out_type=str)
    with pytest.raises(ValueError, match="differ"):
        wrong.encode(["the lighthouse"])


def test_hash_words_against_split():
    r = random.Random(5)
    texts = ["".join(r.choice("ab \n\té") for _ in range(r.randrange(0, 400))).encode() for _ in range(40)] + [b"q" * 3_000_000 + b" end", b"w" * 70 + b" " + b"w" * 70]
    buf, starts, ends, h, first = words.hash_words(texts, words.separators(words.ASCII_SPACE))
    seen = {}
    for i, t in enumerate(texts):
        got = [buf[a:b] for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])]
        assert got == t.split()
        for w, x in zip(got, h[first[i] : first[i + 1]]):
            assert seen.setdefault(w, int(x)) == int(x)
    assert len(set(seen.values())) == len(seen)


def test_word_table_grows():
    table, r = words.WordTable(bits=4), np.random.default_rng(1)
    h = np.unique(r.integers(0, 1 << 64, 3000, dtype=np.uint64))
    table.reserve(len(h))
    assert (table.add(h) == np.arange(len(h))).all() and (table.find(h) == np.arange(len(h))).all()
    assert (table.find(h + np.uint64(1)) < 0).sum() >= len(h) - 5


def test_frames_notice_damage():
    payload = b"some ids"
    data = token_records.frame(payload)
    assert data[:8] == struct.pack("<Q", 8) and token_records.read_frame(io.BytesIO(b"zz" + data), 2) == payload
    for i in range(len(data)):
        bad = bytearray(data)
        bad[i] ^= 1
        with pytest.raises(ValueError):
            token_records.read_frame(io.BytesIO(bytes(bad)))
    with pytest.raises(ValueError):
        token_records.read_frame(io.BytesIO(data[:-1]))
    out = io.BytesIO()
    token_records.write_index(out, 2, [3, None, -5], [0, 30, 70], [5, 0, 9])
    width, ids, offsets, counts = token_records.read_index(out.getvalue())
    assert (width, ids, offsets.tolist(), counts.tolist()) == (2, [3, None, -5], [0, 30, 70], [5, 0, 9])
    with pytest.raises(ValueError):
        token_records.read_index(out.getvalue()[:-1] + b"x")


def test_table_has_slots_for_the_words_it_holds():
    table, r = words.WordTable(bits=22), np.random.default_rng(2)
    assert table.keys.nbytes + table.values.nbytes < 4 << 20  # was 48 MB for the first word
    h = np.unique(r.integers(0, 1 << 63, 400_000, dtype=np.uint64) * np.uint64(2))
    number = np.concatenate([table.add(part) for part in np.array_split(h, 7)])
    assert number.tolist() == list(range(len(h))) and (table.find(h) == number).all() and (table.find(h + np.uint64(1)) == -1).all()
    assert table.bits == 20 and table.room() == int(0.55 * (1 << 22)) - len(h)
    table.clear()
    assert table.bits == 18 and (table.find(h[:100]) == -1).all()
