"""Ids are those of the library with the file as it is, added tokens included."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from wavefold.llm import codec, packing, rangecoder
from wavefold.llm.tokens import Encoder, encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")]
FRESH = {p: Tokenizer.from_file(p) for p in PATHS}
TEXT = "x  <|endoftext|>  y<|startoftext|>z\t<|ENDOFTEXT|> <|endoftext|><|endoftext|>\n"


def library(path, text):
    return np.array(FRESH[path].encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|", "endoftext", "|>", " ", "  ", "\n", "x", "É", "é", "'s", "7", "汉"]), max_size=12))
def test_added_tokens_are_the_library_s(parts):
    text = "".join(parts)
    for path in PATHS:
        assert encoder(path).encode([text, None, "a b"]) == [library(path, text), b"", library(path, "a b")]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abszÉéÀßÿ×÷Þ'rveml tdS01$!-\n\t\x0b\x1d\xa0\u2003Ωœ", max_size=30), st.lists(st.sampled_from(["it's", "'s", "$'s", "IT'LL", "we've'd", "1's", "é'rex", "''m", " 're", "a1b22", "x'"]), max_size=4))
def test_words_of_latin_texts_are_the_library_s(text, more):
    both = [text, " ".join(more), text + "".join(more), None]
    for path in PATHS:
        assert encoder(path).encode(both) == [library(path, t) if t else b"" for t in both]


@settings(max_examples=800, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet="aBé 's1$\n\t", max_size=14), st.text(alphabet=" \n\r\t", max_size=6), st.sampled_from(["'ll", " 'll x", "\n've ", "0'd1", "'' s"])), max_size=5))
def test_white_space_of_latin_texts_is_the_library_s(texts):
    for path in PATHS:
        assert encoder(path).encode([*texts, "".join(texts)]) == [library(path, t) for t in [*texts, "".join(texts)]]


def test_long_words_and_texts_are_the_library_s():
    texts = ["ab" * 400_000 + " don't", "x " * 300_000 + "É" * 1000, "end"]
    for path in PATHS:
        assert encoder(path).encode(texts) == [library(path, t) for t in texts]


def test_added_ids_are_given():
    for path, name, end in zip(PATHS, ("byte", "word"), (50256, 49407), strict=True):
        assert np.frombuffer(encoder(path).encode([TEXT])[0], "<u4").tolist().count(end) == 3, name


def test_files_whose_added_tokens_are_normalised_are_encoded_whole(tmp_path):
    path = str(tmp_path / "t.json")
    t = Tokenizer.from_file(PATHS[1])
    t.add_tokens(["Foo bar"])
    t.save(path)
    text = "a foo  bar FOO BAR b"
    assert Encoder(path).encode([text]) == [np.array(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()]


def test_packing_and_token_files_hold_them(spark):
    d = spark.createDataFrame([(1, TEXT), (2, "plain words")], "doc_id long, text string")
    ids = {p: {k: library(p, t) + np.array([2], "<u4").tobytes() for k, t in ((1, TEXT), (2, "plain words"))} for p in PATHS}
    assert {r.doc_id: r.ids_crc32 for r in packing.pack(d, PATHS[0], 1024).collect()} == {k: zlib.crc32(x) for k, x in ids[PATHS[0]].items()}
    assert {r.doc_id: r.ids_crc32 for r in codec.round_trip(d, PATHS[1]).collect()} == {k: zlib.crc32(x) for k, x in ids[PATHS[1]].items()}


def test_known_words_are_found_by_the_table_alone(monkeypatch):
    import wavefold.llm.tokens as tokens

    texts = ["don't stop  12 words é" + " abcdefghijklmnop" * 3 + f" w{k}x" * 3 + "\n" for k in range(50)]
    for path in PATHS:
        e = tokens.Encoder(path)
        first = e.encode(texts)
        with monkeypatch.context() as m:
            for name in ("unique", "argsort") if path == PATHS[1] else ("unique",):  # no order of words is asked for
                m.setattr(np, name, None)
            m.setattr(e, "_encoded", None)
            assert e.encode(texts[::-1])[::-1] == first == [library(path, t) for t in texts]


def test_tables_of_words_grow_and_keep_words_of_one_hash_apart(monkeypatch):
    import wavefold.llm.tokens as tokens

    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in rng.integers(1, 60, 40_000)]
    some = " ".join(words)
    plain = tokens.run_hashes
    for bits in (64, 14):  # as it is, and with many words of one hash
        monkeypatch.setattr(tokens, "run_hashes", lambda *a, b=bits: plain(*a) >> np.uint64(64 - b))
        for path in PATHS:
            e = tokens.Encoder(path)
            assert e.encode([some, some[::-1], some]) == [library(path, t) for t in (some, some[::-1], some)]
            assert e.pool.bits > 16 and (len(e.pool.apart) > 10_000)
            assert e.encode([some]) == [library(path, some)]


def test_carries_are_added_for_all_blocks_of_a_step_at_once(monkeypatch):
    x, calls, plain, block = np.random.default_rng(5).zipf(1.3, 100_000) % 3000, [], rangecoder._carry, rangecoder.BLOCK
    monkeypatch.setattr(rangecoder, "_carry", lambda *a: (calls.append(1), plain(*a))[1])
    monkeypatch.setattr(rangecoder, "BLOCK", 64)
    t, blocks = rangecoder.encode(x)
    assert len(blocks) == -(-len(x) // 64) and len(calls) <= 64 + 1 < block
    assert (rangecoder.decode(t, blocks) == x).all()
    words = np.array([5, 0xFFFFFFFF, 0xFFFFFFFF, 9, 1, 2, 3, 4], "<u4")
    plain(words, np.array([3, 7]))
    assert words.tolist() == [6, 0, 0, 9, 1, 2, 4, 4]
    with pytest.raises(ValueError):
        rangecoder.decode(t, [(blocks[0][0] - 1, *blocks[0][1:]), *blocks[1:]])
