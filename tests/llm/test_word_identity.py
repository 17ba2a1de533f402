"""Words that a hash linear in its bytes can't tell apart: Thue-Morse words and their complements, in every operator."""

import hashlib

import numpy as np
import pytest

from wavefold.llm import _common, codec, decontaminate, neardup, packing, substrings, wordlm
from wavefold.llm.tokens import encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SIZES = (8, 16, 48, 56, 1024, 2048, 4096)


def twins(n: int) -> tuple[str, str]:
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", SIZES)
def test_hashes_and_ids(n):
    x, y = twins(n)
    for kind in (_common.SPACED, _common.LETTERS):
        for seed in (0, 1):
            h = kind.hashes([f"{x} {y} {x}"], seed)[0]
            assert h[0] == h[2] != h[1]
        assert kind.hashes([x])[0][0] != kind.hashes([x], 1)[0][0]
    for path in (BYTE, WORD):
        e = encoder(path)
        assert e.encode([f"{x} q", f" {y}", x]) == [np.array(e.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in (f"{x} q", f" {y}", x)]


def test_words_of_one_hash_are_told_apart_by_their_bytes(monkeypatch):
    import wavefold.llm.tokens as tokens

    monkeypatch.setattr(tokens, "run_hashes", lambda raw, start, end: (end - start).astype(np.uint64))
    for path in (BYTE, WORD):
        e = tokens.Encoder(path)
        texts = ["one two six ten " + " ".join(twins(64)), "two one", "abcdefghij abcdefghik"]
        assert e.encode(texts) == [np.array(e.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("n", (1024, 4096))
def test_operators(spark, n):
    x, y = twins(n)
    docs = spark.createDataFrame([(1, " ".join([x] * 20)), (2, " ".join([y] * 20)), (3, x), (4, y)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, x)], "item_id long, text string")
    e = encoder(WORD)
    ids = {r.doc_id: np.append(np.frombuffer(e._one(r.text), "<u4"), 2).astype("<u4") for r in docs.collect()}
    import zlib

    got = codec.round_trip(docs, WORD, end_id=2).collect()
    assert {r.doc_id: r.ids_crc32 for r in got} == {k: zlib.crc32(v.tobytes()) for k, v in ids.items()}
    got = packing.pack(docs.where("doc_id > 2"), BYTE, 8192, end_id=2).collect()
    assert len({r.ids_crc32 for r in got}) == 2
    assert {r.doc_id: r.contaminated for r in decontaminate.decontaminate(docs, bench).collect()} == {1: True, 2: False, 3: True, 4: False}
    kept = {r.doc_id: (r.n_removed, r.kept_sha256) for r in substrings.deduplicate(docs).collect()}
    assert kept[2] == (0, hashlib.sha256(" ".join([y] * 20).encode()).hexdigest())
    near = {r.doc_id: (r.class_id, r.n_copies) for r in neardup.near_duplicates(docs).collect()}
    assert near == {k: (k, 1) for k in (1, 2, 3, 4)}
    target = spark.createDataFrame([(1,)], "doc_id long")
    score = {r.doc_id: r.score for r in wordlm.score(docs, target).collect()}
    assert score[3] < score[4]
