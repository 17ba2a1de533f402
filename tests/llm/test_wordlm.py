"""The word models of op2 against brute force; what they hold grows with the corpus and words of common letters count."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from wavefold.llm import wordlm

ROWS = [(1, "aa bb aa  cc"), (2, "bb aa"), (3, None), (4, ""), (5, "cc bb aa bb " * 9), (None, "aa dd"), (None, None), (2, "ee"), (6, "aa\tbb")]


def brute(rows, target):
    """Each text by the counts of the others."""
    word = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", t or ""), 0]
    pairs = lambda t: list(zip([0, *word(t)], word(t), strict=False))
    keep = (lambda i: i in target, lambda i: True)
    v = len({w for _, t in rows for w in word(t)} - {0})
    n = [sum(len(word(t)) for i, t in rows if t is not None and k(i)) for k in keep]
    scale = [1, min(1, n[0] / n[1]) if n[0] else 1]
    out = []
    for at, (i, t) in enumerate(rows):
        loss = []
        h, _ = wordlm.tokens([t])
        prev = np.concatenate([[wordlm._END], h[:-1]])
        keys = wordlm.mix((prev * wordlm._M + h) ^ np.uint64(2))
        for k, s in zip(keep, scale, strict=True):
            texts = [x for at_, (j, x) in enumerate(rows) if x is not None and k(j) and at_ != at]
            c1, c2 = Counter(w for x in texts for w in word(x)), Counter(p for x in texts for p in pairs(x))
            total = s * sum(c1.values())
            thin = (lambda c, key, s=s: wordlm.thin(np.array([c]), s, np.array([key]))[0]) if s < 1 else lambda c, key: c
            p = [(thin(c2[a, b], kp) + wordlm.PRIOR * (thin(c1[b], kw) + 1) / (total + v + 1)) / (s * c1[a] + wordlm.PRIOR) for (a, b), kw, kp in zip(pairs(t), h, keys, strict=True)]
            loss.append(-sum(map(math.log, p)) / len(p))
        out.append((-1 if i is None else i, len(word(t)), *loss, loss[0] - loss[1]))
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [4_000_000, 40])
@pytest.mark.parametrize("target", [{1, 2}, set(), {77}])
def test_scores_are_the_brute_force_ones(spark, monkeypatch, block_bytes, target):
    monkeypatch.setattr(wordlm, "BLOCK_BYTES", block_bytes)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    ids = spark.createDataFrame([(i,) for i in [*target, *target, None]], "doc_id long")
    got = sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in wordlm.score(docs, ids).collect())
    want = brute(ROWS, target)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w)


def test_thinned_counts_are_binomial():
    keys = np.arange(200_000, dtype=np.uint64)
    for n, p in ((1, 0.3), (5, 0.02), (40, 0.5), (900, 0.03), (3, 0.99)):
        x = wordlm.thin(np.full(len(keys), n), p, keys)
        assert x.mean() == pytest.approx(n * p, rel=0.03) and x.var() == pytest.approx(n * p * (1 - p), rel=0.03) and x.max() <= n
    assert abs(wordlm.thin(np.full(len(keys), 397), 0.25, keys).mean() - 99.25) < 0.01


def test_a_larger_background_of_the_same_kind_moves_no_score(spark):
    """Texts of one kind, of which 300 are the target: scores of others stay where they are with 1 and with 30 times as many."""
    rnd = random.Random(2)
    words = [f"w{k}" for k in range(3000)]
    weight = [1 / (k + 5) for k in range(3000)]
    text = lambda: " ".join(rnd.choices(words, weight, k=60))
    rows = [(k, text()) for k in range(9600)]
    mean = []
    for n in (600, 9600):
        docs = spark.createDataFrame(rows[:n], "doc_id long, text string")
        s = {r.doc_id: r.score for r in wordlm.score(docs, docs.where("doc_id < 300")).collect()}
        mean.append(np.mean([s[k] for k in range(300, 600)]))
    assert abs(mean[0] - mean[1]) < 0.01 and abs(mean[0]) < 0.02, mean


def test_a_text_that_occurs_twice_is_told_apart(spark):
    rnd = random.Random(5)
    rows = [(k, " ".join(f"{rnd.randrange(9**7):x}" for _ in range(40))) for k in range(300)]
    docs = spark.createDataFrame([*rows, *((1000 + k, t) for k, t in rows[:10])], "doc_id long, text string")
    s = {r.doc_id: r.background_loss for r in wordlm.score(docs, docs.where("doc_id between 100 and 200")).collect()}
    assert max(s[k] for k in range(10)) + 0.5 < min(s[k] for k in range(10, 300))


def test_phrases_of_the_same_words_are_told_apart(spark):
    """Texts with the same letters and words in another order: byte trigrams within them hardly differ."""
    docs = spark.createDataFrame([(k, ("abcd efgh ijkl mnop " if k < 10 else "abcd ijkl efgh mnop ") * 20) for k in range(20)], "doc_id long, text string")
    s = {r.doc_id: r.score for r in wordlm.score(docs, docs.where("doc_id < 5")).collect()}
    assert max(s[k] for k in range(10)) + 0.3 < min(s[k] for k in range(10, 20))


def test_the_query_scores_by_words(spark):
    from wavefold.llm import queries

    got = {r.doc_id: r.n_tokens for r in queries.op2_lm_scoring(spark, "/root/testdata/sf0.001").collect()}
    want = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) + 1 for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert got == want
