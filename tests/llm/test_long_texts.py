"""Texts of many millions of characters in bounded memory."""

import random
import subprocess
import sys
import os

import pytest

from wavefold.llm import langid

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def model():
    r = random.Random(1)
    texts = {lang: [" ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(200)) for _ in range(20)] for lang, letters in (("aa", "abcdé"), ("bb", "abxyz"), ("cc", "хуабв"))}
    return langid.Model(texts)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50])
def test_blocks_are_the_whole_text(monkeypatch, size):
    m = model()
    texts = ["", "...", "a", " a", "a ", "ab  cd, é! ́x́ хув", "́ 12 ab", "  abc" * 30 + "...", "1" * 60 + "x"]
    whole = [(langid.symbols(t).tolist(), *m.measure(t)) for t in texts]
    monkeypatch.setattr(langid, "BLOCK", size)
    for t, (s, loss, n) in zip(texts, whole, strict=True):
        assert langid.symbols(t).tolist() == s and (not s or s[0] == s[-1] == 32)
        got = m.measure(t)
        assert got[1] == n == len(s) and got[0] == pytest.approx(loss)


def test_marks_stay_with_their_letters():
    word = "हिन्दी"
    assert langid.symbols(word).tolist() == [32, *map(ord, word), 32]
    assert not len(langid.symbols("́̂ 12"))


def test_fifty_million_characters_take_less_than_a_gigabyte():
    code = f"""
import resource, sys
sys.path[:0] = [{ROOT!r}, {os.path.dirname(os.path.abspath(__file__))!r}]
from test_long_texts import model
m = model()
text = "abcd dcba, 12 " * (50_000_000 // 14)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
lang = m.judge(text)[0]
print(lang, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600)
    lang, mb = out.stdout.split()[-2:]
    assert lang == "aa" and int(mb) < 500, out
