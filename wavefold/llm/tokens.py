"""Token ids of whole texts by a public tokenizer file, with a worker-wide memory of what words encode to.

A text is cut where the tokenizer's own pre-tokenizer always cuts, each distinct piece is encoded once by the
`tokenizers` library, and the pieces' ids are put together. Pieces of Latin script go, many at a time, straight to the
library's BPE model; all others through its whole chain. Texts that hold an added token's content go through the whole chain uncut, as
it splits there first. Files with another chain than the two known here are encoded text by text.

Texts of Latin script take a shorter way, a slice of them at once: they are cut into words (runs of letters, digits or
others, contractions, and white space where it gives ids) by the classes of their bytes, words that are known are found
by their hashes in a table and told apart by their bytes, and the ids are gathered from a pool.
"""

from __future__ import annotations

import json
import re

import numpy as np
from tokenizers import Tokenizer

from ._common import CACHE_ENTRIES, no_threads, run_hashes

#: Words a worker keeps in the pool, some 160 bytes each.
POOL_ENTRIES = 800_000
#: White space of Unicode: Python's, but for the four separators that only Python counts.
_WS, _NS = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
#: Printable ASCII and Latin letters of one case mapping each, the same in every version of Unicode.
_LATIN = re.compile(r" ?[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+\Z")
_L, _N = r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]", r"[0-9]"
_OTHER = r"[^\sA-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff0-9]"
#: The bytes of texts of Latin script: their letters beyond ASCII begin with 0xC3, and no other text has these bytes alone.
_LATIN_BYTES = bytes([*range(0x09, 0x0E), *range(0x20, 0x7F), 0xC3, *(b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7))])
_SHORT = r"'s|'t|'re|'ve|'m|'ll|'d"
_SHORT_BYTES = re.compile(_SHORT.encode())
#: Classes of bytes: 0 white space and the zero byte, 1 letters (bytes beyond ASCII are parts of letters here), 2 digits, 3 others.
_CLASS = bytes(0 if b in b"\0 \t\n\v\f\r" else 1 if chr(b).isalpha() or b > 127 else 2 if chr(b).isdigit() else 3 for b in range(256))
_SMALL = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_STEP = 1 << 18
#: Words of more bytes are found by a dictionary.
_LONG = 48
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes bytes as letters: printable bytes as themselves, the others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Encoder:
    """encode(texts) gives each text's ids as little-endian uint32 bytes; null counts as empty."""

    def __init__(self, path: str):
        no_threads()
        self.tok = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        added = spec.get("added_tokens") or []
        self.added = [x["content"] for x in added]
        self.memory: dict[str, bytes] = {}  # of pieces
        self.words: dict[str, bytes] = {}  # of what pieces are made of
        self.pool = _Pool()
        self.cut = self.parts = None
        self.lower = self.plain = False
        if any(x.get("normalized") for x in added):  # sought in normalised text
            return
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
            self.cut = re.compile(rf" ?{_NS}+|{_WS}+(?!{_NS})|{_WS}+")
            self.parts = re.compile(rf"{_SHORT}| ?{_L}+| ?{_N}+| ?{_OTHER}+")
        elif [x.get("type") for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"] and pre["pretokenizers"][0].get("invert"):
            self.cut, self.lower, self.plain = re.compile(rf"{_NS}+"), True, True
            self.parts = re.compile(rf"{_SHORT}|{_L}+|{_N}|{_OTHER}+")
        if self.cut:
            self._bare(spec)

    def _bare(self, spec: dict) -> None:
        """The library with the file's BPE model alone, for words already written in byte letters, one a line; and how many
        of a word's bytes each id stands for, by which a run of ids is cut into words again."""
        self.bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "decoder": None, "added_tokens": []}))
        end, vocabulary = spec["model"].get("end_of_word_suffix") or "", spec["model"]["vocab"]
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for word, k in vocabulary.items():
            self.bytes_of[k] = len(word.removesuffix(end))
        self.letters[10] = "\n"

    def _one(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, pieces: list[str]) -> dict[str, bytes]:
        """What pieces encode to. Those of Latin script are cut into words, and only words that aren't known are encoded."""
        letters, plain, rest, latin = [], [], [], _LATIN.match
        for p in pieces:
            (letters if p.isascii() and p[1:].isalpha() and (p[0].isalpha() or p[0] == " ") else plain if latin(p) else rest).append(p)
        if len(self.words) >= CACHE_ENTRIES:
            self.words.clear()
        low = str.lower if self.lower else str
        one, several = list(map(low, letters)), [self.parts.findall(low(p)) for p in plain]
        if new := list(set(one).union(*several).difference(self.words)):
            lines = "\n".join(new).encode().decode("latin-1").translate(self.letters)
            ids = np.array(self.bare.encode_batch_fast([lines], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum([len(w.encode()) for w in new])) + 1)).tolist()
            raw = ids.tobytes()
            self.words.update(zip(new, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        get = self.words.__getitem__
        out = dict(zip(letters, map(get, one), strict=True))
        out.update(zip(plain, [b"".join(map(get, s)) for s in several], strict=True))
        out.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(rest, self.tok.encode_batch(rest, add_special_tokens=False) if rest else [], strict=True))
        return out

    def _pieces(self, text: str) -> list[str]:
        """The text cut where the pre-tokenizer always cuts. Python's own split knows four separators more."""
        if self.plain and not ("\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text):
            return text.split()
        return self.cut.findall(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if self.cut is None:
            return [self._one(t) if t else b"" for t in texts]
        uncut = {k for k, t in enumerate(texts) if t and any(a in t for a in self.added)}
        out = [self._one(t) if k in uncut else b"" for k, t in enumerate(texts)]
        own, latin, raws = [], [], []
        for k, t in enumerate(texts):
            if t and k not in uncut:
                if (raw := t.encode("utf-8", "surrogatepass")).translate(None, _LATIN_BYTES):
                    own.append(k)
                else:
                    latin.append(k)
                    raws.append(raw)
        for k, ids in zip(latin, self._latin(raws) if latin else [], strict=True):
            out[k] = ids
        if own:
            cut = [self._pieces(texts[k]) for k in own]
            if len(self.memory) >= CACHE_ENTRIES:
                self.memory.clear()
            if new := set().union(*cut).difference(self.memory):
                self.memory.update(self._ids(list(new)))
            for k, c in zip(own, cut, strict=True):
                out[k] = b"".join(map(self.memory.__getitem__, c))
        return out

    def _latin(self, raws: list[bytes]) -> list[bytes]:
        raw, first = np.frombuffer(b"\0".join([*raws, b""]), np.uint8), np.cumsum([0, *(len(r) + 1 for r in raws)])
        if self.plain:
            raw = _small(raw)
        start, end = (_words if self.plain else _words_and_spaces)(raw)
        if self.pool.count >= POOL_ENTRIES:
            self.pool = _Pool()
        parts, ends, k, total = [], [np.zeros(1, np.int64)], 0, 0
        while k < len(start):  # some bytes at a time
            to = max(k + 1, int(np.searchsorted(start, start[k] + _STEP)))
            at = int(start[k])
            ids, own = self.pool.gather(self._slots(raw[at : int(end[to - 1])], start[k:to] - at, end[k:to] - at))
            parts.append(ids)
            ends.append(own + total)
            k, total = to, total + len(ids)
        cuts = (4 * np.concatenate(ends)[np.searchsorted(start, first)]).tolist()
        flat = b"".join(parts)
        return [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _slots(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The pool's slots of words; those it doesn't hold are encoded and added."""
        words = _Cut(raw, start, end)
        slots = self.pool.find(words)
        if len(new := np.flatnonzero(slots < 0)):
            flat = raw.tobytes()
            texts = [flat[a:b] for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)]
            fresh: dict[bytes, int] = {}  # to where the word comes first
            for k, w in zip(new.tolist(), texts, strict=True):
                if w not in self.pool.apart:
                    fresh.setdefault(w, k)
            known = self.pool.apart
            if fresh:
                known = known | dict(zip(fresh, self.pool.add(words, fresh, *self._encoded(list(fresh))), strict=True))
            slots[new] = [known[w] for w in texts]
        return slots

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after the other, and how many each has. White space goes through the library's whole chain."""
        blank = [k for k, w in enumerate(words) if w.isspace()]
        own = {k: self._one(words[k].decode()) for k in blank}
        text = [w for k, w in enumerate(words) if k not in own] if blank else words
        lines = b"\n".join(text).decode("latin-1").translate(self.letters)
        ids = np.array(self.bare.encode_batch_fast([lines], add_special_tokens=False)[0].ids if text else [], "<u4")
        ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum([len(w) for w in text])) + 1 if text else np.empty(0, np.int64)
        if not blank:
            return ids, np.diff(ends, prepend=0)
        raw, cuts = ids.tobytes(), (4 * ends).tolist()
        rest = iter([raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)])
        each = [own[k] if k in own else next(rest) for k in range(len(words))]
        return np.frombuffer(b"".join(each), "<u4"), np.array([len(x) // 4 for x in each])


class _Cut:
    """Words of a run of bytes: their sizes and hashes, and their bytes eight at a time."""

    def __init__(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.start, self.size, self.hash = start, end - start, run_hashes(raw, start, end)
        self.words = np.ndarray((len(raw) + 1,), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))

    def eight(self, which: np.ndarray | slice, k: int) -> np.ndarray:
        """The k-th eight bytes of some words that have so many; zeros stand after a word's end."""
        return self.words[self.start[which] + 8 * k] & _MASKS[np.minimum(self.size[which] - 8 * k, 8)]


def _small(raw: np.ndarray) -> np.ndarray:
    """Bytes of a Latin text with its letters made small: A to Z, and those whose second byte in UTF-8 is 0x80 to 0x9E."""
    out = np.frombuffer(bytearray(raw).translate(_SMALL), np.uint8)
    second = np.flatnonzero(raw[:-1] == 0xC3) + 1
    out[second] += np.where((raw[second] <= 0x9E), np.uint8(0x20), np.uint8(0))
    return out


def _begins(raw: np.ndarray, single_digits: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words of a Latin text begin, white space before them aside; the bytes' classes and those of the bytes before."""
    kind = np.frombuffer(raw.tobytes().translate(_CLASS), np.int8)
    before = np.concatenate([np.zeros(1, np.int8), kind[:-1]])
    begins = (kind != 0) & ((kind != before) | (kind == 2) & single_digits)
    # A contraction is a word if a word can begin there; letters after it are the next one.
    if spans := [m.span() for m in _SHORT_BYTES.finditer(raw.tobytes())]:
        a, b = np.array(spans).T
        own = before[a] != 3
        if not single_digits:  # a space belongs to what follows it
            own &= (a == 0) | (raw[a - 1] != 32)
        a, b = a[own], b[own]
        begins[a + 1] = False
        inner = b < len(raw)
        begins[b[inner]] |= kind[b[inner]] != 0
    return begins, kind, before


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of Latin texts in small letters, each with a zero byte after it, begin and end; digits stand alone."""
    begins, kind, _ = _begins(raw, True)
    return _to_edges(begins, kind)


def _to_edges(begins: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end: a word ends where the next begins or white space does."""
    edge = np.flatnonzero(begins | (kind == 0))
    own = np.flatnonzero(begins[edge])
    return edge[own], np.append(edge, len(kind))[own + 1]


def _words_and_spaces(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same where white space counts: a word takes the space before it; of other white space, all before a word but the
    last character is one word, and so is the last, if the word doesn't take it; before a text's end all of it is one."""
    begins, kind, before = _begins(raw, False)
    word, end = _to_edges(begins, kind)
    blank = (kind == 0) & (raw != 0)
    took = (word > 0) & (raw[word - 1] == 32)
    start = word - took
    # Runs of white space: from p, to q.
    sides = np.diff(np.concatenate([[0], blank.view(np.int8), [0]]))
    p, q = np.flatnonzero(sides == 1), np.flatnonzero(sides == -1)
    last = np.append(raw, 0)[q] == 0  # nothing but the text's end follows
    long = ~last & (q - p > 1)
    alone = ~last & (raw[q - 1] != 32)
    starts = np.concatenate([start, p[last], p[long], q[alone] - 1])
    ends = np.concatenate([end, q[last], q[long] - 1, q[alone]])
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order]


class _Pool:
    """Ids of words, one after the other in one array. A table by hashes, each in the first free place from its own on, names
    a word's slot, which keeps the word's bytes. Long words and those whose hash another word has are in a dictionary."""

    def __init__(self):
        self.count, self.apart = 0, {}
        self.table, self.bits = np.full(1 << 16, -1, np.int32), 16
        self.hash, self.length, self.bytes = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.int64), np.zeros((_LONG // 8, 1 << 14), np.uint64)
        self.ids, self.begin, self.size, self.used = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _place(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, words: _Cut) -> np.ndarray:
        """Each word's slot by the table; -1 where there is none."""
        at = self._place(words.hash)
        slots = self.table.take(at).astype(np.int64)
        # The last slot stands for none here.
        on = np.flatnonzero((self.hash.take(slots, mode="wrap") != words.hash) & (slots >= 0))
        while len(on):
            at[on] = (at[on] + 1) & ((1 << self.bits) - 1)
            slots[on] = own = self.table[at[on]]
            on = on[(own >= 0) & (self.hash[own] != words.hash[on])]
        same = (self.length.take(slots, mode="wrap") == words.size) & (self.bytes[0].take(slots, mode="wrap") == words.eight(slice(None), 0))
        more = np.flatnonzero(same & (slots >= 0) & (words.size > 8))
        for k in range(1, _LONG // 8):
            if not len(more):
                break
            equal = self.bytes[k].take(slots[more]) == words.eight(more, k)
            same[more[~equal]] = False
            more = more[equal & (words.size[more] > 8 * k + 8)]
        slots[~same] = -1
        return slots

    def add(self, words: _Cut, new: dict[bytes, int], flat: np.ndarray, sizes: np.ndarray) -> list[int]:
        """New words, and where each is among `words`, with their ids; gives their slots."""
        at, n = np.fromiter(new.values(), np.int64, len(new)), self.count + len(new)
        slots = np.arange(self.count, n)
        while n > len(self.begin):
            self.begin, self.size, self.hash, self.length = (np.pad(x, (0, len(x))) for x in (self.begin, self.size, self.hash, self.length))
            self.bytes = np.pad(self.bytes, ((0, 0), (0, self.bytes.shape[1])))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.pad(self.ids, (0, len(self.ids)))
        self.ids[self.used : self.used + len(flat)] = flat
        self.begin[slots], self.size[slots] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(flat)
        self.count = n
        self.hash[slots], self.length[slots] = words.hash[at], words.size[at]
        for k in range(_LONG // 8):
            more = np.flatnonzero(self.length[slots] > 8 * k) if k else slice(None)
            self.bytes[k, slots[more]] = words.eight(at[more], k)
        if 2 * n > len(self.table):
            old = self.table[self.table >= 0].astype(np.int64)
            self.bits = (4 * n).bit_length()
            self.table = np.full(1 << self.bits, -1, np.int32)
            self._insert(old)
        left = set(slots[self.length[slots] > _LONG].tolist()) | set(self._insert(slots[self.length[slots] <= _LONG]))
        if left:
            self.apart.update((w, k) for w, k in zip(new, slots.tolist(), strict=True) if k in left)
        return slots.tolist()

    def _insert(self, slots: np.ndarray) -> list[int]:
        """Enters slots into the table, but for those whose hash it holds; gives these."""
        at, own, left = self._place(self.hash[slots]), slots, []
        while len(own):
            free = self.table[at] < 0
            self.table[at[free]] = own[free]  # of several the last one stays
            there = self.table[at]
            left += own[(there != own) & (self.hash[there] == self.hash[own])].tolist()
            on = (there != own) & (self.hash[there] != self.hash[own])
            at, own = (at[on] + 1) & ((1 << self.bits) - 1), own[on]
        return left

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and where each word's end."""
        sizes = self.size.take(slots)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids.take(np.repeat(self.begin.take(slots) - (ends - sizes), sizes) + np.arange(total)), ends


_known: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    if path not in _known:
        _known[path] = Encoder(path)
    return _known[path]
