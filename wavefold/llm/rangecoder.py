"""An adaptive context-mixing range coder for token ids, run over many blocks in step.

A table numbers a file's distinct ids and says how often they come, in classes of half a bit. Blocks are independent: each
starts with empty models and has a checksum of its ids, so NumPy codes id t of all blocks at once. Three models predict an
id. Order 2 names the id last seen after the same two ids, order 1 the one last seen after the same id, each with a
confidence, how often in a row its slot was right; order 0 is the distribution of the table. The three are mixed: an id's
probability is w2 if order 2 names it, and w1 if order 1 does, and w0 times that of order 0. The weights are learned in
each block, apart for each pair of confidences. One step of a range coder with carries codes an id.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 4096
SLOT_BITS = 10
_U, _W = np.uint64, np.uint32
_32, _FULL = _U(32), _U(0xFFFFFFFFFFFFFFFF)
_2, _3, _5, _16 = _W(2), _W(3), _W(5), _W(16)
#: What the classes of counts stand for, two classes for each doubling.
_COUNT = np.array([max(1, int(2 ** (k / 2) + 0.5)) for k in range(64)], np.int64)
#: Weights are pairs of 16-bit numbers, order 2's above order 1's. An id moves each by a 32nd towards 64,000 or 512.
_KEEP = _W(0x07FF07FF)
_RIGHT2, _RIGHT1, _WRONG = (_W((a << 16) + b) for a, b in ((2000, 16), (16, 2000), (16, 16)))
_FIRST = np.array([(a << 16) + b for a in (3000, 16000, 28000, 50000) for b in (2000, 6000, 9000, 12000)], _W)


class Table:
    """The distinct ids, sorted, the classes of their counts, and order 0: which parts of 2^bits an id has."""

    def __init__(self, symbols: np.ndarray, classes: np.ndarray):
        self.symbols, self.classes = symbols, classes
        n = len(symbols)
        self.bits = max(17, (4 * n - 1).bit_length() if n else 0)
        self.weight_bits = max(6, 28 - self.bits)
        count = _COUNT[classes]
        part = 1 + count * ((1 << self.bits) - n) // max(int(count.sum()), 1)
        if n:
            part[int(np.argmax(count))] += (1 << self.bits) - int(part.sum())
        self.part, self.begin = part.astype(_W), (np.cumsum(part) - part).astype(_W)

    @staticmethod
    def of(ids: np.ndarray) -> tuple[Table, np.ndarray]:
        """The table of ids, and their numbers in it."""
        top = int(ids.max(initial=0)) + 1
        if top <= 8 * len(ids) + (1 << 17):
            every = np.bincount(ids, minlength=top)
            symbols = np.flatnonzero(every)
            count, at = every[symbols], np.zeros(top, _W)
            at[symbols] = np.arange(len(symbols), dtype=_W)
            number = at.take(ids)
        else:
            symbols, number, count = np.unique(ids, return_inverse=True, return_counts=True)
        return Table(symbols.astype(np.int64), (np.searchsorted(_COUNT[2:], count, side="right") + 1).astype(np.uint8)), number.astype(_W)

    def dump(self) -> bytes:
        gaps = np.diff(self.symbols, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T
        return zlib.compress(gaps.tobytes() + self.classes.tobytes(), 9)

    @staticmethod
    def load(raw: bytes) -> Table:
        flat = np.frombuffer(zlib.decompress(raw), np.uint8)
        n = len(flat) // 5
        if len(flat) % 5 or (flat[4 * n :] >= len(_COUNT)).any():
            raise ValueError("not a table of ids")
        return Table(np.cumsum(np.ascontiguousarray(flat[: 4 * n].reshape(4, n).T).view("<u4").ravel(), dtype=np.int64), flat[4 * n :])


class _Models:
    """Of each lane: the slots of orders 1 and 2 (an id's number, and in the two lowest bits a confidence), and the weights."""

    def __init__(self, lanes: int, table: Table):
        self.part, self.full, self.all = table.part, _W(table.bits), _W(1 << table.weight_bits)
        self.down1, self.down2 = _W(16 - table.weight_bits), _W(32 - table.weight_bits)
        self.slots = np.zeros(2 * lanes << SLOT_BITS, _W)  # all of order 1, then all of order 2
        self.weights = np.tile(np.concatenate([_FIRST, _FIRST]), lanes)
        self.before, self.hash1 = np.zeros(lanes, _W), np.zeros(lanes, _W)
        self.base, self.rows = (np.arange(2 * lanes) << SLOT_BITS).reshape(2, lanes), np.arange(lanes) << 5

    def predict(self, n: int):
        """What learn() needs, the ids that orders 1 and 2 name, the weight of order 0, and where the ids of orders 2 and 1 end,
        out of the total."""
        h = self.hash1[:n]
        hashes = np.empty((2, n), _W)
        hashes[0] = h
        np.multiply(h + self.before[:n], _W(0x85EBCA77), out=hashes[1])
        slot = (hashes >> _W(32 - SLOT_BITS)) + self.base[:, :n]
        e = self.slots.take(slot, mode="clip")
        named, sure = e >> _2, e & _3
        c1, c2 = named
        row = ((sure[1] << _2) + sure[0] + ((c1 == c2).view(np.uint8) << np.uint8(4))) + self.rows[:n]
        w = self.weights.take(row, mode="clip")
        w2, w1 = w >> self.down2, (w & _W(0xFFFF)) >> self.down1
        w0 = self.all - w2 - w1
        p1, p2 = self.part.take(named, mode="clip")
        end2 = (w2 << self.full) + w0 * p2
        end1 = end2 + (w1 << self.full) + w0 * p1
        return (slot, e, sure, row, w), named, w0, end2, end1, end1 + (w0 << self.full)

    def learn(self, x: np.ndarray, right: np.ndarray, made) -> None:
        """x: the ids' numbers; right: which of them order 1 named, and which order 2."""
        (slot, e, sure, row, w), n = made, len(x)
        self.slots[slot] = np.where(right, e + (sure != _3), x << _2)
        self.weights[row] = w - ((w >> _5) & _KEEP) + np.where(right[1], _RIGHT2, np.where(right[0], _RIGHT1, _WRONG))
        self.before[:n] = self.hash1[:n]
        np.multiply(x, _W(0x9E3779B1), out=self.hash1[:n])


def _lengths(n: int) -> list[int]:
    """All blocks but the last are full, so the lanes of a step are the first ones."""
    return [BLOCK] * (n // BLOCK) + ([n % BLOCK] if n % BLOCK else [])


def _carry(words: np.ndarray, at: np.ndarray) -> None:
    """Adds one to the words before `at`, which are of different lanes."""
    while len(at):
        at = at - 1
        words[at] += _W(1)
        at = at[words[at] == 0]


def encode(ids: np.ndarray) -> tuple[Table, list[tuple[int, int, bytes]]]:
    """The table, and of each block its ids, their crc32 as little-endian uint32, and the payload. Ids are below 2^32."""
    ids = np.ascontiguousarray(ids, "<u4")
    table, number = Table.of(ids)
    lengths = _lengths(len(ids))
    lanes = len(lengths)
    grid = np.zeros(lanes * BLOCK, _W)
    grid[: len(ids)] = number
    columns = np.ascontiguousarray(grid.reshape(lanes, BLOCK).T)
    del grid, number
    models = _Models(lanes, table)
    low, wide, at = np.zeros(lanes, _U), np.full(lanes, _FULL, _U), np.zeros(lanes, np.int64)
    room = BLOCK // 3 + 16  # words of each lane, one after the other
    words, own = np.zeros(lanes * room, _W), np.arange(lanes) * room
    for t in range(max(lengths, default=0)):
        n = lanes if t < lengths[-1] else lanes - 1
        x = columns[t, :n]
        number = x.astype(np.int64)
        made, named, w0, end2, end1, total = models.predict(n)
        is1, is2 = right = named == x
        begin = np.where(is2, _W(0), np.where(is1, end2, end1 + w0 * table.begin.take(number, mode="clip")))
        size = np.where(is2, end2, np.where(is1, end1 - end2, w0 * table.part.take(number, mode="clip")))
        old, r = low[:n], wide[:n] // total
        new, wd = old + r * begin, r * size
        over = (new < old).nonzero()[0]
        if len(over):
            _carry(words, own.take(over) + at.take(over))
        out = (wd <= _FULL >> _32).nonzero()[0]
        if len(out):
            low_, to = new.take(out), at.take(out)
            if t % 16 == 0 and int(at.max()) + 18 > room:
                words = np.pad(words.reshape(lanes, room), ((0, 0), (0, room))).ravel()
                room *= 2
                own = np.arange(lanes) * room
            words[own.take(out) + to] = low_ >> _32
            at[out] = to + 1
            new[out] = low_ << _32
            wd[out] <<= _32
        low[:n], wide[:n] = new, wd
        models.learn(x, right, made)
    up = (low >> _32) + ((low & _FULL >> _32) != 0)  # the first multiple of a word in the last range; zeros follow it
    over = (up >> _32).nonzero()[0]
    _carry(words, own[over] + at[over])
    words[own + at] = up.astype(_W)
    raw = memoryview(ids).cast("B")
    begins = np.concatenate([[0], np.cumsum(lengths)]).tolist()
    return table, [(n, zlib.crc32(raw[4 * b : 4 * (b + n)]), words[k : k + end].tobytes()) for n, b, k, end in zip(lengths, begins, own.tolist(), (at + 1).tolist(), strict=False)]


def decode(table: Table, blocks: list[tuple[int, int, bytes]]) -> np.ndarray:
    """The ids of blocks in the order encode() gave them; raises ValueError where a checksum doesn't hold."""
    lanes = len(blocks)
    if not lanes:
        return np.empty(0, "<u4")
    lengths = [b[0] for b in blocks]
    if set(lengths[:-1]) - {lengths[0]} or lengths[-1] > lengths[0]:
        raise ValueError("the blocks' sizes don't hold")
    room = max(len(b[2]) for b in blocks) // 4 + 2
    words, own = np.zeros((lanes, room), _W), np.arange(lanes) * room
    for k, b in enumerate(blocks):
        words[k, : len(b[2]) // 4] = np.frombuffer(b[2], "<u4")
    code, wide, at = (words[:, 0].astype(_U) << _32) | words[:, 1], np.full(lanes, _FULL, _U), own + 2
    words, last = words.ravel(), own + room - 1
    place = np.repeat(np.arange(len(table.symbols), dtype=_W), table.part.astype(np.int64))
    columns = np.zeros((max(lengths), lanes), _W)
    models = _Models(lanes, table)
    for t in range(max(lengths)):
        n = lanes if t < lengths[-1] else lanes - 1
        made, (c1, c2), w0, end2, end1, total = models.predict(n)
        r, low = wide[:n] // total, code[:n]
        v = np.minimum(low // r, total - _W(1)).astype(_W)
        is2, is1 = v < end2, v < end1
        # Below 2^53 a quotient of doubles, cut, is that of whole numbers; where order 0 isn't asked any place will do.
        y = place.take(((v - end1) / w0).astype(np.int64), mode="clip")
        number = y.astype(np.int64)
        x = np.where(is2, c2, np.where(is1, c1, y))
        begin = np.where(is2, _W(0), np.where(is1, end2, end1 + w0 * table.begin.take(number, mode="clip")))
        size = np.where(is2, end2, np.where(is1, end1 - end2, w0 * table.part.take(number, mode="clip")))
        low -= r * begin
        wd = r * size
        out = (wd <= _FULL >> _32).nonzero()[0]
        if len(out):
            to = at.take(out)
            low[out] = (low.take(out) << _32) | words.take(np.minimum(to, last.take(out)))
            wd[out] <<= _32
            at[out] = to + 1
        wide[:n] = wd
        columns[t, :n] = x
        models.learn(x, made[1] >> _2 == x, made)
    out = table.symbols.astype("<u4").take(columns.T, mode="clip").ravel()[: sum(lengths)]
    raw, at_ = memoryview(out).cast("B"), 0
    for n, crc, _ in blocks:
        if zlib.crc32(raw[4 * at_ : 4 * (at_ + n)]) != crc:
            raise ValueError("a block's checksum doesn't hold")
        at_ += n
    return out
