"""The corpus operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from wavefold.llm import _common, ann, codec, components, decontaminate, langid, neardup, packing, quality, rangecoder, sharding, substrings, wordlm
from wavefold.llm.tokens import encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
R = random.Random(3)
VOCAB = ["".join(R.choice("abcdeé") for _ in range(R.randint(1, 5))) for _ in range(60)]


def prose(n, rnd=R):
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


PASSAGE = prose(30)
TEXTS = [None, "", "   \n", "a", "!!! ---", prose(4), prose(400), PASSAGE, "x " + PASSAGE + " y", PASSAGE + "  " + prose(50), prose(9), "A\x1cb\x85c", "ÀÉ ♥ 汉字\t" + prose(20), prose(3000), "w " * 100, PASSAGE]
#: Names of the operators' own columns, to clash with.
SCHEMA = "doc_id long, text string, places string, piece string, _key string, content string, n int, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "p", "q", "r", "s", 1, "aa") for k, t in enumerate(TEXTS)]
    rows += [(3, "a", "p", "q", "r", "s", 1, "aa"), (None, PASSAGE, "p", "q", "r", "s", 1, "aa"), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *cols):
    out = defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(tuple(r[c] for c in cols))
    return {k: sorted(v) for k, v in out.items()}


# Words and tokens


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBz09 \t\n-{@[`é\x85\x1c汉", max_size=30)), max_size=6))
def test_words_are_the_patterns(texts):
    for kind, pattern, fold in ((_common.SPACED, r"[^\x20\x09-\x0D]+", lambda t: t), (_common.LETTERS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t))):
        h, first = kind.hashes(texts)
        want = [re.findall(pattern, fold(t or "")) for t in texts]
        assert np.diff(first).tolist() == list(map(len, want))
        flat = [w for ws in want for w in ws]
        assert all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))


def test_words_across_blocks():
    long = "ab" * 300_000 + " cd " + "ef " * 100_000
    h, first = _common.SPACED.hashes([long, "cd"])
    assert first.tolist() == [0, 100_002, 100_003] and h[1] == h[-1] and len(set(h[2:-1].tolist())) == 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.integers(1, 9))
def test_winnowing_takes_the_last_smallest(values, w):
    h = np.array(values, np.uint64)
    got = _common.sliding_min_places(h, w)
    assert got.tolist() == [max(range(i, i + w), key=lambda k: (-values[k], k)) for i in range(len(values) - w + 1)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB's.d \n\t1é♥\x1c\x85́İΣ", max_size=40))
def test_encoder_gives_the_library_s_ids(text):
    for path in (BYTE, WORD):
        e = encoder(path)
        assert e.encode([text, None]) == [np.array(e.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), b""]


# 1 packing


def check_plan(counts, capacity):
    space, seen = defaultdict(list), Counter()
    for n, r0, k, first, offset in packing.pack_counts(counts, capacity):
        seen[n] += k
        for i in range(k):
            space[first + i].append((offset, n))
    assert seen == Counter({n: c for n, c in counts.items() if c})
    for items in space.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= capacity and sum(3 * n > capacity for _, n in items) <= 2
    return len(space)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(0, 30), max_size=12))
def test_packing_plan_is_gapless_and_tight(counts):
    bins = check_plan(counts, 24)
    total = sum(n * c for n, c in counts.items())
    assert -(-total // 24) <= bins <= 1.5 * max(total / 24, sum(c for n, c in counts.items() if n > 12)) + 2


def best_fit_count(counts, capacity):
    """Sequences that the method opens when it places one piece at a time."""
    pieces, rooms = sorted(Counter(counts).elements(), reverse=True), []
    large = [n for n in pieces if 3 * n > capacity]
    while large:
        n = large.pop(0)
        mate = next((m for m in large if m <= capacity - n), 0)  # the longest that fits
        if mate:
            large.remove(mate)
        rooms.append(capacity - n - mate)
    for n in (n for n in pieces if 3 * n <= capacity):
        fits = [k for k, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


@settings(max_examples=300, deadline=None)
@given(st.integers(6, 40).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(0, 12), max_size=12))))
def test_packing_plan_opens_as_many_sequences_as_piece_by_piece(case):
    capacity, counts = case
    assert check_plan(counts, capacity) == best_fit_count(counts, capacity)


def test_large_pieces_pair_optimally():
    assert check_plan({13: 4, 11: 4, 12: 3}, 24) == 6


def test_packing(docs, none):
    got = packing.pack(docs, BYTE, 64).collect()
    e = encoder(BYTE)
    want = Counter()
    for d, t in [(r.doc_id, r.text) for r in docs.collect()]:
        ids = np.append(np.frombuffer(e.encode([t])[0], "<u4"), 2).astype("<u4")
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids), 64), len(ids)] if len(ids) > 64 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    space = defaultdict(list)
    for r in got:
        space[r.sequence_id].append((r.offset, r.length))
    for items in space.values():
        items.sort()
        assert [o for o, _ in items] == [sum(n for _, n in items[:k]) for k in range(len(items))] and sum(n for _, n in items) <= 64
    assert packing.pack(none, BYTE).count() == 0


def test_a_length_that_most_pieces_have_is_ranked_in_many_windows(spark, monkeypatch):
    """Repeated rows without a doc_id among them; places are gapless all the same."""
    monkeypatch.setattr(packing, "RANKED", 7)
    d = spark.createDataFrame([(None if k % 3 else k, "one two") for k in range(300)] + [(500, prose(900))], "doc_id long, text string").repartition(5)
    got = packing.pack(d, BYTE, 16).collect()
    space = defaultdict(list)
    for r in got:
        space[r.sequence_id].append((r.offset, r.length))
    for items in space.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 16
    assert Counter(r.doc_id for r in got)[None] == 200 and len({(r.sequence_id, r.offset) for r in got}) == len(got)
    counts = Counter(r.length for r in got)
    assert len(space) == check_plan(counts, 16)


def test_packed_sequences_hold_the_ids(spark):
    d = spark.createDataFrame([(1, prose(30)), (2, prose(200)), (3, None)], "doc_id long, text string")
    placed = packing.pack(d, BYTE, 128)
    seqs = packing.sequences(d, placed, BYTE, 128).collect()
    parts = defaultdict(list)
    for s in seqs:
        assert len(s.ids) <= 128
        for p in s.pieces:
            parts[p.doc_id].append((p.piece, s.ids[p.offset : p.offset + p.length]))
    for r in d.collect():
        ids = [*np.frombuffer(encoder(BYTE).encode([r.text])[0], "<u4").tolist(), 2]
        assert sum((x for _, x in sorted(parts[r.doc_id])), []) == ids


# 2 LM scoring


def test_scores_rank_target_texts_first(spark, docs, none):
    d = spark.createDataFrame([(k, ("zq " * 50) if k < 5 else prose(50)) for k in range(20)], "doc_id long, text string")
    s = {r.doc_id: r for r in wordlm.score(d, d.where("doc_id < 5")).collect()}
    assert max(s[k].score for k in range(5)) < min(s[k].score for k in range(5, 20)) and all(r.score == pytest.approx(r.target_loss - r.background_loss) for r in s.values())
    x = {r.doc_id: r.n_tokens for r in wordlm.score(docs, docs).where("doc_id is not null").collect()}
    assert x[0] == x[1] == 1 and x[3] == 2 and x[13] == 3001
    assert wordlm.score(none, none).count() == 0


# 3 decontamination


def brute_hits(text, items):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = word(text), set(), set()
    for i, t in items:
        b = word(t)
        n = min(10, len(b))
        wins = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else set()
        for k in range(len(w) - n + 1 if n else 0):
            if tuple(w[k : k + n]) in wins:
                hit.update(range(k, k + n))
                found.add(i)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)


def test_decontamination(spark, docs, none):
    items = [(10, PASSAGE), (2, "A"), (7, " ".join(PASSAGE.split()[5:14])), (8, " ".join(TEXTS[6].split()[50:62]).upper()), (9, None), (11, "--"), (12, " ".join(TEXTS[13].split()[:10])), (8, " ".join(TEXTS[6].split()[50:62]))]
    bench = spark.createDataFrame([*items, (None, PASSAGE)], "item_id long, text string")
    cols = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = defaultdict(list)
    for r in docs.collect():
        want[r.doc_id].append(brute_hits(r.text, items))
    want = {k: sorted(v) for k, v in want.items()}
    assert by_id(decontaminate.decontaminate(docs, bench), *cols) == want
    named = [(f"item-{i:03d}é" if i is not None else None, t) for i, t in items]
    assert by_id(decontaminate.decontaminate(docs, spark.createDataFrame(named, "item_id string, text string")), *cols) == {k: sorted(brute_hits(r.text, named) for r in docs.collect() if r.doc_id == k) for k in want}
    long = [x for x in items if x[0] in (10, 12)]
    assert by_id(decontaminate.decontaminate(docs, spark.createDataFrame(long, "item_id long, text string")), *cols) == {k: sorted(brute_hits(r.text, long) for r in docs.collect() if r.doc_id == k) for k in want}
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert not decontaminate.decontaminate(docs, bench.where("false")).where("contaminated").count()


# 4 sharding


def test_sharding(spark, docs, none):
    d = spark.createDataFrame([(k, "copy " * 20 if k % 3 == 0 else prose(k % 60)) for k in range(900)], "doc_id long, text string")
    rows = sharding.shard(d, 8).collect()
    texts = {r.doc_id: r.text for r in d.collect()}
    assert sorted(r.doc_id for r in rows) == list(range(900)) and {r.law for r in rows} == {"bytes"} and all(r.grown_shard is None for r in rows)
    size, slots = Counter(), defaultdict(list)
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(size) == set(range(8)) and max(size.values()) - min(size.values()) <= 2 * max(r.size for r in rows) + 0.01 * sum(size.values()) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    got = sharding.shard(docs, 4).collect()
    assert len(got) == docs.count() and min(r.size for r in got) == 1
    assert sharding.shard(none).count() == 0


def test_a_hot_group_without_doc_ids_is_spread_and_small_groups_stay_whole(spark):
    rnd = random.Random(6)
    small = [prose(30, rnd) for _ in range(60)]
    rows = [(None, "copy " * 20) for _ in range(500)] + [(k, small[k % 60]) for k in range(600)] + [(None, None)] * 40
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sharding.shard(d, 8, whole_group=0.2).collect()
    size, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[r.text_crc32].add(r.shard)
    mean = sum(size.values()) / 8
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(where[zlib.crc32(b"copy " * 20)]) > 2 and all(len(where[zlib.crc32(t.encode())]) == 1 for t in small)
    assert max(abs(x - mean) for x in size.values()) <= 0.2 * mean + max(r.size for r in got)


def test_groups_are_whole_wherever_a_shard_has_room(spark, none):
    rnd = random.Random(9)

    def body(c, n):
        return c * n

    # groups of a fifth of a shard to most of one, one that is larger, single texts of a quarter, and small texts
    groups = {"a": (99, 360), "b": (99, 280), "c": (199, 80), "d": (9, 1200), "e": (499, 40), "f": (99, 920), "g": (13999, 1), "h": (13998, 1), "i": (49, 320), "j": (249, 130)}
    rows = [(None if k % 7 == 0 else k, body(c, n)) for c, (n, m) in groups.items() for k in range(m)] + [(k, prose(rnd.randint(0, 20), rnd)) for k in range(2500)]
    rnd.shuffle(rows)
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 8).collect()
    size, slots, where, total = Counter(), defaultdict(list), defaultdict(Counter), sum(len(t.encode()) + 1 for _, t in rows)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[r.text_crc32][r.shard] += 1
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((k, zlib.crc32(t.encode())) for k, t in rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    room, whole = [total / 8] * 8, {}
    for n, c in sorted(((m * (n + 1), c) for c, (n, m) in groups.items()), reverse=True):  # best fit, the largest first
        fit = min((k for k in range(8) if room[k] >= n), key=lambda k: room[k], default=None)
        whole[c] = fit is not None
        if fit is not None:
            room[fit] -= n
    assert [c for c, x in whole.items() if not x] == ["f"]
    for c, (n, m) in groups.items():
        assert (len(where[zlib.crc32(body(c, n).encode())]) == 1) == whole[c], c
    assert len(where[zlib.crc32(body("f", 99).encode())]) >= 920 * 100 / (total / 8) > 1
    assert max(size.values()) - min(size.values()) <= 0.03 * total / 8
    small = [t for _, t in rows if t and t[0] not in groups or " " in t]
    assert all(len(where[zlib.crc32(t.encode())]) == 1 for t in small)


# 5 token files


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 3), max_size=300), st.integers(1, 40), st.sampled_from([16, 4096]))
def test_range_coder_round_trip(ids, times, block):
    x, before = np.array(ids * times, "<u4"), rangecoder.BLOCK
    rangecoder.BLOCK = block
    try:
        t, blocks = rangecoder.encode(x)
        assert (rangecoder.decode(rangecoder.Table.load(t.dump()), blocks) == x).all() and len(blocks) == -(-len(x) // block)
    finally:
        rangecoder.BLOCK = before


def test_range_coder_beats_deflate_and_order_0():
    texts = [r.as_py() for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).sort_by("doc_id")["text"][:150]]
    x = np.concatenate([np.append(np.frombuffer(b, "<u4"), 2) for b in encoder(WORD).encode(texts)]).astype("<u4")
    t, blocks = rangecoder.encode(x)
    bits = 8 * (len(t.dump()) + sum(12 + len(b[2]) for b in blocks)) / len(x)
    share = np.unique(x, return_counts=True)[1] / len(x)
    assert bits < 8 * len(zlib.compress(x.astype("<u2").tobytes(), 9)) / len(x) - 1 and bits < -(share * np.log2(share)).sum()
    assert (rangecoder.decode(t, blocks) == x).all()


def test_range_coder_of_certain_and_of_even_ids():
    same = rangecoder.encode(np.full(40_000, 7))[1]
    assert sum(len(b[2]) for b in same) < 40_000 / 8
    even = np.random.default_rng(0).integers(0, 1 << 12, 80_000)
    assert sum(len(b[2]) for b in rangecoder.encode(even)[1]) < 80_000 * 12.6 / 8


def test_range_coder_notices_damage():
    t, blocks = rangecoder.encode(np.arange(9000) % 300)
    n, crc, raw = blocks[1]
    with pytest.raises(ValueError):
        rangecoder.decode(t, [blocks[0], (n, crc, raw[:20] + bytes([raw[20] ^ 1]) + raw[21:]), *blocks[2:]])
    f = codec.pack_file([1, None], [np.array([5, 6], "<u4").tobytes(), b""])
    assert [x.tolist() if hasattr(x, "tolist") else x for x in codec.unpack_file(f)] == [[1, None], [2, 0], [5, 6]]
    for bad in (f[:-1], b"x" + f[1:], f[:44] + bytes([f[44] ^ 1]) + f[45:], f[:70] + bytes([f[70] ^ 1]) + f[71:]):
        with pytest.raises((ValueError, zlib.error)):
            codec.unpack_file(bad)


def test_token_files(docs, none):
    got = codec.round_trip(docs, WORD).collect()
    e, at, want = encoder(WORD), 0, Counter()
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = np.append(np.frombuffer(e.encode([r.text])[0], "<u4"), 2).astype("<u4")
        if r.doc_id is not None:
            want[r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())] += 1
        at += len(ids)
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got if r.doc_id is not None) == want
    files = codec.write(docs, WORD, file_tokens=50)
    assert files.count() > 3
    ids = codec.read(files, ids=True).where("doc_id = 7").first().ids
    assert ids == [*np.frombuffer(e.encode([PASSAGE])[0], "<u4").tolist(), 2]
    assert codec.round_trip(none, WORD).count() == 0


def test_token_files_of_many_parts(spark, docs, monkeypatch):
    monkeypatch.setattr(codec, "PART_BYTES", 3000)
    many = docs.union(docs.where("doc_id is null")).union(spark.createDataFrame([(None, "x y z " * 50, *([None] * 6))] * 90, SCHEMA))
    files = codec.write(many, WORD)
    assert files.select("part").distinct().count() > 5
    rows = sorted(codec.round_trip(many, WORD).collect(), key=lambda r: r.start)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda d: (d is not None, d or 0)) and len(rows) == many.count()


# 6 nearest neighbours


def test_nearest(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(1500, 16)).astype(np.float32)
    x[100:160] = x[99]
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)] + [(1500, None, 0), (1520, [0.0] * 16, 0), (1540, [float("nan")] * 16, 0), (1560, [None] * 16, 0), (0, x[0].tolist(), 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, part int")
    got = defaultdict(list)
    for q in ann.nearest(d, every=20, k=10, cell=300, parts=8, block=40).collect():
        got[q.query_id].append((q.rank, q.vec_id, q.score))
    assert set(got) == set(range(0, 1500, 20))
    found = 0
    for q, near in got.items():
        near.sort()
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        assert [k for k, _, _ in near] == list(range(1, 11)) and all(v != q and sc == pytest.approx(s[v], abs=1e-9) for _, v, sc in near)
        assert [(-sc, v) for _, v, sc in near] == sorted((-sc, v) for _, v, sc in near)
        found += len({v for _, v, _ in near} & set(np.lexsort((np.arange(1500), -s))[:10].tolist()))
    assert found / (10 * len(got)) >= 0.9
    assert [v for _, v, _ in sorted(got[100])[:3]] == [99, 101, 102]
    few = ann.nearest(d.where("vec_id < 5"), every=2, k=20).collect()
    assert Counter(q.query_id for q in few) == {0: 4, 2: 4, 4: 4}
    assert ann.nearest(d.where("vec_id > 1499")).count() == 0


def exact(rows, every, k):
    out = {}
    for q, v in rows.items():
        if q % every == 0:
            s = [(-float(np.dot(v, w)), i) for i, w in rows.items() if i != q and len(w) == len(v)]
            out[q] = [i for _, i in sorted(s)[:k]]
    return out


def test_nearest_of_mixed_lengths_and_norms(spark):
    """Several partitions; each query of the rarer length has all its neighbours, each once; recall is that of the inner product."""
    r = np.random.default_rng(1)
    rows = {k: r.normal(size=8 if k % 5 == 0 and k < 400 else 16) * r.lognormal(0, 0.7) for k in range(2400)}
    d = spark.createDataFrame([(k, v.tolist()) for k, v in rows.items()], "vec_id long, embedding array<double>").repartition(4)
    got = defaultdict(list)
    for x in ann.nearest(d, every=20, k=10, cell=200, parts=8, block=30).collect():
        got[x.query_id].append((x.rank, x.vec_id))
    want = exact(rows, 20, 10)
    assert set(got) == set(want)
    near = {q: [v for _, v in sorted(x)] for q, x in got.items()}
    assert all(len(set(x)) == len(x) == 10 for x in near.values())
    assert all(near[q] == want[q] for q in want if len(rows[q]) == 8)
    assert sum(len(set(near[q]) & set(want[q])) for q in want) / (10 * len(want)) >= 0.9


def test_queries_in_poor_partitions_are_widened(spark):
    rows = {k: np.r_[np.eye(4)[k % 4] * (1 + k / 1e4), np.zeros(4)] for k in range(400)}
    d = spark.createDataFrame([(k, v.tolist()) for k, v in rows.items()], "vec_id long, embedding array<double>")
    found = ann.nearest(d, every=50, k=120, parts=4, recall=0.1).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in found} == dict.fromkeys(range(0, 400, 50), 120)


def test_partitions_grow_with_the_table():
    assert [ann.partitions(n) for n in (0, 2000, 1 << 16, 1 << 20, 1 << 24, 10**12)] == [16, 16, 16, 64, 256, 512]


# 7 quality


def brute_chunk_logit(net, chunk):
    p, best = net.p, np.full(len(net.p["bias"]), -np.inf)
    for at in range(0, quality.CHUNK - quality.WIDTH + 1, quality.HOP):
        for f in range(len(best)):
            best[f] = max(best[f], sum(float(p["emb"][chunk[at + j], d]) * float(p["conv"][j * p["emb"].shape[1] + d, f]) for j in range(quality.WIDTH) for d in range(p["emb"].shape[1])))
    return sum(max(float(best[f]) + float(p["bias"][f]), 0) * float(p["dense"][f]) for f in range(len(best))) + float(p["base"][0])


def test_quality_scores_are_the_brute_force_ones():
    net = quality.Network(dims=2, filters=3, seed=4)
    net.p["bias"][:] = [0.1, -0.2, 0.3]
    net.top, net.mid, net.scale = np.array([0.3, 1.0, -0.5, 0.2, 0.1]), np.array([0.1, 0.2, 0.3, 0.4]), np.array([1.0, 2.0, 0.5, 1.5])
    for text in ("", "abc é", "words " * 90):
        z = [brute_chunk_logit(net, c) for c in quality.chunks(text)]
        f = (np.array([np.mean(z), max(z), min(z), np.log(len(z))]) - net.mid) / net.scale
        assert net.score([text])[0] == pytest.approx(1 / (1 + np.exp(-(net.top[0] + net.top[1:] @ f))), abs=1e-5)


def test_quality_gradients_are_the_finite_differences():
    net = quality.Network(dims=2, filters=3, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = np.concatenate([quality.chunks("some bytes " * 40), quality.chunks("other, é")])
    t = np.array([1.0, 0.0, 1.0, 0.0, 1.0])[: len(x)]

    def loss():
        _, r = net._responses(x)
        z = np.maximum(r.max(axis=1) + net.p["bias"], 0) @ net.p["dense"] + net.p["base"]
        return np.mean(np.log1p(np.exp(z)) - t * z)

    for name, g in net._gradients(x, t).items():
        for at in list(np.ndindex(g.shape))[:: max(1, g.size // 40)]:
            kept = net.p[name][at]
            net.p[name][at] = kept + 1e-6
            up = loss()
            net.p[name][at] = kept - 1e-6
            down = loss()
            net.p[name][at] = kept
            assert g[at] == pytest.approx((up - down) / 2e-6, abs=1e-5), (name, at)



def test_quality_learns_and_takes_odd_rows(spark, docs, none):
    bad = lambda k: " ".join(w + R.choice(["###", "$$$"]) for w in prose(60 + k % 7).split())
    d = spark.createDataFrame([(k, bad(k) if k % 3 == 0 else prose(60 + k % 50), 1 - (k % 3 == 0)) for k in range(400)], "doc_id long, text string, quality int")
    net = quality.train(d.where("doc_id < 300"), d.where("doc_id < 300").select("doc_id", "quality"), per_class=200)
    s = {r.doc_id: r for r in quality.classify(d, net, 0.3).collect()}
    assert np.mean([s[k].predicted == (k % 3 != 0) for k in range(300, 400)]) > 0.97 and all(0 <= r.score <= 1 for r in s.values())
    assert quality.classify(docs, net).count() == docs.count()
    assert quality.classify(none, quality.train(none, none.selectExpr("doc_id", "1 as quality"))).count() == 0


def test_chunks_cover_every_byte():
    for n in (0, 1, 255, 256, 257, 448, 449, 5000):
        c = quality.chunks("x" * n)
        assert c.shape[1] == quality.CHUNK and (len(c) - 1) * quality.STRIDE + quality.CHUNK >= n and (n <= quality.CHUNK) == (len(c) == 1)


# 8 substrings


def brute_substrings(rows, window=20):
    seen, gone = set(), defaultdict(set)
    for d, t in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone[d].update(range(k, k + window))
            seen.add(key)
    out = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        kept = [x for k, x in enumerate(w) if k not in gone[d]]
        out[d] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("shift", [0, 1 << 45])
def test_substrings(spark, docs, none, shift):
    cols = ("n_words", "n_removed", "kept_sha256")
    one = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).withColumn("doc_id", F.col("doc_id") + shift)
    want = brute_substrings([(r.doc_id, r.text) for r in one.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()])
    assert {k: v[0] for k, v in by_id(substrings.deduplicate(one), *cols).items()} == want
    if not shift:
        both = by_id(substrings.deduplicate(docs), *cols)
        assert both[3] == [want[3]] * 2 and len(both[None]) == 2 and {r[1] for r in both[None]} == {0}
        assert substrings.deduplicate(none).count() == 0


def test_rows_that_share_a_doc_id_keep_their_own_words(spark):
    rnd = random.Random(8)
    own, other, again = prose(60, rnd), prose(60, rnd), prose(30, rnd)
    own = " ".join(f"{w}{k}" for k, w in enumerate(own.split()))
    rows = [(1, again), (2, "x " + again + " y"), (2, own), (2, own), (3, own + " " + other)]
    got = by_id(substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), "n_words", "n_removed")
    assert got == {1: [(30, 0)], 2: [(32, 30), (60, 0), (60, 0)], 3: [(120, 60)]}


def test_trimmed_keeps_columns(spark, docs, none):
    d = docs.withColumn("n_chars", F.length("text")).where("doc_id is null or doc_id <> 3").withColumnRenamed("content", "kept").withColumnRenamed("n", "text_hash")
    out = substrings.trimmed(d)
    assert out.schema.names == d.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in d.schema]
    want = substrings.deduplicate(d).where("doc_id is not null").collect()
    got = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    before = {r.doc_id: r.text for r in d.collect()}
    for r in want:
        if r.n_removed == r.n_words > 0:
            assert r.doc_id not in got
        else:
            assert got[r.doc_id].text == (r.kept if r.n_removed else before[r.doc_id]) and got[r.doc_id].n_chars == (None if before[r.doc_id] is None else len(got[r.doc_id].text))
    assert substrings.trimmed(none).count() == 0


def test_substrings_of_generated_texts(spark):
    rnd = random.Random(5)
    parts = [prose(rnd.randint(15, 45), rnd) for _ in range(6)]
    rows = [(k, " ".join(rnd.choice([prose(rnd.randint(1, 30), rnd), rnd.choice(parts)]) for _ in range(rnd.randint(0, 6)))) for k in range(60)]
    got = by_id(substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)), "n_words", "n_removed", "kept_sha256")
    assert {k: v[0] for k, v in got.items()} == brute_substrings(rows)


# 9 language ID


def test_language_id(spark, docs, none):
    rnd = random.Random(1)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(5))
    d = spark.createDataFrame([(k, " ".join(word("abcde" if k % 2 else "vwxyz") for _ in range(40)), "aa" if k % 2 else "zz") for k in range(120)] + [(500, "zz zz", None)], "doc_id long, text string, lang string")
    m = langid.train(d.where("doc_id < 80"))
    got = {r.doc_id: r for r in langid.identify(d, m).collect()}
    assert all(got[k].lang_pred == ("aa" if k % 2 else "zz") and got[k].accepted and got[k].score > 0.9 for k in range(80, 120))
    odd = {r.doc_id: r for r in langid.identify(docs.where("doc_id is not null"), m).collect()}
    assert {odd[k].lang_pred for k in (0, 1, 2, 4)} == {"und"} and not odd[0].accepted and odd[0].score == 0
    assert not langid.identify(spark.createDataFrame([(1, "mnop qrst " * 30)], "doc_id long, text string"), m).first().accepted
    assert langid.identify(none, m).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.train(none)).collect()} == {"und"}


def brute_kneser_ney(texts, text, order=4, discount=0.75):
    """Mean cross-entropy in each language by definition, from dictionaries."""
    sym = lambda t: " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
    alphabet = len({c for ts in texts.values() for t in ts if any(map(str.isalpha, t)) for c in sym(t)})
    out = {}
    for lang, ts in texts.items():
        syms = [sym(t) for t in ts if any(map(str.isalpha, t))]
        raw = {n: Counter(s[i : i + n] for s in syms for i in range(len(s) - n + 1)) for n in range(1, order + 1)}
        count = {n: Counter(g[1:] for g in raw[n + 1]) if n < order else raw[n] for n in range(1, order + 1)}

        def p(before, c, n):
            if n == 0:
                return 1 / (alphabet + 1)
            own = {g: k for g, k in count[n].items() if g[:-1] == before and g in raw[n]}
            total, lower = sum(own.values()), p(before[1:], c, n - 1)
            return max(own.get(before + c, 0) - discount, 0) / total + discount * len(own) / total * lower if total else lower

        s = sym(text)
        out[lang] = -np.mean([np.log(p(s[max(0, i - order + 1) : i], c, min(order, i + 1))) for i, c in enumerate(s)])
    return out


@pytest.mark.parametrize("texts", [{"a": ["abra cadabra abra", "bar"], "b": ["rab rab", "cab abc"]}, {"en": ["a"], "fr": ["b"]}, {"a": ["xyz" * 9], "b": ["q", "zz"]}])
def test_kneser_ney_is_the_brute_force_one(texts):
    m = langid.Model(texts)
    for text in ("abra", "a", "bar zq cab!", "rab 7 cadabras", "zzzz"):
        want = brute_kneser_ney(texts, text)
        assert m.losses(langid.symbols(text)).tolist() == pytest.approx([want[k] for k in m.langs], abs=1e-5)


def test_languages_without_a_letter_are_not_learned():
    assert langid.Model({"a": ["123"], "b": []}).judge("text") == ("und", 0.0, None, False)
    m = langid.Model({"a": ["123"], "b": ["bb"]})
    assert m.langs == ["b"] and m.judge("b")[0] == "b"


def test_kneser_ney_sums_to_one():
    m = langid.Model({"a": ["abra cadabra abra", "bar"], "b": ["rab rab"]})
    letters = sorted({c for t in ("abra cadabra", " ") for c in t})
    for before in (" ab", "bra", "xyz"):
        total = np.zeros(2)
        for c in letters:
            s = np.array([ord(x) for x in before + c], np.uint32)
            full = -m.losses(s) * 4
            total += np.exp(full - -m.losses(s[:3]) * 3)
        assert (total <= 1 + 1e-6).all() and (total > 0.5).all()


# 10 near-duplicates


def brute_classes(rows, similarity=0.8):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w = {d: word(t) for d, t in rows}
    bag = {d: Counter(tuple(x[k : k + 5]) for k in range(max(len(x) - 4, 1))) if x else Counter() for d, x in w.items()}
    parent = {d: d for d, _ in rows}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, (a, ta) in enumerate(rows):
        for b, tb in rows[:i]:
            both = sum((bag[a] & bag[b]).values())
            alike = both >= similarity * (sum(bag[a].values()) + sum(bag[b].values()) - both) - 1e-9 if w[a] and w[b] else not w[a] and not w[b] and (ta or "") == (tb or "")
            if alike:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d, _ in rows}


def test_near_duplicates(spark, docs, none):
    rnd = random.Random(9)
    rows = []
    for k in range(40):
        base = prose(rnd.randint(5, 120), rnd).split()
        for _ in range(rnd.randint(1, 6)):
            w = base[:]
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = "q" + str(rnd.randrange(1000))
            rows.append((len(rows), " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(d).collect()} == brute_classes(rows)
    got = by_id(neardup.near_duplicates(docs), "class_id", "n_copies")
    assert got[0][0] == got[1][0] == (0, 3) and got[2][0] != got[0][0] and len(got[3]) == 2 and got[None] == [(0, 3), (7, 3)] and got[7][0] == got[15][0] == (7, 3)
    assert neardup.near_duplicates(none).count() == 0


def test_rows_that_share_a_doc_id_are_documents_of_their_own(spark):
    rnd = random.Random(4)
    a, b, c = (prose(90, rnd) for _ in range(3))
    rows = [(5, a), (5, b), (6, a + " x"), (7, b + " y"), (None, c), (None, c + " z"), (None, a + " w"), (5, a)]
    got = {}
    for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        got.setdefault(r.group, []).append((r.doc_id, r.class_id, r.n_copies))
    key = lambda x: sorted(x, key=str)
    assert sorted(map(key, got.values()), key=str) == sorted(map(key, [[(5, 5, 2), (5, 5, 2), (6, 5, 1), (None, 5, 1)], [(5, 5, 1), (7, 5, 1)], [(None, None, 1), (None, None, 1)]]), key=str)


def test_filter_holds_what_it_was_given(spark):
    f = _common.Filter(spark.range(0, 90_000, 3).union(spark.range(3)), 30_000)
    held = f.may_hold(np.arange(90_000))
    assert held[::3].all() and held.mean() < 0.36 and f.bits.nbytes < 100_000
    assert not _common.Filter(spark.range(0), 0).may_hold(np.arange(5)).any()


def test_a_chain_of_likes_is_one_class(spark):
    base = prose(400).split()
    rows = []
    for k in range(12):
        w = base[:]
        w[: 3 * k] = [f"z{j}" for j in range(3 * k)]
        rows.append((k, " ".join(w)))
    rows += [(100 + k, " ".join(base[:300] + [f"y{k}_{j}" for j in range(100)])) for k in range(6)]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_signatures_are_unbiased():
    r = np.random.default_rng(1)
    h = np.unique(r.integers(0, 2**63, 300).astype(np.uint64))
    gaps = []
    for _ in range(20):
        a = r.integers(0, 7, len(h))
        b = np.where(r.random(len(h)) < 0.7, a, r.integers(0, 7, len(h)))
        s = neardup.signatures([(h[a > 0], a[a > 0]), (h[b > 0], b[b > 0])])
        gaps.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(gaps)) < 0.03


def test_components(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, 101), (101, 102), (100, 102), (7, 7)]
    out = components.components(spark.createDataFrame(links, "u long, v long")).df
    assert {r["node"]: r["class"] for r in out.collect()} == {**{k: 0 for k in range(31)}, 100: 100, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "u long, v long")).df.count() == 0
