"""Ranked search, the n-gram join and the prefix trie against brute force, with odd rows, hot groups and small limits."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from wavefold.llm import jaccard, queries, ranked, trie

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, terms string, n int, s string, node long, content string"
R = random.Random(8)
VOCAB = ["".join(R.choice("abcdé9") for _ in range(R.randint(1, 4))) for _ in range(80)]


def prose(n, rnd=R):
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(k, t, "x", 1, "y", 2, "z") for k, t in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_jaccard_join", "op13_prefix_trie"])
def test_the_query_gives_the_sql_s_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DATA)
    want = con.sql(f"select {', '.join(sorted(got.columns))} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert Counter(map(tuple, got.select(*sorted(got.columns)).collect())) == Counter(want)


# 11 ranked search


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def ranking(docs, items, k=10):
    counts = [(i, Counter(words(t))) for i, t in docs]
    total, length = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = Counter()
    for item, text in items:
        found = []
        for i, c in counts:
            if c:
                m = 100 - 75 + (75 * sum(c.values()) * total) // length
                s = sum(q * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in Counter(words(text)).items() if t in c)
                if s > 0:
                    found.append((-s, i is None, i or 0, i))
        out.update((item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1))
    return out


def ranked_rows(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize("segment, block", [(1_000_000, 200_000), (60, 9), (1, 3)])
def test_search_is_the_brute_force_ranking(spark, monkeypatch, segment, block):
    monkeypatch.setattr(ranked, "SEGMENT", segment)
    monkeypatch.setattr(ranked, "BLOCK", block)
    rows = [(k, prose(R.randint(0, 30))) for k in range(120)] + [(k, "same words here") for k in range(200, 230)]
    rows += [(5, "same words here"), (None, "same words here"), (None, None), (7, None), (8, ""), (9, "... !"), (300, prose(3000)), (301, "Same SAME\x1csame")]
    items = [(1, "same words"), (2, prose(12)), (3, "a a a " + VOCAB[3]), (4, ""), (5, None), (6, "zzzz nothing"), (7, "???")]
    given = [*items, (2, items[1][1]), (None, "same")]
    bench = spark.createDataFrame(given, "item_id long, text string")
    assert ranked_rows(ranked.search(table(spark, rows), bench)) == ranking(rows, items)


def test_search_of_odd_tables(spark):
    docs = table(spark, [(1, "a b"), (2, "b")])
    bench = spark.createDataFrame([("x", "b"), ("y", "A")], "item_id string, text string")
    assert ranked_rows(ranked.search(docs, bench)) == ranking([(1, "a b"), (2, "b")], [("x", "b"), ("y", "a")])
    assert not ranked.search(docs.limit(0), bench).collect() and not ranked.search(docs, bench.limit(0)).collect()
    assert not ranked.search(table(spark, [(1, None)]), bench).collect()


@pytest.mark.parametrize("seed", range(6))
def test_a_segment_s_best_are_exact(seed):
    r = np.random.default_rng(seed)
    docs, terms, times = 60, 12, r.integers(1, 4, 12)
    doc, term = np.divmod(r.choice(docs * terms, 300, replace=False), terms)
    impact = r.integers(0, 6 if seed % 2 else 10**9, 300)
    s = ranked.Segment(np.arange(docs), doc, term, impact, terms)
    total = np.zeros(docs, np.int64)
    np.add.at(total, doc, impact * times[term])
    for k in (1, 5, 100):
        top, score = s.best(np.arange(terms), times, k)
        want = sorted((-x, i) for i, x in enumerate(total.tolist()) if x)[:k]
        assert list(zip((-score).tolist(), top.tolist(), strict=True)) == want


def test_reading_stops_early():
    """Where few lists decide, the long list of small impacts isn't read to its end."""
    docs = 20_000
    doc = np.concatenate([np.arange(20), np.arange(docs)])
    term = np.concatenate([np.zeros(20, int), np.ones(docs, int)])
    s = ranked.Segment(np.arange(docs), doc, term, np.concatenate([10**9 - np.arange(20), np.arange(docs)[::-1] + 1]), 2)
    reads = []
    old = s.doc
    s.doc = type("Counted", (), {"__getitem__": lambda self, x: reads.append(x.stop - x.start) or old[x]})()
    top, score = s.best(np.array([0, 1]), np.array([1, 1]), 5)
    assert top.tolist() == [0, 1, 2, 3, 4] and score[0] == 10**9 + docs and sum(reads) < docs


# 12 join


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def joined(rows):
    all_ = [sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(all_):
        for j in range(i):
            b = all_[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        c = find(i)
        least[c] = min((x for x in (least.get(c), k) if x is not None), default=None)
    return Counter((k, len(all_[i]), least[find(i)]) for i, (k, _) in enumerate(rows))


def edited(text, n, rnd):
    w = text.split(" ")
    for _ in range(n):
        w[rnd.randrange(len(w))] = rnd.choice(VOCAB) + "x"
    return " ".join(w)


@pytest.mark.parametrize("small", [24, 1])
def test_join_links_what_brute_force_links(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    rnd = random.Random(small)
    rows = [(k, prose(rnd.randint(5, 60), rnd)) for k in range(60)]
    base, other = prose(300, rnd), prose(120, rnd)
    rows += [(100 + k, edited(base, rnd.randint(0, 8), rnd)) for k in range(60)]
    rows += [(300 + k, other + " " + prose(rnd.randint(5, 60), rnd)) for k in range(40)]
    rows += [(400 + k, " ".join(base.split(" ")[: 300 - 6 * k])) for k in range(14)]
    rows += [(500, None), (501, ""), (502, " \n\t"), (503, "One two"), (504, "one  TWO"), (505, "one"), (None, base), (None, "alone of all these words here"), (7, base), (506, "É x"), (507, "é x")]
    rows += [(600, prose(4000, rnd))]
    rows += [(601, edited(rows[-1][1], 30, rnd))]
    got = jaccard.near_sets(table(spark, rows))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == joined(rows)


@pytest.mark.parametrize("small", [24, 1])
def test_join_at_the_threshold(spark, monkeypatch, small):
    """Sets of n-grams that overlap in exactly, or in one less than, what a link asks for."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    rows, k = [], 0
    for n in (5, 6, 9, 10, 18, 27, 45, 90, 180):
        w = [f"t{n}w{i}" for i in range(n + 4)]
        for less in range(0, n // 4 + 2):
            rows.append((k, " ".join(w[less:])))
            k += 1
        fresh = [f"t{n}v{i}" for i in range(n)]
        for cut in range(1, n // 6 + 2):
            rows.append((k, " ".join(w[: n + 4 - cut] + fresh[:cut])))
            k += 1
    got = jaccard.near_sets(table(spark, rows))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == joined(rows)


def test_join_of_no_rows(spark):
    assert jaccard.near_sets(table(spark, [(1, "a")]).limit(0)).collect() == []
    assert [tuple(r) for r in jaccard.near_sets(table(spark, [(1, None)])).collect()] == [(1, 0, 1, 1)]


def test_what_two_alike_sets_share_of_their_parts():
    for n in range(1, 400):
        for m in range(jaccard.least(n), n + 1):
            both = -(-80 * (n + m) // 180)
            # However the common n-grams lie, so many are in both parts.
            assert min(jaccard.part(n) - (n - both), jaccard.part(m) - (m - both)) >= min(jaccard.asked(n), jaccard.asked(m)) == jaccard.asked(m) >= max(1, jaccard.least(n) // 8)


def test_pieces_bound_the_overlap():
    r = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(r.integers(0, 300, r.integers(1, 150)).astype(np.uint64)) for _ in range(2))
        assert jaccard.suffix_bound(a, b) >= len(np.intersect1d(a, b))


# 13 trie


def built(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = tuple(turns.get(c - c % 5, [])[:h] + t[h:])
    return out


def nodes(convs):
    members = defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = []

    def total(p):
        n, leaves, saved = len(members[p]), 0, (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        for q in kids[p]:
            x, y = total(q)
            leaves, saved = leaves + x, saved + y
        leaves = leaves or 1
        ends = ",".join(map(str, sorted(c for c in members[p] if len(convs[c]) == len(p))))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, n, len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if members:
        total(())
    return Counter(out)


def trie_rows(df):
    return Counter(tuple(r[c] for c in trie.RESULT) for r in df.collect())


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "sha") for r in rows], "conv_id long, turn long, role string, text string, depth string, a int, n int, ends_sha256 string").repartition(3)


def test_trie_is_the_brute_force_one(spark):
    rnd = random.Random(4)
    rows = [(c, t, rnd.choice(["u", "a", None]), rnd.choice(["hi", "é汉", "", None, "long " * 50])) for c in range(90) if c % 15 for t in range(rnd.randint(1, 12))]
    rows += [(c, t, "u", "hot") for c in range(200, 260) for t in range(10)]
    rows += [(500, t, "u", f"deep {t}") for t in range(60)] + [(501, None, "u", "null turn"), (501, 3, None, None), (501, 3, None, None), (501, 3, "b", "tie"), (501, 3, "a", "tie")]
    rows += [(None, 1, "u", "no conversation"), (-7, 1, "u", "x"), (-7, 2, "u", "y"), (7 * 10**12, 1, "u", "big")]
    got = trie.prefix_trie(trie.rebuilt(trie.ordered(conversations(spark, rows))))
    assert trie_rows(got) == nodes(built(rows))


def test_trie_of_any_turns(spark):
    """Conversations that end inside others, equal ones, and one without turns; most rounds where two part late."""
    convs = {1: (("u", "a"),) * 9, 2: (("u", "a"),) * 9, 3: (("u", "a"),) * 4, 4: (), 5: (("u", "a"),) * 8 + (("u", "b"),), 6: (("z", "q"),)}
    rows = [(c, d, *t) for c, turns in convs.items() for d, t in enumerate(turns, 1)]
    turns = trie.ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumnRenamed("pos", "depth")
    empty = spark.createDataFrame([(c, 0, 0, 0, 0) for c in convs], "conv_id long, depth long, x long, y long, bytes long")
    assert trie_rows(trie.prefix_trie(turns.union(empty))) == nodes(convs)


def test_trie_of_no_conversations(spark):
    assert trie.prefix_trie(trie.rebuilt(trie.ordered(conversations(spark, [(None, 1, "u", "x")])))).collect() == []
