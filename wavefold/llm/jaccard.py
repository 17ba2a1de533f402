"""Join of documents whose sets of word n-grams are alike, by rare-first prefix filtering.

A document is its set of distinct runs of five words; documents of the same words are one node. With a set's n-grams in
one order for all sets, the rarest first, two sets that overlap in `o` n-grams share one of the first |set| - o + 1 of each.
So only these prefixes are joined, and of what meets there only pairs pass whose lengths, places in the order (what comes
after both places bounds the overlap) and suffixes (ranges of the hash bound it too) allow a link; these are verified once.

Two steps keep this small. First, a set can only be linked if enough of its n-grams are in other sets: this is asked
of a part of each set alone, its least hashes, of which two alike sets share at least as many as each asks for. N-grams
are counted, and put in order, among the sets that are left. Second, in a prefix n-gram of very many sets not all pairs are formed:
everyone is compared with one leader, links are joined to components, and only where a bucket still holds several are its
members compared across components, where a link is possible at all (see `neardup`); no link between components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ._common import Filter, Stored, Words, ngram_hashes, ship, signed, slices, table
from .components import components
from .neardup import _inside, _outside, _overlaps

N, PERCENT = 5, 80
#: Prefix n-grams of up to so many sets have all their pairs formed.
SMALL = 24
_U = np.uint64
_ALL = np.arange(256)
WORDS = Words(~np.isin(_ALL, [32, 9, 10, 11, 12, 13]), np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL + 32, _ALL))


def shingles(h: np.ndarray) -> np.ndarray:
    """The distinct n-grams' hashes of a text's word hashes, sorted; fewer than five words are one n-gram, none are none."""
    return np.unique(ngram_hashes(h, min(N, len(h))))


def least(n: int) -> int:
    """The least overlap of a set of n with one it is linked to."""
    return -(-PERCENT * n // 100)


def asked(n: int) -> int:
    """How many n-grams two alike sets share at least among what `part` takes of both, by the smaller set's size."""
    return max(1, n // 8)


def part(n: int) -> int:
    """So many of a set's n-grams of least hash hold `asked(n)` of every set it is linked to, and these hold them too."""
    return n - least(n) + asked(n)


def _each(texts: list[str | None]) -> list[np.ndarray]:
    h, first = WORDS.hashes(texts)
    return [shingles(h[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _contents(texts: list[str | None]) -> list[bytes | None]:
    """Digest of each text's words; null where there are none."""
    return [xxhash.xxh3_128_digest(w) if w else None for w in WORDS.normal(texts)]


def _read(docs: DataFrame) -> DataFrame:
    """doc_id, content, n (size of the set), part (its n-grams of least hash)."""

    def run(batches):
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            sets = _each(texts)
            some = [s[: part(len(s))] if len(s) else s for s in sets]
            flat = pa.array(signed(np.concatenate(some)), pa.int64())
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in some])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(_contents(texts), pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "content", "n", "part"])

    return docs.mapInArrow(run, "doc_id long, content binary, n long, part array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, first_ids: Filter) -> DataFrame:
    """node, shingles (sorted) of the wanted nodes (content, node), from the texts of the doc_ids in the filter and of rows without one."""
    shared = docs.sparkSession.sparkContext.broadcast(first_ids)  # 64 MB at most

    def run(batches):
        for b in batches:
            ids = b.column("doc_id")
            some = b.filter(pa.array(shared.value.may_hold(np.asarray(ids.fill_null(0))) | np.asarray(ids.is_null())))
            for s in slices(iter([some])):
                texts = s.column("text").to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(_contents(texts), pa.binary()), pa.array([signed(x) for x in _each(texts)], pa.list_(pa.int64()))], ["content", "shingles"])

    got = docs.mapInArrow(run, "content binary, shingles array<long>").where("content is not null")
    return got.join(wanted, "content").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _prefixes(sets: DataFrame) -> DataFrame:
    """s (n-gram), node, n, pos (its place in the set, the rarest first): the prefix n-grams that some other set has too."""
    grams = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    often = Stored(grams.groupBy("s").agg(F.count(F.lit(1)).cast("int").alias("df")).where("df > 1"), "often")
    met = grams.join(often.df, "s").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("o"))  # no more than the set has
    # Those that no other set has come first; their order doesn't matter.
    alone = F.col("n") - F.size("o")
    first = F.col("n") - F.ceil(F.col("n") * PERCENT / 100.0) + 1 - alone
    return met.where(first > 0).select("node", "n", alone.alias("alone"), F.posexplode(F.slice("o", F.lit(1), first.cast("int"))).alias("k", "o")).select(F.col("o.s").alias("s"), "node", "n", (F.col("alone") + F.col("k")).alias("pos"))


def _small_pairs(prefixes: DataFrame) -> DataFrame:
    """u, v of the pairs of one n-gram that lengths and places allow."""
    a = prefixes.select("s", F.col("node").alias("u"), F.col("n").alias("nu"), F.col("pos").alias("pu"))
    b = prefixes.select("s", F.col("node").alias("v"), F.col("n").alias("nv"), F.col("pos").alias("pv"))
    lengths = F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * PERCENT
    # Of the first common n-gram this holds for every linked pair.
    places = F.least(F.col("nu") - F.col("pu"), F.col("nv") - F.col("pv")) * (100 + PERCENT) >= (F.col("nu") + F.col("nv")) * PERCENT
    return a.join(b, (a["s"] == b["s"]) & (F.col("u") > F.col("v")) & lengths & places).select("u", "v").distinct()


def suffix_bound(a: np.ndarray, b: np.ndarray, pieces: int = 16) -> int:
    """No less than the overlap of two sorted sets: both are cut at the same values, and of each piece the smaller part counts."""
    cuts = a[np.linspace(0, len(a) - 1, pieces + 1).astype(np.int64)[1:-1]]
    x, y = (np.diff(np.concatenate([[0], np.searchsorted(s, cuts), [len(s)]])) for s in (a, b))
    return int(np.minimum(x, y).sum())


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that are links; sets are read through only where their pieces allow it."""

    def run(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for k, (x, y) in enumerate(zip(b.column("x"), b.column("y"), strict=True)):
                p, q = x.values.to_numpy().view(_U), y.values.to_numpy().view(_U)
                need = PERCENT * (len(p) + len(q))
                if (100 + PERCENT) * suffix_bound(p, q) >= need:
                    at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                    keep[k] = (100 + PERCENT) * int((q[at] == p).sum()) >= need
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(keep)) for c in ("u", "v")], ["u", "v"])

    x, y = sets.select(F.col("node").alias("u"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("v"), F.col("shingles").alias("y"))
    return pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def _crowded_links(crowded: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
    """Links (u, v) that join what the pairs of very frequent prefix n-grams would join."""
    rate = PERCENT / 100
    fame = crowded.groupBy("node").agg(F.count(F.lit(1)).alias("fame"))
    led = crowded.join(fame, "node").groupBy("s").agg(F.max(F.struct("fame", (-F.col("node")).alias("m"))).alias("l")).select("s", (-F.col("l.m")).alias("leader"))
    members = Stored(crowded.join(led, "s").select("s", "node", "leader", F.greatest("node", "leader").alias("u"), F.least("node", "leader").alias("v")), "members")
    tried = Stored(_overlaps(members.df.where("u <> v").select("u", "v").distinct(), sets, rate), "overlaps")
    near = tried.df.where("similar").select("u", "v")
    found = components(links.union(near))
    own = members.df.join(found.df, "node", "left").withColumn("c", F.coalesce("class", "node"))
    mixed = own.groupBy("s").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("s")
    size = F.when(F.col("node") == F.col("u"), F.col("nu")).otherwise(F.col("nv"))
    left = Stored(own.join(mixed, "s").where("u <> v").select("node", "leader", "c", "u", "v").distinct().join(tried.df, ["u", "v"]).select("node", "leader", "c", F.col("shared").alias("a"), size.alias("n"), "similar").distinct(), "mixed")
    outside, rest = _outside(left.df, sets, rate)
    more = Stored(_inside(left.df, rate).union(outside).distinct().join(tried.df.select("u", "v"), ["u", "v"], "left_anti"), "across")
    for x in (rest, left, members, found):
        x.drop()
    return near.union(_verified(more.df, sets))


def near_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles (distinct five-word n-grams), component_id (the least doc_id reachable by links, its own included),
    n_copies (rows with exactly its words) for every row of docs.

    Words are runs of anything but ASCII white space, A-Z made small. Two documents are linked if 100 times the
    intersection of their sets is at least 80 times the union. Fewer than five words are one n-gram; null, empty and blank
    texts have none, are linked with nothing and count as copies of nothing. Rows that share a doc_id are documents of
    their own; rows without a doc_id are linked like others, and a component of such rows alone has a null id. An empty table
    gives no rows; other columns aren't looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    base = table(docs)
    rows = Stored(_read(base), "read")
    told = rows.df.where("content is not null")
    first = [F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_copies"), F.first("n").alias("n"), F.first("part").alias("part")]
    nodes = Stored(told.groupBy("content").agg(*first).withColumn("node", F.monotonically_increasing_id()), "nodes")
    # The first step: n-grams of the parts that several contents have.
    grams = nodes.df.select("node", "n", F.explode("part").alias("s"))
    several = Stored(grams.groupBy("s").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("s"), "several")
    held = grams.join(several.df, "s", "left_semi").groupBy("node", "n").agg(F.count(F.lit(1)).alias("k"))
    need = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * PERCENT / 100.0) / 8))
    wanted = Stored(nodes.df.select("node", "content", "first_id").join(held.where(F.col("k") >= need).select("node"), "node"), "wanted")
    several.drop()
    sets = Stored(_sets(base, wanted.df.select("content", "node"), Filter(wanted.df.select("first_id"), wanted.df.count())), "sets")
    wanted.drop()
    prefixes = Stored(_prefixes(sets.df), "prefixes")
    met = prefixes.df.groupBy("s").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    few = prefixes.df.join(met.where(F.col("k") <= SMALL).select("s"), "s", "left_semi")
    links = Stored(_verified(_small_pairs(few), sets.df), "links")
    crowded = Stored(prefixes.df.join(met.where(F.col("k") > SMALL).select("s"), "s", "left_semi").select("s", "node"), "crowded")
    prefixes.drop()
    every = links.df
    if crowded.df.limit(1).count():
        every = Stored(links.df.union(_crowded_links(crowded.df, sets.df, links.df)), "links").df
    found = components(every)
    for x in (sets, crowded):
        x.drop()
    ids = found.df.join(nodes.df.select("node", "first_id"), "node").groupBy("class").agg(F.min("first_id").alias("component_id"))
    named = nodes.df.join(found.df.join(ids, "class").select("node", "class", "component_id"), "node", "left")
    own = F.when(F.col("class").isNull(), F.col("first_id")).otherwise(F.col("component_id"))
    named = named.select("content", own.alias("component_id"), "n_copies")
    return rows.df.select("doc_id", "content", "n").join(named, "content", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("content").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies")
    )
