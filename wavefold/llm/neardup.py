"""Near-duplicates by BagMinHash signatures of weighted word shingles.

A document is the bag of its runs of five words. For each shingle, Poisson processes over its discretised weight are
laid out in dyadic blocks of weight ([0,1), [1,2), [2,4), [4,8) ...); a block's points carry a mark in it and those at
or above the shingle's count fall away, so that the points a shingle has at weight w are all among those at a greater
weight. Each point names one signature component, which keeps its smallest point. Two documents agree in a component
with a chance equal to their weighted Jaccard similarity. Points above a document's largest component can't matter, so
processes stop there.

Signatures are cut into bands; documents that agree in a band are candidates and are verified by the exact overlap of
their bags. Copies with the same words are one node from the start. In a bucket everyone is compared with one leader,
links are joined to components, and only in buckets still holding several components are members compared across
components, where they share a shingle that the leader lacks or could be linked without one; so a bucket of n like
documents costs n comparisons.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ._common import LETTERS, Filter, Stored, mix, ngram_hashes, ship, signed, slices, table
from .components import components
from .decontaminate import each

SHINGLE, BANDS, ROWS, SIMILARITY = 5, 32, 6, 0.8
_U = np.uint64
_G = _U(0x9E3779B97F4A7C15)


def bag(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a text's word hashes: the distinct shingles' hashes, sorted, and their counts. Fewer than five words are one shingle."""
    return np.unique(ngram_hashes(h, min(SHINGLE, len(h))), return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash of each (hashes, counts), as doubles; infinite where a bag is empty."""
    sig = np.full(len(bags) * m, np.inf)
    if not bags:
        return sig.reshape(0, m)
    doc = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    h, w = np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags])
    parts, low, size, block = [], 0, 1, 0
    while True:
        has = w > low
        if not has.any():
            break
        parts.append((doc[has], mix(h[has] + _U((2 * block + 1) * int(_G) % 2**64)), np.full(int(has.sum()), low), np.full(int(has.sum()), size), w[has]))
        low, size, block = low + size, max(1, low + size), block + 1
    doc, seed, low_, size_, w = (np.concatenate(x) for x in zip(*parts, strict=True))
    x, top, k = np.zeros(len(doc)), np.full(len(bags), np.inf), 0
    while len(doc):
        k += 1
        seed = seed + _G
        r = mix(seed)
        x = x - np.log(((r >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / (size_ * float(m))
        keep = x < top[doc]
        if not keep.all():
            doc, seed, low_, size_, w, x, r = (a[keep] for a in (doc, seed, low_, size_, w, x, r))
        r = mix(r ^ _U(0xA5A5A5A5DEADBEEF))
        to = doc * m + ((r >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
        below = low_ + ((r & _U(0xFFFFFFFF)) * size_.astype(_U) >> _U(32)).astype(np.int64) < w
        np.minimum.at(sig, to[below] if not below.all() else to, x[below] if not below.all() else x)
        if k < 8 or k % 8 == 0:
            top = sig.reshape(-1, m).max(axis=1)
    return sig.reshape(-1, m)


def _bands(sig: np.ndarray) -> np.ndarray:
    bits = np.ascontiguousarray(sig).view(_U).reshape(len(sig), BANDS, ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=_U), (len(sig), BANDS)).copy()
    for j in range(ROWS):
        out = mix(out * _G + bits[:, :, j])
    return out


def _signed_rows(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in slices(batches):
            content, bags = [], []
            texts = b.column("text").to_pylist()
            for text, words, h in zip(texts, LETTERS.normal(texts), each(texts), strict=True):
                content.append(_content(text, words))
                bags.append(bag(h))
            keys = _bands(signatures(bags))
            col = pa.array([signed(k) if len(x[0]) else None for k, x in zip(keys, bags, strict=True)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(content, pa.binary()), col], ["doc_id", "text_hash", "content", "bands"])

    return docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, content binary, bands array<long>")


def _bags(docs: DataFrame, wanted: DataFrame, first_ids: Filter) -> DataFrame:
    """node, shingles (64-bit hashes, repeated by count, sorted) of the wanted nodes (content, node), whose text is that of
    one of the doc_ids in the filter, or of a row without: other texts aren't looked at, and none is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(first_ids)  # 64 MB at most

    def run(batches):
        for b in batches:
            ids = b.column("doc_id")
            some = b.filter(pa.array(shared.value.may_hold(np.asarray(pc.fill_null(ids, 0))) | (np.asarray(ids.is_null()))))
            for s in slices(iter([some])):
                texts = s.column("text").to_pylist()
                content = [_content(t, w) for t, w in zip(texts, LETTERS.normal(texts), strict=True)]
                rows = [signed(np.repeat(*bag(h))) for h in each(texts)]
                yield pa.RecordBatch.from_arrays([pa.array(content, pa.binary()), pa.array(rows, pa.list_(pa.int64()))], ["content", "shingles"])

    got = docs.mapInArrow(run, "content binary, shingles array<long>")
    return got.groupBy("content").agg(F.first("shingles").alias("shingles")).join(wanted, "content").select("node", "shingles")


def _content(text: str | None, words: bytes) -> bytes:
    """Digest of a text's words, or of the text where it has none."""
    return xxhash.xxh3_128_digest(words or (text or "").encode("utf-8", "surrogatepass"), seed=int(len(words) > 0))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted bags."""
    u, first, n = np.unique(a, return_index=True, return_counts=True)
    v, _, m = np.unique(b, return_index=True, return_counts=True)
    at = np.minimum(np.searchsorted(v, u), len(v) - 1)
    return int(np.minimum(n, m[at])[v[at] == u].sum()) if len(u) and len(v) else 0


def _overlaps(pairs: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """u, v, shared, nu, nv, similar of each pair (u, v): the exact overlap of the two bags and their sizes."""

    def run(batches):
        for b in batches:
            u, v, x, y = (b.column(c) for c in ("u", "v", "x", "y"))
            shared, nu, nv = (np.zeros(b.num_rows, np.int32) for _ in range(3))
            for k in range(b.num_rows):
                p, q = x[k].values.to_numpy().view(_U), y[k].values.to_numpy().view(_U)
                shared[k], nu[k], nv[k] = overlap(p, q), len(p), len(q)
            similar = shared >= similarity * (nu + nv - shared) - 1e-9
            yield pa.RecordBatch.from_arrays([u, v, pa.array(shared), pa.array(nu), pa.array(nv), pa.array(similar)], ["u", "v", "shared", "nu", "nv", "similar"])

    a = bags.select(F.col("node").alias("u"), F.col("shingles").alias("x"))
    b = bags.select(F.col("node").alias("v"), F.col("shingles").alias("y"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "x", "y").mapInArrow(run, "u long, v long, shared int, nu int, nv int, similar boolean")


def _inside(left: DataFrame, similarity: float) -> DataFrame:
    """Pairs of one leader and two components that could be linked by what they share with the leader alone.

    The overlap then is at most the smaller of theirs with the leader, a, so both a must reach t (n + n'), t = s / (1 + s).
    One of the two isn't linked to the leader itself; its a and n leave a range for the other's n, which is met by bins.
    """
    t, grid = similarity / (1 + similarity), 1.05
    bin_ = lambda x: F.floor(F.log(F.greatest(x.cast("double"), F.lit(1.0))) / F.log(F.lit(grid))).cast("int")
    low, high = F.col("n") * similarity, F.least(F.col("a") / t - F.col("n") + 1e-6, F.col("n") / similarity)
    x = left.where(~F.col("similar") & (high >= low)).select("leader", F.col("node").alias("p"), F.col("c").alias("cp"), F.col("a").alias("ap"), F.col("n").alias("np"), F.explode(F.sequence(bin_(low), bin_(high))).alias("bin"))
    y = left.select("leader", F.col("node").alias("q"), F.col("c").alias("cq"), F.col("a").alias("aq"), F.col("n").alias("nq"), bin_(F.col("n")).alias("bin"))
    able = F.least("ap", "aq") >= t * (F.col("np") + F.col("nq")) - 1e-6
    return x.join(y, (x["leader"] == y["leader"]) & (x["bin"] == y["bin"]) & (F.col("cp") != F.col("cq")) & able).select(F.greatest("p", "q").alias("u"), F.least("p", "q").alias("v"))


def _outside(left: DataFrame, bags: DataFrame, similarity: float) -> tuple[DataFrame, Stored]:
    """Pairs of one leader and two components that share shingles the leader lacks, where a link is possible at all.

    The overlap is at most the smaller a and what the remainders share, so a document must share at least
    t (n + n') - a of its remainder, for the least n' of its leader's documents that it could be like. Of tokens in one
    order, the rarest first, two that share so many share one of each document's first |remainder| - that + 1. Beside them a table they are read from.
    """
    t = similarity / (1 + similarity)
    bin_ = F.floor(F.log("n") / F.log(F.lit(1.05))).cast("int")
    sizes = left.groupBy("leader", bin_.alias("bin")).agg(F.min("n").alias("m")).groupBy("leader").agg(F.collect_list("m").alias("sizes"))  # a number for each twentieth

    def run(batches):
        for b in batches:
            lengths, flat, share = [], [], []
            for x, y, n, a, near in zip(b.column("x"), b.column("y"), b.column("n").to_pylist(), b.column("a").to_pylist(), b.column("sizes"), strict=True):
                p, c = np.unique(x.values.to_numpy(), return_counts=True)
                q, m = np.unique(y.values.to_numpy(), return_counts=True)
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                over = c - np.minimum(c, np.where(q[at] == p, m[at], 0))
                tokens = np.repeat(p.view(_U), over)
                again = np.arange(len(tokens)) - np.repeat(np.cumsum(over) - over, over)
                flat.append(signed(mix(tokens + again.astype(_U) * _G)))
                lengths.append(len(tokens))
                # The least size met in a twentieth below may stand for larger ones there.
                other = max(similarity * n, min((k for k in near.values.to_pylist() if k * 1.06 + 1 >= similarity * n), default=n))
                share.append(max(1, int(np.ceil(t * (n + other) - a - 1e-6))))
            rows = np.repeat(np.arange(b.num_rows), lengths)
            cols = [b.column(k).take(pa.array(rows)) for k in ("leader", "node", "c", "a", "n")]
            tokens = np.concatenate(flat) if flat else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.array(share, np.int32)[rows]), pa.array(tokens)], ["leader", "node", "c", "a", "n", "share", "s"])

    both = left.drop("similar").join(sizes, "leader").join(bags.select("node", F.col("shingles").alias("x")), "node").join(bags.select(F.col("node").alias("leader"), F.col("shingles").alias("y")), "leader")
    kept = Stored(both.select("leader", "node", "c", "a", "n", "sizes", "x", "y").mapInArrow(run, "leader long, node long, c long, a int, n int, share int, s long"), "rest")
    rest = kept.df
    many = rest.groupBy("leader", "s").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    own = Window.partitionBy("leader", "node")  # no more rows than a document has shingles
    met = rest.join(many, ["leader", "s"]).withColumn("m", F.count(F.lit(1)).over(own)).where("m >= share")
    met = met.withColumn("r", F.row_number().over(own.orderBy("k", "s"))).where("r <= m - share + 1").select("leader", "s", "node", "c", "a", "n")
    x, y = met.toDF("leader", "s", "u", "cu", "au", "nu"), met.toDF("leader", "s", "v", "cv", "av", "nv")
    most = F.least("au", "av") + F.least(F.col("nu") - F.col("au"), F.col("nv") - F.col("av"))
    able = most >= similarity * (F.col("nu") + F.col("nv") - most) - 1e-9
    return x.join(y, (x["leader"] == y["leader"]) & (x["s"] == y["s"]) & (F.col("u") > F.col("v")) & (F.col("cu") != F.col("cv")) & able).select("u", "v"), kept


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the least doc_id of its group of near-copies), n_copies (rows with exactly its words),
    group (a number of its group, never null) and text_hash (xxhash64 of the text: with doc_id, what names a row).

    Two documents are linked if they agree in a band and their bags of five-word shingles have a weighted Jaccard
    similarity of at least `similarity`; groups are the components of links. Documents without a word are alike only if
    their texts are equal (null and empty are). Rows that share a doc_id are documents of their own: those with other
    words may be in other groups. Rows with a null doc_id are judged like all others; a group of such rows alone has a null
    class. An empty table gives no rows; other columns aren't looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    base = table(docs)
    rows = Stored(_signed_rows(base), "signed").df
    # One node for equal words, with a number of its own.
    first = F.min("doc_id").alias("first_id")
    nodes = Stored(rows.groupBy("content").agg(first, F.count(F.lit(1)).alias("n_copies"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()), "nodes").df
    buckets = nodes.where("bands is not null").select("node", F.explode("bands").alias("b"))
    crowded = buckets.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = Stored(buckets.join(crowded, "b"), "buckets")
    # The leader of a bucket is the member that meets most others in all its buckets: of a group of copies, the most
    # central one, to which the others are nearest.
    fame = met.df.groupBy("node").agg(F.sum("n").alias("fame"))
    best = F.max(F.struct("fame", (-F.col("node")).alias("m")))
    led = met.df.join(fame, "node").groupBy("b").agg(best.alias("l")).select("b", (-F.col("l.m")).alias("leader"))
    members = Stored(met.df.join(led, "b").select("b", "node", "leader", F.greatest("node", "leader").alias("u"), F.least("node", "leader").alias("v")), "members")
    met.drop()
    wanted = Stored(nodes.select("node", "content", "first_id").join(members.df.select("node").distinct(), "node"), "wanted")
    bags = Stored(_bags(base, wanted.df.select("content", "node"), Filter(wanted.df.select("first_id"), wanted.df.count())), "bags")
    wanted.drop()
    pairs = members.df.where("u <> v").select("u", "v").distinct()
    tried = Stored(_overlaps(pairs, bags.df, similarity), "overlaps")
    links = tried.df.where("similar").select("u", "v")
    found = components(links)
    # Buckets with several components: pairs across them that a link is still possible for.
    own = members.df.join(found.df, "node", "left").withColumn("c", F.coalesce("class", "node"))
    mixed = own.groupBy("b").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi and n > 2").select("b")
    size = F.when(F.col("node") == F.col("u"), F.col("nu")).otherwise(F.col("nv"))
    left = Stored(own.join(mixed, "b").where("u <> v").select("node", "leader", "c", "u", "v").distinct().join(tried.df, ["u", "v"]).select("node", "leader", "c", F.col("shared").alias("a"), size.alias("n"), "similar").distinct(), "mixed")
    members.drop()
    outside, rest = _outside(left.df, bags.df, similarity)
    more = _inside(left.df, similarity).union(outside).distinct()
    late = Stored(_overlaps(more.join(tried.df.select("u", "v"), ["u", "v"], "left_anti"), bags.df, similarity).where("similar").select("u", "v"), "links")
    for x in (rest, left, bags):
        x.drop()
    if late.df.limit(1).count():
        found.drop()
        found = components(links.union(late.df))
    late.drop()
    tried.drop()
    least = found.df.join(nodes.select("node", "first_id"), "node").groupBy("class").agg(F.min("first_id").alias("class_id"))
    classes = found.df.join(least, "class").select("node", "class", "class_id")
    own_id = F.when(F.col("class").isNull(), F.col("first_id")).otherwise(F.col("class_id")).alias("class_id")
    named = nodes.join(classes, "node", "left").select("content", "n_copies", own_id, F.coalesce("class", "node").alias("group"))
    return rows.select("doc_id", "text_hash", "content").join(named, "content").select("doc_id", "class_id", "n_copies", "group", "text_hash")
