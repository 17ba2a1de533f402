"""The trie of conversation prefixes, by truncation peeling.

From the deepest turn upwards: conversations that end at a depth are merged with the nodes that survived from below, each
node's totals are complete as soon as it is found, its last turn is stripped, and the stripped rows are grouped again at
the depth above. Equal conversations are one row from the start. Turns that no other conversation shares are stripped
at once, so there is one round for each depth that two different conversations share, and each round has a row for
each node, not for each conversation.

A prefix is known by two independent 64-bit hashes; texts leave the plan as soon as they are hashed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._common import Stored, ship

NO_ENDS = hashlib.sha256(b"").hexdigest()
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_CLASS = "depth long, a long, b long, conv_id long, n long, total long, ends_sha256 string"


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1, by turn, null first; equal turns by role and text), x and y (hashes of role and text), bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    return rows.select("conv_id", pos.cast("long").alias("pos"), F.xxhash64(F.lit(1), "role", "text").alias("x"), F.xxhash64(F.lit(2), "text", "role").alias("y"), F.octet_length("text").cast("long").alias("bytes"))


def rebuilt(turns: DataFrame, every: int = 5, most: int = 8) -> DataFrame:
    """conv_id, depth, x, y, bytes of the turns, and a row of depth 0 for each conversation: each begins with the first h
    turns of the conversation c - c % every (all if fewer), h = crc32(c) % (most + 1), and goes on with its own after h."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    plan = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), h.alias("h"))
    plan = plan.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    plan = plan.withColumn("took", F.least("h", F.coalesce("n_base", F.lit(0))))
    own = turns.join(plan.select("conv_id", "h", "took"), "conv_id").where("pos > h")
    head = turns.where(F.col("pos") <= most).withColumnRenamed("conv_id", "base").join(plan.select("conv_id", "base", "h"), "base").where("pos <= h")
    return (
        own.select("conv_id", (F.col("took") + F.col("pos") - F.col("h")).alias("depth"), "x", "y", "bytes")
        .union(head.select("conv_id", F.col("pos").alias("depth"), "x", "y", "bytes"))
        .union(sizes.select("conv_id", F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long")))
    )


def _steps(turns: DataFrame) -> DataFrame:
    """conv_id, depth, a and b (hashes of the prefix), bytes (of its last text), upto (of all its texts)."""
    w = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    key = lambda seed: F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(seed), "depth", "x", "y"))
    return turns.select("conv_id", "depth", F.bit_xor(key(1)).over(w).alias("a"), F.bit_xor(key(2)).over(w).alias("b"), "bytes", F.sum("bytes").over(w).alias("upto"))


def _merge(batches):
    """Equal conversations, which follow each other in ascending conv_id, as one row; their ids go through the digest as they come."""
    now, sha, rest = None, None, None

    def done():
        return [*now, *rest, sha.hexdigest()]

    for batch in batches:
        cols = [np.asarray(batch.column(c)) for c in ("depth", "a", "b", "conv_id", "upto")]
        edge = np.flatnonzero(np.any([np.diff(c) != 0 for c in cols[:3]], axis=0)) + 1 if batch.num_rows else []
        out = []
        for i, j in zip([0, *edge], [*edge, batch.num_rows], strict=True):
            if i == j:
                continue
            key, ids = [int(c[i]) for c in cols[:3]], cols[3][i:j].tolist()
            if key != now:
                if now is not None:
                    out.append(done())
                now, sha, rest = key, hashlib.sha256(), [ids[0], 0, int(cols[4][i])]
            elif rest[1]:
                sha.update(b",")
            sha.update(",".join(map(str, ids)).encode())
            rest[1] += len(ids)
        yield _table(out)
    yield _table([done()] if now is not None else [])


def _table(rows: list) -> pa.RecordBatch:
    names, kinds = [x.split()[0] for x in _CLASS.split(", ")], [pa.string() if "string" in x else pa.int64() for x in _CLASS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """RESULT for every distinct prefix of the conversations in `turns` (conv_id, depth, x, y, bytes, as `rebuilt` gives
    them, or any turns numbered from 1 with a row of depth 0 for each conversation).

    conv_id is a node's smallest member. A conversation without turns is a member of the root alone; a table without
    conversations has no node, not even a root. The ids of equal conversations pass through one task in order, as a digest
    of them must, but aren't held there.
    """
    ship(turns.sparkSession)
    steps = Stored(_steps(turns), "steps")
    last = F.max(F.struct("depth", "a", "b", "upto")).alias("s")
    ends = steps.df.groupBy("conv_id").agg(last).select("conv_id", "s.*").repartition("a", "b").sortWithinPartitions("a", "b", "depth", "conv_id")
    classes = Stored(ends.mapInArrow(_merge, _CLASS), "classes")
    own = classes.df.select("conv_id", "n", F.col("depth").alias("last"), "total", F.col("ends_sha256").alias("sha"))
    # One path for each distinct conversation; which of its prefixes others have too.
    paths = Stored(steps.df.where("depth > 0").join(own, "conv_id"), "paths")
    steps.drop()
    twice = Stored(paths.df.groupBy("a", "b").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("a", "b"), "twice")
    shared = Stored(paths.df.join(twice.df, ["a", "b"], "left_semi").select("conv_id", "depth", "a", "b", "bytes", "upto").sortWithinPartitions("depth"), "shared")
    twice.drop()
    top = shared.df.groupBy("conv_id").agg(F.max(F.struct("depth", "a", "b", "bytes", "upto")).alias("s")).select("conv_id", "s.*")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    private = F.col("last") > zero(F.col("depth"))
    enter = own.join(top, "conv_id", "left").select(
        "conv_id", "n", *(zero(F.col(c)).alias(c) for c in ("depth", "a", "b", "bytes")), private.cast("long").alias("child"), private.cast("long").alias("leaves"),
        F.when(private, (F.col("n") - 1) * (F.col("total") - zero(F.col("upto")))).otherwise(F.lit(0)).cast("long").alias("saved"), F.when(~private, F.col("sha")).alias("ends"), "last", "sha", "total",
    )
    enter = Stored(enter, "enter")
    rounds = _peel(enter.df, shared.df)
    parts = [x.df.withColumn("depth", F.lit(d).cast("long")) for d, x in rounds]
    if not parts:
        return turns.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    met = parts[0]
    for p in parts[1:]:
        met = met.unionByName(p)
    # A parent is the node of the prefix one turn shorter.
    stem = shared.df.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"))
    inner = met.join(stem, ["conv_id", "depth"], "left").select("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", zero(F.col("pa")).alias("pa"), zero(F.col("pb")).alias("pb"))
    where = enter.df.select("conv_id", F.col("depth").alias("from"), F.col("a").alias("pa"), F.col("b").alias("pb"))
    alone = paths.df.join(where, "conv_id").where("depth > from")
    is_last = F.col("depth") == F.col("last")
    outer = alone.select(
        "conv_id", "depth", F.col("n").alias("n_convs"), F.when(is_last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("n") - 1) * (F.col("total") - F.col("upto") + F.col("bytes"))).alias("saved_tokens"), F.when(is_last, F.col("sha")).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"), "pa", "pb", "from",
    )
    parent = met.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    joined = inner.unionByName(outer.where("depth = from + 1").drop("from")).join(parent, ["depth", "pa", "pb"], "left").select(*RESULT)
    return joined.unionByName(outer.where("depth > from + 1").withColumn("parent_conv_id", F.col("conv_id")).select(*RESULT))


def _peel(enter: DataFrame, shared: DataFrame) -> list[tuple[int, Stored]]:
    """The nodes that different conversations meet in, and the root, by depth, the deepest first."""
    deepest = enter.agg(F.max("depth")).first()[0]
    rounds, survived = [], None
    for d in range(-1 if deepest is None else deepest, -1, -1):
        active = enter.where(F.col("depth") == d).select("a", "b", "conv_id", "n", "bytes", "child", "leaves", "saved", "ends")
        active = active if survived is None else active.unionByName(survived)
        sums = active.groupBy("a", "b").agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("bytes").alias("bytes"), F.max("ends").alias("ends"))
        nodes = sums.select(
            "a", "b", "conv_id", "n_convs", "n_children", F.when(F.col("n_children") == 0, 1).otherwise(F.col("leaves")).cast("long").alias("n_leaves"),
            (F.col("saved") + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
        )
        rounds.append((d, Stored(nodes, f"depth-{d}")))
        if d:
            below = rounds[-1][1].df.select("conv_id", F.col("n_convs").alias("n"), F.lit(1).cast("long").alias("child"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), F.lit(None).cast("string").alias("ends"))
            if d > 1:
                survived = below.join(shared.where(F.col("depth") == d - 1).select("conv_id", "a", "b", "bytes"), "conv_id")
            else:
                survived = below.withColumns({c: F.lit(0).cast("long") for c in ("a", "b", "bytes")})
            survived = survived.select("a", "b", "conv_id", "n", "bytes", "child", "leaves", "saved", "ends")
    return rounds
