"""Prefix trie of conversations: which beginnings are shared, by how many, and what sharing them saves.

Turns become digests with their bytes; conversations are numbered by ranges of a global sort, so that one of any length is no task of its own. A
node's key combines the digests of its turns with their positions, and is known for every row by prefix sums. Distinct keys are enumerated by
partial aggregation and checked: all rows of a key must have the same turn, depth and parent key, else other keys are drawn.
Nodes that many conversations share (a bounded number) form the top; below it every subtree belongs to one shard, whose task gives each key a slot by a
minimal perfect hash, verifies it there, scatters the counts into flat arrays and adds them up through the slots of the parents, deepest nodes first.
What the shards' subtrees amount to is then scattered into the top's arrays in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.common import bounded_batches, fold, joined_by_key, partitions, stored

#: Turns of a block, over which prefix sums are taken on their own.
BLOCK = 4096
#: There are at most so many nodes in the top.
TOP = 50_000
#: A node of so few conversations is never in the top.
FEW = 100
#: Nodes for each shard, about.
SHARD = 200_000
_TABLE = "conv long, depth long, d1 long, d2 long, p1 long, p2 long, n long, below long, ends long, end_conv long, parent_conv long, n_children long, n_leaves long, saved long"
_NO_ONE = hashlib.sha256().hexdigest()


def ordered(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The turns of each conversation in order: conv, depth (from 1), turn_a, turn_b (120 bits of the SHA-256 of role and text), bytes (of the text), length (turns of the conversation).

    Null turns come first, equal turns in the order of their digests; null roles and texts are empty. Rows without a conversation id belong to none and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    sha = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), sha.alias("sha"), F.octet_length(text).cast("long").alias("bytes"))
    half = lambda k: F.conv(F.substring("sha", k, 15), 16, 10).cast("long")
    rows = rows.select("conv", "turn", half(1).alias("turn_a"), half(16).alias("turn_b"), "bytes", F.monotonically_increasing_id().alias("row"))
    order = ["conv", "turn", "turn_a", "turn_b", "row"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn_a", "turn_b", "bytes", F.monotonically_increasing_id().alias("at"))
    rows = stored(rows, "turns").withColumn("part", F.shiftright("at", 33))
    # a conversation has a row here for each range that holds turns of it
    bounds = rows.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bounds = bounds.select("conv", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy("conv")).alias("length"))
    rows = rows.join(bounds, ["conv", "part"])
    return rows.select("conv", (F.col("at") - F.col("first") + F.col("start") + 1).alias("depth"), "turn_a", "turn_b", "bytes", "length")


def rebuilt(turns: DataFrame, group: int = 5, most: int = 8) -> DataFrame:
    """Every conversation c of `ordered` turns with its first h turns taken from conversation c - c % group (all it has, if they are fewer), h = crc32(c) % (most + 1).

    conv, depth, turn_a, turn_b, bytes, length; a conversation without a turn left has one row of depth 0, with nulls. % keeps the sign, as in SQL.
    """
    turns = stored(turns, "ordered")
    head = fold(F.col("conv"), most + 1).cast("long")
    whole = turns.filter("depth = 1").select("conv", "length", head.alias("h"), (F.col("conv") - F.col("conv") % group).alias("base"))
    bases = whole.select(F.col("conv").alias("base"), F.col("length").alias("base_length"))
    whole = whole.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_length", F.lit(0))))
    whole = stored(whole.withColumn("full", F.col("taken") + F.greatest(F.col("length") - F.col("h"), F.lit(0))), "rebuilt")
    mine = turns.filter(F.col("depth") > head)
    # a conversation of any length: how far its turns move is joined by its size
    mine = joined_by_key(mine.drop("length"), whole.select("conv", "h", "taken", "full", "length"), ["conv"], "length")
    mine = mine.select("conv", (F.col("taken") + F.col("depth") - F.col("h")).alias("depth"), "turn_a", "turn_b", "bytes", F.col("full").alias("length"))
    first = turns.filter((F.col("depth") <= most) & (F.col("conv") % group == 0)).select(F.col("conv").alias("base"), "depth", "turn_a", "turn_b", "bytes")
    theirs = first.join(whole.select("base", "conv", "h", "full"), "base").filter("depth <= h")
    none = whole.filter("full = 0").select("conv", F.lit(0).cast("long").alias("depth"), *[F.lit(None).cast("long").alias(c) for c in ("turn_a", "turn_b", "bytes")], F.col("full").alias("length"))
    return mine.unionByName(theirs.select("conv", "depth", "turn_a", "turn_b", "bytes", F.col("full").alias("length"))).unionByName(none)


def _keyed(turns: DataFrame, draw: int) -> DataFrame:
    """A row for each conversation and prefix: conv, depth, turn_a, turn_b, bytes, d1, d2 (key), p1, p2 (the parent's key), last. Key 0, 0 is that of the root."""
    own = [F.xxhash64("depth", "turn_a", "turn_b", F.lit(2 * draw + k)) for k in (0, 1)]
    rows = turns.filter("depth > 0").select("*", own[0].alias("x1"), own[1].alias("x2"), F.expr(f"(depth - 1) div {BLOCK}").alias("block"))
    upto = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"b{k}": F.bit_xor(f"x{k}").over(upto) for k in (1, 2)})
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # only conversations of more than one block need the sums of the blocks before
    blocks = rows.filter(f"length > {BLOCK}").groupBy("conv", "block").agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"))
    blocks = blocks.select("conv", "block", *[F.coalesce(F.bit_xor(f"s{k}").over(before), F.lit(0)).alias(f"o{k}") for k in (1, 2)])
    rows = rows.join(blocks, ["conv", "block"], "left")
    d = [F.col(f"b{k}").bitwiseXOR(F.coalesce(F.col(f"o{k}"), F.lit(0))) for k in (1, 2)]
    rows = rows.select("conv", "depth", "turn_a", "turn_b", "bytes", d[0].alias("d1"), d[1].alias("d2"), d[0].bitwiseXOR(F.col("x1")).alias("p1"), d[1].bitwiseXOR(F.col("x2")).alias("p2"), (F.col("depth") == F.col("length")).alias("last"))
    zero = F.lit(0).cast("long")
    root = turns.filter("depth <= 1").select("conv", *[zero.alias(c) for c in ("depth", "turn_a", "turn_b", "bytes", "d1", "d2", "p1", "p2")], (F.col("length") == 0).alias("last"))
    return rows.unionByName(root)


def _enumerated(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of `_keyed` and the distinct keys: conv (smallest member), depth, d1, d2, p1, p2, n, bytes, ends, end_conv. Keys that two sequences share are drawn again."""
    turns = stored(turns, "sequences")
    for draw in range(8):
        rows = stored(_keyed(turns, draw), "prefixes")
        same = ("depth", "turn_a", "turn_b", "p1", "p2")
        nodes = rows.groupBy("d1", "d2").agg(
            F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes"), F.count_if("last").alias("ends"), F.min(F.when(F.col("last"), F.col("conv"))).alias("end_conv"),
            *[F.min(c).alias(c) for c in same], *[F.max(c).alias(f"{c}_max") for c in same],
        )
        nodes = stored(nodes, "nodes")
        clash = " or ".join(f"{c} <> {c}_max" for c in same)
        if not nodes.filter(clash).limit(1).count():
            return rows, nodes.drop("turn_a", "turn_b", *[f"{c}_max" for c in same])
    raise ValueError("prefix keys collide in every draw")


class PerfectHash:
    """Minimal perfect hash of distinct pairs of numbers: at each level the keys that meet no other get the next slots, the rest go on."""

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        rest, placed = np.arange(len(a)), 0
        while len(rest):
            if len(self.levels) > 60:
                raise ValueError("a key occurs twice")
            at = self._at(a[rest], b[rest], len(self.levels), 2 * len(rest) + 1)
            alone = np.bincount(at, minlength=2 * len(rest) + 1) == 1
            self.levels.append((alone, placed - 1 + np.cumsum(alone)))
            placed += int(alone.sum())
            rest = rest[~alone[at]]
        slots = self._slots(a, b)
        self.a, self.b = np.empty_like(a), np.empty_like(b)
        self.a[slots], self.b[slots] = a, b

    @staticmethod
    def _at(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        x = a.astype(np.uint64) ^ (b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * level))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(size)).astype(np.int64)

    def _slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found, rest = np.full(len(a), -1), np.arange(len(a))
        for level, (alone, ranks) in enumerate(self.levels):
            at = self._at(a[rest], b[rest], level, len(alone))
            hit = alone[at]
            found[rest[hit]] = ranks[at[hit]]
            rest = rest[~hit]
        return found

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The keys' slots; -1 where the key kept there is another one."""
        found = self._slots(a, b)
        if not len(self.a):
            return found
        return np.where((found >= 0) & (self.a[found] == a) & (self.b[found] == b), found, -1)


def _added_up(table: pa.Table) -> pa.Table:
    """One shard: its nodes with children, leaves and savings of their subtrees, and the parent's smallest member (null where the parent is in no slot here)."""
    col = {c: table.column(c).to_numpy() for c in ("conv", "depth", "d1", "d2", "p1", "p2", "n", "bytes", "below", "more_children", "more_leaves", "more_saved")}
    table_of = PerfectHash(col["d1"], col["d2"])
    slot = table_of.slots(col["d1"], col["d2"])
    size = len(slot)

    def flat(values: np.ndarray) -> np.ndarray:
        out = np.zeros(size, np.int64)
        out[slot] = values
        return out

    parent = np.full(size, -1)
    parent[slot] = np.where(col["depth"] > 0, table_of.slots(col["p1"], col["p2"]), -1)
    conv, depth, leaves = flat(col["conv"]), flat(col["depth"]), flat(col["more_leaves"])
    saved = flat((col["n"] - 1) * col["bytes"] + col["more_saved"])
    children = flat(col["more_children"] + col["below"]) + np.bincount(parent[parent >= 0], minlength=size)
    order = np.argsort(-depth, kind="stable")
    starts = np.flatnonzero(np.diff(depth[order], prepend=-1))
    for a, b in zip(starts, [*starts[1:], size], strict=True):
        now = order[a:b]
        leaves[now] = np.maximum(leaves[now], 1)  # a node that nothing below has added to is a leaf, or the first of a chain that ends in one
        now = now[parent[now] >= 0]
        np.add.at(leaves, parent[now], leaves[now])
        np.add.at(saved, parent[now], saved[now])
    above = parent[slot]
    names = ("conv", "depth", "d1", "d2", "p1", "p2", "n", "below", "ends", "end_conv")
    return pa.table({
        **{c: table.column(c) for c in names}, "parent_conv": pa.array(conv[above], mask=above < 0), "n_children": children[slot], "n_leaves": leaves[slot], "saved": saved[slot]
    })


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined ids of each key, from rows in the order of key and id."""
    key, digest, done = None, hashlib.sha256(), []
    for batch in batches:
        d1, d2, conv = (batch.column(c).to_numpy() for c in ("d1", "d2", "conv"))
        cuts = np.flatnonzero(np.append(True, (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1]))) if len(d1) else []
        for a, b in zip(cuts, [*cuts[1:], len(d1)], strict=True):
            if (d1[a], d2[a]) != key:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = (d1[a], d2[a]), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(",".join(map(str, conv[a:b].tolist())).encode())
        yield _ends(done)
        done = []
    if key is not None:
        yield _ends([(*key, digest.hexdigest())])


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"d1": pa.array([r[0] for r in rows], pa.int64()), "d2": pa.array([r[1] for r in rows], pa.int64()), "ends_sha256": pa.array([r[2] for r in rows], pa.string())})


def _one(conv: Column) -> Column:
    return F.sha2(conv.cast("string").cast("binary"), 256)


def nodes(turns: DataFrame, top: int = TOP, few: int = FEW, shard: int = SHARD) -> DataFrame:
    """The trie of turns (as of `ordered` or `rebuilt`), a row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Two turns are equal if their digests are. A node shared by more conversations than a top of `top` nodes allows is in the top; a node of one
    conversation whose parent is of that conversation too needs no table: its values follow from its row. The ids of conversations that end in one node are
    hashed as they stream by, sorted; one task does so for a node, as the hash of a text cannot be split. An empty table has no nodes, not even a root.
    """
    spark = turns.sparkSession
    bounded_batches(spark)
    rows, found = _enumerated(turns)
    limit = max(1, few, rows.count() // top)
    heavy = found.filter((F.col("n") > limit) | (F.col("depth") == 0))  # each has more than `limit` rows: there are at most `top`, and the root
    light = found.filter((F.col("n") <= limit) & (F.col("depth") > 0)).withColumn("below", F.when(F.col("n") == 1, 1 - F.col("ends")).otherwise(0).cast("long"))
    single = light.filter("n = 1")
    heads = single.groupBy("conv").agg(F.min("depth").alias("head"), F.count(F.lit(1)).alias("size"))
    chains = joined_by_key(single, stored(heads, "heads"), ["conv"], "size")
    here = light.filter("n > 1").unionByName(chains.filter("depth = head").select(*light.columns))

    first = rows.join(F.broadcast(heavy.select("d1", "d2")), ["d1", "d2"], "left_anti").groupBy("conv").agg(F.min_by(F.struct("d1", "d2"), "depth").alias("anchor"))
    here = here.join(first, "conv").withColumns({c: F.lit(0).cast("long") for c in ("more_children", "more_leaves", "more_saved")})
    here = stored(here, "subtrees")
    shards = max(partitions(spark), -(-here.count() // shard))
    here = here.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).drop("anchor")
    below = stored(here.groupBy("shard").applyInArrow(_added_up, _TABLE), "shards")

    hung = below.filter("parent_conv is null").groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2"))
    hung = hung.agg(F.count(F.lit(1)).alias("more_children"), F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    above = heavy.withColumn("below", F.lit(0).cast("long")).join(hung, ["d1", "d2"], "left").fillna(0, ["more_children", "more_leaves", "more_saved"])
    above = above.withColumn("shard", F.lit(0)).groupBy("shard").applyInArrow(_added_up, _TABLE)

    tops = heavy.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv").alias("top_conv"))
    below = below.join(F.broadcast(tops), ["p1", "p2"], "left").withColumn("parent_conv", F.coalesce("parent_conv", "top_conv")).drop("top_conv")
    tabled = below.unionByName(above)

    several = stored(found.filter("ends > 1").select("d1", "d2", "ends"), "ended")
    ending = joined_by_key(rows.filter("last").select("d1", "d2", "conv"), several, ["d1", "d2"], "ends")
    ending = ending.select("d1", "d2", "conv").repartition("d1", "d2").sortWithinPartitions("d1", "d2", "conv").mapInArrow(_hashed, "d1 long, d2 long, ends_sha256 string")
    tabled = tabled.join(ending, ["d1", "d2"], "left")
    own = F.when(F.col("ends") == 0, F.lit(_NO_ONE)).when(F.col("ends") == 1, _one(F.col("end_conv"))).otherwise(F.col("ends_sha256"))
    tabled = tabled.select("conv", "depth", "parent_conv", "n", "n_children", "n_leaves", "saved", own.alias("ends_sha256"))
    alone = chains.filter("depth > head").select(
        "conv", "depth", F.col("conv").alias("parent_conv"), "n", F.col("below").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved"),
        F.when(F.col("ends") == 0, F.lit(_NO_ONE)).otherwise(_one(F.col("conv"))).alias("ends_sha256"),
    )
    every = tabled.unionByName(alone)
    return every.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")
