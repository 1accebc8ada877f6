"""Prefix trie of conversations by double arrays, in shards of sorted paths.

A conversation is a path of turns; every distinct sequence of its first d
turns is a node. A turn is known by 24 bytes: the MD5 of role and text, and
the code points of the text. A path is these bytes one after the other, so
texts are never shuffled and byte order is prefix order.

1. Equal paths are one row with their number and smallest id, whatever the
   number of copies.
2. Paths are range-partitioned and sorted. A shard is a run of sorted paths of
   at most ``SHARD_TURNS`` turns (or one path): a section of the trie, also
   inside a prefix that a third of all conversations share. Its turns get
   dense ids, and its trie is packed into the arrays BASE and CHECK: the child
   of state s by turn t is BASE[s] + t, if CHECK of that place is s. Every
   path is walked from the root, and the nodes' aggregates follow from the
   arrays.
3. Only nodes on a shard's first or last path can lie in other shards too.
   These upper nodes leave the shard as partial aggregates under the MD5 of
   their prefix, and a global sum merges them. A node shared with the shard
   before is subtracted once and counted as a child once, by what the two
   neighbouring paths have in common; inside a task that is known at once,
   between partitions from one row a partition.

The ids of conversations that end at a node are hashed from runs of at most
65,536 ids each, in order, so that a path with very many copies never lies in
memory whole.

Defined results: a null turn number comes first, null role or text is empty,
rows of equal turn number are ordered by the MD5 of role and text (repeated
rows are repeated turns). Rows with a null conversation id take no part. One
conversation's turns (24 bytes each) must fit in a task. An empty table has no
node at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderpulse.llm.common import materialize, shuffle_partitions, spread

#: bytes of a turn in a path
TURN = 24
SHARD_TURNS = 1 << 17
#: free places tried for the children of a node before the arrays grow
TRIES = 256
NO_IDS = hashlib.sha256(b"").hexdigest()


def turn_code(role: Column, text: Column) -> Column:
    """48 hex digits: MD5 of role and text, and the text's code points."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    own = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    return F.concat(own, F.lpad(F.hex(F.char_length(text).cast("long")), 16, "0"))


def paths_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """(id, path): one row per conversation; the path in hex digits."""
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("id"),
        F.struct(F.col(turn_col).alias("at"), turn_code(F.col(role_col), F.col(text_col)).alias("code")).alias("t"))
    return rows.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("t")).getField("code"), "").alias("path"))


def share_heads(paths: DataFrame, every: int = 100, most: int = 5) -> DataFrame:
    """Conversations that open like another one: the first h turns come from
    conversation id - id % ``every`` (none if absent), the others are its own
    after its first h; h is the CRC-32 of the decimal id modulo ``most`` + 1."""
    digits = 2 * TURN
    paths = materialize(paths, "turns")
    first = F.col("id") - F.col("id") % every
    heads = paths.where(F.col("id") % every == 0).select(F.col("id").alias("hid"), F.substring("path", 1, most * digits).alias("head"))
    h = (F.crc32(F.col("id").cast("string")) % (most + 1)).cast("int")
    joined = paths.withColumn("hid", first).join(heads, "hid", "left")
    return joined.select("id", F.concat(
        F.substr(F.coalesce("head", F.lit("")), F.lit(1), h * digits),
        F.substr("path", h * digits + 1, F.char_length("path"))).alias("path"))


class DoubleArray:
    """BASE and CHECK over dense turn ids from 1; state 0 is the root. Places
    up to the largest turn id stay free, so that BASE is never negative."""

    def __init__(self, turns: int):
        self.turns = turns
        self.base = [0] * (turns + 1)
        self.check = [-1] * (turns + 1)
        self.check[0] = -2
        self.free = turns + 1  # every place from the turn ids to this one is taken

    def _grow(self, size: int) -> None:
        more = size - len(self.check)
        if more > 0:
            self.base += [0] * more
            self.check += [-1] * more

    def _fits(self, base: int, ids: list[int]) -> bool:
        check, size = self.check, len(self.check)
        return all(base + t >= size or check[base + t] == -1 for t in ids)

    def add(self, state: int, ids: list[int], all_turns: int) -> None:
        """Give ``state`` children by the turn ids (ascending)."""
        check, place, tries = self.check, self.free, 0
        while place < len(check) and check[place] != -1:
            place += 1
        self.free = place
        limit = TRIES if len(check) < 8 * (all_turns + self.turns) else all_turns * 8
        while not self._fits(place - ids[0], ids):
            tries += 1
            place += 1
            while place < len(check) and check[place] != -1:
                place += 1
            if tries > limit:
                place = max(place, len(check))
        base = place - ids[0]
        self._grow(base + ids[-1] + 1)
        self.base[state] = base
        for t in ids:
            self.check[base + t] = state


@dataclass
class Shard:
    """Sorted distinct paths with how many conversations have each and the
    smallest id, and what its neighbours have in common with it: turns shared
    with the path before the first and the path after the last (-1: no such
    path; None: it lies in another partition)."""

    paths: list[bytes]
    counts: list[int]
    firsts: list[int]
    before: int | None
    after: int | None


def common_turns(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    if a[:size] == b[:size]:
        return size // TURN
    x, y = (np.frombuffer(p[:size], dtype=np.uint8) for p in (a, b))
    return int(np.argmax(x != y)) // TURN


def pack(paths: list[bytes]) -> tuple[DoubleArray, list[list[int]], np.ndarray, list[int]]:
    """The double array of sorted distinct paths; the paths in dense turn ids,
    numbered as they first occur; the code points of each turn id; and the
    states, parents first."""
    raw = np.array([p[i:i + TURN] for p in paths for i in range(0, len(p), TURN)], dtype=object)
    ids, distinct = pd.factorize(raw)
    dense = (ids + 1).tolist()
    sizes = [len(p) // TURN for p in paths]
    rows, begin = [], 0
    for n in sizes:
        rows.append(dense[begin:begin + n])
        begin += n
    chars = np.zeros(len(distinct) + 1, dtype=np.int64)
    if len(distinct):
        whole = np.frombuffer(b"".join(distinct), dtype=np.uint8).reshape(-1, TURN)
        chars[1:] = np.ascontiguousarray(whole[:, TURN - 8:]).view(">i8").reshape(-1)
    array = DoubleArray(len(distinct))
    states, todo = [0], [(0, 0, len(rows), 0)]
    for state, lo, hi, depth in todo:  # grows as it goes: breadth first
        if sizes[lo] == depth:
            lo += 1  # the path that ends here
        children = []
        while lo < hi:
            t, end = rows[lo][depth], lo + 1
            while end < hi and rows[end][depth] == t:
                end += 1
            children.append((t, lo, end))
            lo = end
        if children:
            array.add(state, sorted(t for t, _, _ in children), len(dense))
            for t, a, b in children:
                todo.append((array.base[state] + t, a, b, depth + 1))
                states.append(array.base[state] + t)
    return array, rows, chars, states


def nodes_of(shard: Shard, partition: int) -> pd.DataFrame:
    """The shard's nodes: whole ones, and parts of upper nodes."""
    array, rows, chars, states = pack(shard.paths)
    base, check = array.base, array.check
    size = len(check)
    members, smallest, depth, ends, turn = ([0] * size for _ in range(5))
    walked: dict[int, list[int]] = {}
    for r, (path, n, first) in enumerate(zip(rows, shard.counts, shard.firsts, strict=True)):
        state, way = 0, [0]
        for t in path:
            child = base[state] + t
            if check[child] != state:
                raise ValueError("a path is not in its own trie")
            state = child
            way.append(child)
            turn[child] = t
        for d, s in enumerate(way):
            smallest[s] = min(smallest[s], first) if members[s] else first
            members[s] += n
            depth[s] = d
        ends[state] = r + 1
        if r in (0, len(rows) - 1):
            walked[r] = way
    # nodes of the first path that lie in an earlier shard as well, and of the last that lie in a later one
    left, right = walked[0], walked[len(rows) - 1]
    early = left if shard.before is None else left[:shard.before + 1]
    late = right if shard.after is None else right[:shard.after + 1]
    owned = bytearray(b"\1") * size
    for s in left[:(-1 if shard.before is None else shard.before) + 1]:
        owned[s] = 0
    upper = {*early, *late}
    children, leaves, saved = ([0] * size for _ in range(3))
    goes_on = shard.after is not None and shard.after == len(right) - 1
    for s in reversed(states):
        c = int(chars[turn[s]])
        saved[s] += (members[s] - owned[s]) * c
        if base[s] == 0 and not (goes_on and s == right[-1]):
            leaves[s] += 1  # no state of a child: BASE is positive where there is one
        if s:
            parent = check[s]
            saved[parent] += saved[s]
            leaves[parent] += leaves[s]
            children[parent] += owned[s]
    keys = {}
    for way, path in ((left, shard.paths[0]), (right, shard.paths[-1])):
        h = hashlib.md5()
        for d, s in enumerate(way):
            if d:
                h.update(path[TURN * (d - 1):TURN * d])
            keys[s] = h.digest()
    open_left = {s: d for d, s in enumerate(left)} if shard.before is None else {}
    open_right = set(right) if shard.after is None else set()
    sums = np.concatenate([[0], np.cumsum(chars[rows[0]])]) if rows[0] else np.zeros(1, np.int64)
    out = []
    for s in states:
        parent = check[s] if s else -1
        key = keys[s] if s in upper else hashlib.md5(shard.paths[ends[s] - 1]).digest() if ends[s] else None
        out.append((
            s in upper, key, keys[parent] if s and parent in upper else None, smallest[s], depth[s],
            smallest[parent] if s and parent not in upper else None, members[s], children[s], leaves[s], saved[s], partition,
            s in open_left, s in open_right, int(sums[depth[s] - 1]) if s in open_left and depth[s] else 0))
    return pd.DataFrame(out, columns=NODE_COLUMNS).astype({"parent_conv_id": "Int64"})


NODES = ("upper boolean, key binary, pkey binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
         "n_leaves long, saved_tokens long, part int, open_left boolean, open_right boolean, above long, first_path binary, "
         "last_path binary")
NODE_COLUMNS = [c.split()[0] for c in NODES.split(", ")][:-2]


def shards(batches: Iterator[pd.DataFrame], turns: int) -> Iterator[Shard]:
    """Runs of sorted (path, n, first) rows of at most ``turns`` turns."""
    paths: list[bytes] = []
    counts: list[int] = []
    firsts: list[int] = []
    size, before = 0, None
    for batch in batches:
        for path, n, first in zip(batch["path"], batch["n"], batch["first"], strict=True):
            path = bytes(path)
            if paths and size + len(path) > turns * TURN:
                after = common_turns(paths[-1], path)
                yield Shard(paths, counts, firsts, before, after)
                paths, counts, firsts, size, before = [], [], [], 0, after
            paths.append(path)
            counts.append(int(n))
            firsts.append(int(first))
            size += len(path)
    if paths:
        yield Shard(paths, counts, firsts, before, None)


def _tries(batches: Iterator[pd.DataFrame], turns: int) -> Iterator[pd.DataFrame]:
    part = TaskContext.get().partitionId()
    first = last = None
    for shard in shards(batches, turns):
        first = shard.paths[0] if first is None else first
        last = shard.paths[-1]
        yield nodes_of(shard, part).assign(first_path=None, last_path=None)
    if first is not None:  # what the neighbouring partitions need to know
        row = dict.fromkeys([*NODE_COLUMNS, "first_path", "last_path"]) | {"part": part, "first_path": first, "last_path": last}
        yield pd.DataFrame([row], dtype=object)


def _bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for r in batch.itertuples():
            shared = -1 if r.previous is None else common_turns(bytes(r.previous), bytes(r.first_path))
            units = np.frombuffer(bytes(r.first_path)[:max(shared, 0) * TURN], dtype=np.uint8).reshape(-1, TURN)
            chars = np.ascontiguousarray(units[:, TURN - 8:]).view(">i8")
            goes_on = r.next is not None and common_turns(bytes(r.last_path), bytes(r.next)) * TURN == len(r.last_path)
            out.append((r.part, shared, int(chars.sum()), goes_on))
        yield pd.DataFrame(out, columns=["bpart", "shared", "chars", "goes_on"])


def _hash_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (key, ids) sorted by key and run: one hash a key, over all its runs."""
    key, h = None, None
    for batch in batches:
        out = []
        for k, ids in zip(batch["key"], batch["ids"], strict=True):
            k = bytes(k)
            if k != key:
                if h is not None:
                    out.append((key, h.hexdigest()))
                key, h = k, hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=["ekey", "ends_sha256"])
    if h is not None:
        yield pd.DataFrame([(key, h.hexdigest())], columns=["ekey", "ends_sha256"])


def trie(paths: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of ``paths`` (id, path): conv_id (smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256."""
    buckets = shuffle_partitions(paths.sparkSession)
    named = materialize(paths.select("id", F.unhex("path").alias("path")), "paths")
    distinct = named.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    made = materialize(distinct.repartitionByRange(buckets, "path").sortWithinPartitions("path").mapInPandas(
        lambda b: _tries(b, shard_turns), NODES), "nodes")

    # at most one row a partition
    edge = made.where("first_path is not null").select("part", "first_path", "last_path").withColumns({
        "previous": F.lag("last_path").over(Window.orderBy("part")), "next": F.lead("first_path").over(Window.orderBy("part"))})
    bounds = edge.mapInPandas(_bounds, "bpart int, shared int, chars long, goes_on boolean")
    parts = made.where("upper").join(bounds, F.col("part") == F.col("bpart"))
    known = F.col("open_left") & (F.col("depth") <= F.col("shared"))  # an earlier partition has the node too
    upper = materialize(parts.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("pkey").alias("pkey"),
        F.sum("n_convs").alias("n_convs"),
        F.sum(F.col("n_children") - (known & (F.col("depth") < F.col("shared"))).cast("long")).alias("n_children"),
        F.sum(F.col("n_leaves") - (F.col("open_right") & F.col("goes_on")).cast("long")).alias("n_leaves"),
        F.sum(F.col("saved_tokens") + F.when(known, F.col("chars") - F.col("above")).otherwise(0)).alias("saved_tokens")), "upper")

    columns = ["key", "pkey", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    whole = made.where("not upper").select(columns).union(
        upper.withColumn("parent_conv_id", F.lit(None).cast("long")).select(columns))
    above = spread(upper.select(F.col("key").alias("akey"), F.col("conv_id").alias("above_id")))
    linked = whole.join(above, F.col("pkey") == F.col("akey"), "left")
    runs = named.groupBy(F.unhex(F.md5("path")).alias("key"), F.shiftright("id", 16).alias("run")).agg(
        F.array_join(F.sort_array(F.collect_list("id")).cast("array<string>"), ",").alias("ids"))
    ends = runs.repartition(buckets, "key").sortWithinPartitions("key", "run").select("key", "ids").mapInPandas(
        _hash_ids, "ekey binary, ends_sha256 string")
    return linked.join(ends, F.col("key") == F.col("ekey"), "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "above_id").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """The trie of the conversations as they are."""
    return trie(paths_of(conversations, **columns))
