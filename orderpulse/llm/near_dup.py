"""Near-duplicate classes by DartMinHash over weighted word shingles.

A document is the weighted set of its five-word shingles (weight: how often
one occurs). Each unit of weight is a cell; hashed darts fall into a cell at
the arrival times of a Poisson process, and a document keeps those that
arrive before ``darts / weight``, so every document throws about the same
number of darts however long it is. A dart's hash names its coordinate, and
the earliest dart of each coordinate is the signature: coordinates agree with
the probability of the weighted Jaccard similarity. Weights are whole numbers,
and the work grows with the total weight of a document.

Bands of ``ROWS`` coordinates are joined:

1. Texts with the same words are one node (its smallest id); copies meet by
   an aggregate, never in pairs.
2. In each bucket of a band every node is paired with one centre only, the
   node that meets most others. Pairs are verified exactly, and links give
   components.
3. Rounds follow over the buckets that still hold several components: each
   takes another centre, among those that meet many others, and is paired with
   the nodes outside the centre's component. A round takes every ``TURNS``-th
   bucket, in turn, so that a link spares the other buckets of its nodes, and
   buckets that hold one component are left out from then on. The rounds end
   when one has linked less than a ``WORTH``-th of its pairs. A round makes at
   most one pair for each entry of its buckets, however large the group of
   copies is.
4. What the rounds did not link is searched exactly, over all nodes and not
   only over bucket mates. Each node deals the first cells of its sorted cells
   (the prefix of a set similarity join, so much longer that similar nodes
   share at least a tenth of their cells there) into shards by hash. A shard
   marks the cells that several components have. Nodes with fewer of those
   than any similar node would share with them are done. The others are joined
   by a prefix filter over their rarest cells, and the pairs are verified.

So no link is lost: the rounds only save the work of the exact search, which
grows with the square of a group whose members share most cells in other
components and are still not similar enough.

Components come from repeated contraction: every node points to its smallest
neighbour, edges are redrawn between the targets, until none is left.

Shuffles carry signatures, prefixes and pairs; texts are shuffled for the
verification only. Joins on a node or bucket that holds many rows have an
exchange on both sides, which adaptive execution splits.

Defined results: shorter texts have one shingle of all their words. Texts
without a word (null, empty, symbols) equal only texts with the same
characters. Rows that share an id are one document; rows with a null id are
returned with a null class. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderpulse.llm.common import Scratch, isolate, materialize, restore, shuffle_partitions, spread

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
#: rounds in which every bucket has its turn
TURNS = 4
#: one link in so many pairs is worth another round; what it leaves is searched exactly
WORTH = 100
#: prefix cells that a shard holds on average
SHARD_CELLS = 2_000_000
#: prefix cells that a task deals at a time
DEALT_CELLS = 1_000_000
#: documents whose darts are in memory at a time, and characters of them
CHUNK_DOCS, CHUNK_CHARS = 256, 2_000_000
_WORD = re.compile(r"\w+")
_M1, _M2, _GOLD = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def text_key(tokens: list[str], text: str | None) -> bytes:
    """Equal for texts with the same words (texts without words: the same characters)."""
    return hashlib.md5(("w" + " ".join(tokens) if tokens else "t" + (text or "")).encode("utf-8", "surrogatepass")).digest()


def shingle_cells(docs: list[list[str]], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Unit cells of all documents and the number of cells of each. A shingle
    that occurs c times gives c cells, numbered by occurrence."""
    lengths = np.array([len(d) for d in docs], dtype=np.int64)
    flat = [w for d in docs for w in d]
    if not flat:
        return np.zeros(0, np.uint64), np.zeros(len(docs), np.int64)
    codes, distinct = pd.factorize(np.array(flat, dtype=object))
    own = np.array([int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
                    for w in distinct], dtype=np.uint64)[codes]
    counts = np.where(lengths == 0, 0, np.maximum(1, lengths - n + 1))
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    doc = np.repeat(np.arange(len(docs)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + starts[doc]
    size = np.minimum(lengths, n)[doc]
    hashes = size.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            inside = k < size
            step = own[np.minimum(at + k, len(own) - 1)]
            hashes = np.where(inside, mix(hashes * _GOLD + step), hashes)
        # occurrence number of the shingle inside its document
        order = np.lexsort((hashes, doc))
        h, d = hashes[order], doc[order]
        fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0))
        cells = mix(h + (np.arange(len(h)) - first).astype(np.uint64) * _GOLD)
    return cells, counts


def signatures(cells: np.ndarray, counts: np.ndarray, k: int, spare: float = 5.0) -> np.ndarray:
    """(documents, k): the earliest dart of each coordinate. Documents with a
    coordinate that no dart hit throw twice as many; a document without cells has zeros."""
    out = np.zeros((len(counts), k), dtype=np.uint64)
    starts = np.concatenate([[0], np.cumsum(counts)])
    todo, darts = np.flatnonzero(counts), k * (np.log(k) + spare)
    while len(todo):
        own = np.repeat(np.arange(len(todo)), counts[todo])
        at = np.arange(len(own)) - np.repeat(np.cumsum(counts[todo]) - counts[todo], counts[todo]) + starts[todo][own]
        cell, limit = cells[at], (darts / counts[todo])[own]
        arrival = np.zeros(len(cell))
        places, ranks, ids = [], [], []
        n = 0
        with np.errstate(over="ignore"):
            while len(cell):
                n += 1
                h = mix(cell + np.uint64(n) * _GOLD)
                arrival = arrival - np.log(((h >> np.uint64(11)).astype(float) + 1.0) * 2.0 ** -53)
                live = arrival < limit
                cell, limit, own, arrival, h = cell[live], limit[live], own[live], arrival[live], h[live]
                dart = mix(h ^ _M2)
                places.append(own * k + (dart % np.uint64(k)).astype(np.int64))
                ranks.append(arrival)
                ids.append(dart)
        place, dart = np.concatenate(places), np.concatenate(ids)
        late_first = np.argsort(np.concatenate(ranks))[::-1]
        found = np.zeros(len(todo) * k, dtype=np.uint64)
        hit = np.zeros(len(todo) * k, dtype=bool)
        found[place[late_first]] = dart[late_first]  # the earliest is written last
        hit[place] = True
        complete = hit.reshape(-1, k).all(axis=1)
        out[todo[complete]] = found.reshape(-1, k)[complete]
        todo, darts = todo[~complete], darts * 2
    return out


def bands(signature: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    """One hash for each band, different between bands."""
    out = np.zeros((len(signature), n_bands), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for b in range(n_bands):
            h = np.full(len(signature), b + 1, dtype=np.uint64)
            for r in range(rows):
                h = mix(h * _GOLD + signature[:, b * rows + r])
            out[:, b] = h
    return out.view(np.int64)


def _spare(n: int) -> int:
    """Cells that a prefix of ``n`` cells has beyond the shortest possible one."""
    return n // 10


def prefix_size(n: int, threshold: float) -> int:
    """Of ``n`` sorted cells so many that two similar nodes share at least
    ``1 + _spare(m)`` cells in their prefixes, ``m`` being the smaller's number of cells."""
    return min(n, n - math.ceil(threshold * n - 1e-9) + 1 + _spare(n))


def least_met(n: int, threshold: float) -> int:
    """Cells that the prefix of ``n`` cells shares with that of any similar node, at least."""
    return 1 + _spare(math.ceil(threshold * n - 1e-9))


def _chunks(batch: pd.DataFrame) -> Iterator[tuple[int, int]]:
    begin, size = 0, 0
    for i, text in enumerate(batch["text"]):
        size += len(text or "")
        if i + 1 - begin >= CHUNK_DOCS or size >= CHUNK_CHARS:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(batch):
        yield begin, len(batch)


def _sign(batches: Iterator[pd.DataFrame], n_bands: int, rows: int, n: int, threshold: float) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for begin, end in _chunks(batch):
            part = batch.iloc[begin:end]
            docs = [words(t) for t in part["text"]]
            cells, counts = shingle_cells(docs, n)
            joined = bands(signatures(cells, counts, n_bands * rows), n_bands, rows)
            own = np.split(cells.view(np.int64), np.cumsum(counts)[:-1])
            yield pd.DataFrame({"id": part["id"].to_numpy(),
                                "tkey": [text_key(d, t) for d, t in zip(docs, part["text"], strict=True)],
                                "bands": [b if c else [] for b, c in zip(joined, counts, strict=True)],
                                "n": counts, "least": [least_met(int(c), threshold) for c in counts],
                                "prefix": [np.sort(c)[:prefix_size(len(c), threshold)] for c in own]})


def _cells(batches: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for begin, end in _chunks(batch):
            part = batch.iloc[begin:end]
            docs = [words(t) for t in part["text"]]
            cells, counts = shingle_cells(docs, n)
            own = np.split(cells.view(np.int64), np.cumsum(counts)[:-1])
            yield pd.DataFrame({"id": part["id"].to_numpy(), "cells": [np.sort(c) for c in own],
                                "tkey": [text_key(d, t) for d, t in zip(docs, part["text"], strict=True)]})


def _deal(batches: Iterator[pd.DataFrame], shards: int) -> Iterator[pd.DataFrame]:
    """Prefix cells by shard: for each shard the nodes that have cells there,
    their labels, how many cells, and 32 bits of each (which with the shard's
    number tell cells apart; a collision only keeps a node in the search)."""
    for batch in batches:
        sizes = batch["prefix"].str.len().to_numpy().astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // DEALT_CELLS
        for k in np.unique(part):
            piece, count = batch[part == k], sizes[part == k]
            cells = np.concatenate(piece["prefix"].to_list()).astype(np.int64).view(np.uint64)
            node, label = piece["id"].to_numpy(np.int64), piece["label"].to_numpy(np.int64)
            own = np.repeat(np.arange(len(piece)), count)
            shard = (cells % np.uint64(shards)).astype(np.int64)
            mark = ((cells // np.uint64(shards)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            order = np.argsort(shard, kind="stable")
            shard, own, mark = shard[order], own[order], mark[order]
            fresh = np.concatenate([[True], (shard[1:] != shard[:-1]) | (own[1:] != own[:-1])])
            runs = np.flatnonzero(fresh)
            lengths = np.diff(np.append(runs, len(own))).astype(np.uint32)
            first = np.flatnonzero(np.concatenate([[True], shard[runs][1:] != shard[runs][:-1]]))
            ends, stops = np.append(first[1:], len(runs)), np.append(runs[first][1:], len(own))
            yield pd.DataFrame({
                "shard": shard[runs[first]], "nodes": [node[own[runs[x:y]]].tobytes() for x, y in zip(first, ends, strict=True)],
                "labels": [label[own[runs[x:y]]].tobytes() for x, y in zip(first, ends, strict=True)],
                "counts": [lengths[x:y].tobytes() for x, y in zip(first, ends, strict=True)],
                "marks": [mark[x:y].tobytes() for x, y in zip(runs[first], stops, strict=True)]})


def _meet(shard: pd.DataFrame) -> pd.DataFrame:
    """(node, met): the cells of each node in this shard that another label has too."""
    node, label = (np.frombuffer(b"".join(shard[c]), dtype=np.int64) for c in ("nodes", "labels"))
    own = np.repeat(np.arange(len(node)), np.frombuffer(b"".join(shard["counts"]), dtype=np.uint32))
    mark = np.frombuffer(b"".join(shard["marks"]), dtype=np.uint32)
    order = np.argsort(mark, kind="stable")
    mark, own = mark[order], own[order]
    runs = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))
    mixed = np.minimum.reduceat(label[own], runs) < np.maximum.reduceat(label[own], runs)
    met = np.bincount(own[np.repeat(mixed, np.diff(np.append(runs, len(own))))], minlength=len(node))
    return pd.DataFrame({"node": node[met > 0], "met": met[met > 0]})


def _unsettled(signed: DataFrame, heads: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): the nodes that can still be similar to one of another
    component, by the number of prefix cells that other components have."""
    nodes = signed.where("n > 0").select("id", "tkey").join(spread(heads), "tkey").where("id = head").select("id", "tkey").distinct()
    known = nodes.join(spread(labels), nodes["id"] == labels["node"], "left").select(
        "id", "tkey", F.coalesce("label", "id").alias("label"))
    marked = signed.select("id", "tkey", "prefix").join(spread(known), ["id", "tkey"]).select("id", "label", "prefix")
    total = signed.agg(F.sum(F.size("prefix"))).first()[0] or 0
    shards = max(shuffle_partitions(signed.sparkSession), total // SHARD_CELLS)
    dealt = marked.mapInPandas(lambda b: _deal(b, shards), "shard long, nodes binary, labels binary, counts binary, marks binary")
    met = dealt.groupBy("shard").applyInPandas(_meet, "node long, met long").groupBy("node").agg(F.sum("met").alias("met"))
    wanted = signed.where("n > 0").groupBy("id").agg(F.min("least").alias("least"))
    rest = met.join(wanted, met["node"] == wanted["id"]).where("met >= least").select("node")
    return scratch.keep(rest.join(spread(labels), "node", "left").select("node", F.coalesce("label", "node").alias("label")), "unsettled")


def _cells_of(ids: DataFrame, texts: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """(id, tkey, cells): the sorted cells of every text whose id is in ``ids``, once however often a row is repeated."""
    needed = texts.join(ids, texts["id"] == ids["end"], "left_semi")
    made = needed.mapInPandas(lambda b: _cells(b, n), "id long, cells array<long>, tkey binary")
    return scratch.keep(made.dropDuplicates(["id", "tkey"]), "cells")


def _linked(pairs: DataFrame, cells: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity reaches the threshold."""
    left = cells.select(F.col("id").alias("a"), F.col("cells").alias("ca"))
    right = cells.select(F.col("id").alias("b"), F.col("cells").alias("cb"))
    least = threshold / (1 + threshold) * (F.size("ca") + F.size("cb")) - 1e-9
    # b is the centre of a bucket and may be in very many pairs
    return pairs.join(left, "a").join(right, "b").where(
        (F.least(F.size("ca"), F.size("cb")) >= least) & (F.size(F.array_intersect("ca", "cb")) >= least)).select("a", "b")


def _candidates(nodes: DataFrame, cells: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, label) with different labels that can
    reach the threshold, by an exact prefix filter. Cells are ordered by how
    many nodes have them, and those that only one label has come first: they
    fill the prefix without making pairs, so that copies that differ in more
    than a fifth of their shingles drop out. Two similar sets share a cell of
    their prefixes, which for the smaller of the two is shorter; the first one
    they share leaves room for the others that they must share."""
    own = nodes.join(cells, nodes["node"] == cells["id"]).select(
        "node", "label", "tkey", F.size("cells").alias("n"), F.explode("cells").alias("cell"))
    mixed = own.groupBy("cell").agg(F.count(F.lit(1)).alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi")).where(
        "lo < hi").select("cell", "df")
    shared = own.join(spread(mixed), "cell")
    inside = Window.partitionBy("node", "tkey")

    def places(share: float) -> Column:  # of the prefix when so much of a set must be common, without the cells of one label
        return F.col("s") - F.ceil(F.lit(share) * F.col("n") - 1e-9) + 1

    rare = shared.withColumns({"place": F.row_number().over(inside.orderBy("df", "cell")), "s": F.count(F.lit(1)).over(inside)}).where(
        F.col("place") <= places(threshold)).select(
        "node", "label", "n", "cell", "s", "place", (F.col("place") <= places(2 * threshold / (1 + threshold))).alias("early"))
    rare = scratch.keep(rare, "prefixes")
    # of two labels at most one is the commonest at a cell: rows with that label need not start a pair
    commonest = rare.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("cell").agg(
        F.max_by("label", F.struct("c", "label")).alias("main"))
    starts = rare.join(spread(commonest), "cell").where("label <> main").drop("main")
    other = rare.select("cell", *[F.col(c).alias(f"{c}2") for c in ("node", "label", "n", "s", "place", "early")])
    smaller = F.struct("n", "node") < F.struct(F.col("n2").alias("n"), F.col("node2").alias("node"))
    room = 1 + F.least(F.col("s") - F.col("place"), F.col("s2") - F.col("place2"))
    near = (F.col("label") != F.col("label2")) & F.when(smaller, F.col("early")).otherwise(F.col("early2")) & (
        room >= threshold / (1 + threshold) * (F.col("n") + F.col("n2")) - 1e-9)
    return other.join(spread(starts), "cell").where(near).select(
        F.greatest("node", "node2").alias("a"), F.least("node", "node2").alias("b")).distinct()


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, label): the smallest node of each component; nodes without an edge do not appear."""
    scratch = scratch or Scratch(edges.sparkSession)
    edges, labels = scratch.keep(edges.where("a <> b"), "edges"), None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        parent = scratch.keep(both.groupBy("node").agg(F.least("node", F.min("other")).alias("to")), "parent")
        pa, pb = spread(parent).toDF("a", "ta"), spread(parent).toDF("b", "tb")
        old, edges = edges, scratch.keep(edges.join(pa, "a").join(pb, "b").where("ta <> tb").select(
            F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        if labels is None:
            now = scratch.keep(parent.toDF("node", "label"), "labels")
        else:
            moved = spread(parent).toDF("_node", "_to")
            now = scratch.keep(labels.join(moved, labels["label"] == moved["_node"], "left").select(
                "node", F.coalesce("_to", "label").alias("label")), "labels")
            scratch.drop(labels)
        scratch.drop(old, parent)
        labels = now
    if labels is None:
        labels = scratch.keep(edges.toDF("node", "label"), "labels")
    scratch.drop(edges)
    return labels


def _mixed(shared: DataFrame) -> DataFrame:
    """Entries (band, node, met, label) of the buckets that hold several components."""
    mixed = shared.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("band")
    return shared.join(spread(mixed), "band")


def _relabelled(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """``shared`` with the labels of now."""
    return shared.select("band", "node", "met").join(spread(labels), "node", "left").select(
        "band", "node", "met", F.coalesce("label", "node").alias("label"))


def _round(mixed: DataFrame, number: int) -> DataFrame:
    """Pairs (a, b) of one round: each bucket's nodes outside the component of
    its centre, with the centre. Which of the nodes that meet many others is
    the centre differs between buckets and rounds."""
    chance = 0.5 + F.pmod(F.xxhash64("node", "band", F.lit(number)), F.lit(1 << 20)) / (1 << 21)
    centres = mixed.groupBy("band").agg(
        F.max_by(F.struct(F.col("node").alias("centre"), F.col("label").alias("own")),
                 F.struct(F.col("met") * chance, -F.col("node"))).alias("c")).select("band", "c.centre", "c.own")
    return mixed.join(spread(centres), "band").where("label <> own").select(
        F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b")).distinct()


def join_components(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``labels`` (node, label) after more links: only labels that a new link meets are contracted."""
    la, lb = spread(labels).toDF("a", "la"), spread(labels).toDF("b", "lb")
    between = links.join(la, "a", "left").join(lb, "b", "left").select(
        F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    moved = components(between.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), scratch)
    to = spread(moved).toDF("_node", "_to")
    old = labels.join(to, labels["label"] == to["_node"], "left").select("node", F.coalesce("_to", "label").alias("label"))
    fresh = moved.join(labels, "node", "left_anti").select("node", "label")
    joined = scratch.keep(old.union(fresh), "labels")
    scratch.drop(labels, moved)
    return joined


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                    n: int = WORDS, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id_col, class_id): one row per row of ``docs``; the class is named by its smallest id."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = scratch.keep(texts.mapInPandas(lambda b: _sign(b, n_bands, rows, n, threshold),
                                            "id long, tkey binary, bands array<long>, n long, least long, prefix array<long>"), "signed")
    heads = scratch.keep(signed.groupBy("tkey").agg(F.min("id").alias("head")), "heads")
    # nodes: one for each distinct text; the row that carries the head's id has its bands
    nodes = signed.join(spread(heads), "tkey").where("id = head").select(F.col("id").alias("node"), "bands").distinct()
    banded = scratch.keep(nodes.select("node", F.explode("bands").alias("band")), "bands")
    same_id = signed.select("id", "tkey").join(spread(heads), "tkey").where(
        "id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")).join(
        heads.select(F.col("head").alias("a")).distinct(), "a", "left_semi")

    buckets = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bucketed = scratch.keep(banded.join(spread(buckets), "band").select("band", "node", "n"), "shared")
    scratch.drop(banded)
    # the centre of a bucket: the node that meets most others over all bands, which is near the middle of its copies
    met = bucketed.groupBy("node").agg(F.sum("n").alias("met"))
    shared = scratch.keep(bucketed.drop("n").join(met, "node"), "met")
    scratch.drop(bucketed)
    centres = shared.groupBy("band").agg(F.max_by("node", F.struct(F.col("met"), -F.col("node"))).alias("centre"))
    pairs = scratch.keep(shared.join(spread(centres), "band").where("node <> centre").select(
        F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b")).distinct(), "pairs")
    cells = _cells_of(pairs.select(F.explode(F.array("a", "b")).alias("end")).distinct(), texts, n, scratch)
    links = scratch.keep(_linked(pairs, cells, threshold).union(same_id.distinct()), "links")
    labels = components(links, scratch)
    scratch.drop(links)

    number, worth, asked = 0, True, [pairs]
    turn = F.pmod(F.xxhash64("band"), F.lit(TURNS))
    while worth:
        number += 1
        placed = scratch.keep(_relabelled(shared, labels), "placed")
        scratch.drop(shared)
        shared = scratch.keep(_mixed(placed), "mixed")
        scratch.drop(placed)
        before = reduce(DataFrame.union, asked)
        fresh = scratch.keep(_round(shared.where(turn == number % TURNS), number).join(before, ["a", "b"], "left_anti"), "pairs")
        found = scratch.keep(_linked(fresh, cells, threshold), "links")
        asked.append(fresh)
        linked = found.count()
        worth = linked > 0 and linked * WORTH >= fresh.count()
        if linked:
            labels = join_components(labels, found, scratch)
        scratch.drop(found)
    scratch.drop(shared, *asked)

    unsettled = _unsettled(signed, heads, labels, scratch)
    if not unsettled.isEmpty():
        missing = unsettled.join(cells, unsettled["node"] == cells["id"], "left_anti").select(F.col("node").alias("end"))
        cells = cells.union(_cells_of(missing, texts, n, scratch).select(cells.columns))
        pairs = scratch.keep(_candidates(unsettled, cells, threshold, scratch), "pairs")
        found = scratch.keep(_linked(pairs, cells, threshold), "links")
        if not found.isEmpty():
            labels = join_components(labels, found, scratch)

    named = signed.select("id", "tkey").join(spread(heads), "tkey")
    found = spread(labels).toDF("_node", "_label")
    classes = materialize(named.join(found, named["head"] == found["_node"], "left").select(
        F.col("id").alias(id_col), F.coalesce("_label", "head").alias("class_id")), "classes")
    scratch.drop_all()
    nameless = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("long"), F.lit(None).cast("long"))
    return classes.union(nameless)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with only the document with the smallest id of each class,
    once (of rows that repeat an id, the first by a hash of the text). Rows
    with a null id stay."""
    classes = near_duplicates(docs, id_col, text_col, **options)
    gone = classes.where(F.col("class_id") != F.col(id_col)).select(F.col(id_col).alias("gone")).distinct()
    roles = {"id": id_col, "text": text_col}
    left = isolate(docs, **roles).join(gone, F.col("id") == F.col("gone"), "left_anti")
    own = F.xxhash64("text")
    alike = Window.partitionBy("id", F.when(F.col("id").isNull(), own)).orderBy(own)
    once = left.withColumn("nth", F.row_number().over(alike)).where(F.col("id").isNull() | (F.col("nth") == 1))
    return restore(once, docs, roles)
