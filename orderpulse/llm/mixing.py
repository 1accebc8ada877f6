"""Mixing sources to target weights by Pfair scheduling.

A source's documents are put in a random but repeatable order and cut into
blocks. With weight ``w`` the j-th block of a source (from 1) is released at
slot ``floor((j - 1) / w)`` and due by slot ``ceil(j / w)``; in each slot the
released block with the earliest deadline is placed. Every block then lies
inside its window, so at any slot a source is less than one block away from
its target.

Weights are taken exactly as given, as whole numbers over one common
denominator, so the bound holds however long the mixture is and however small
a weight. When a source runs out, the others continue with their weights
scaled up (a new phase, with windows counted from its first slot; there are
at most as many phases as sources). Nothing is dropped or repeated.

The driver runs through the slots of all blocks once (not of documents) and
keeps the state at every ``period``-th slot only: how many blocks each source
has placed. Tasks run the slots between two states again for the blocks they
hold.

Documents are numbered inside their source in hash buckets, so a source that
holds most of the rows is spread like any other. The states have at most one
number for each block (``period`` slots or twice the number of sources,
whichever is more, lie between two of them, and a state has two numbers for
each source).

Defined results: rows with a null source form a source of their own. Null and
repeated ids are placed like others. Sources without a weight, or with a
weight that is not positive, get the smallest one given. An empty table gives
an empty result. Other columns pass through untouched.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from math import lcm

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpulse.llm.common import isolate, rank_within, restore, shuffle_partitions

BLOCK_DOCS = 32
#: slots between two kept states
PERIOD = 4096
#: parts of the schedule that a task keeps
KEPT = 1024
#: default weights are the sources' sizes to this power
ALPHA = 0.5


def whole_weights(weights: dict) -> dict:
    """The weights, exactly, as whole numbers of one unit."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    unit = lcm(*(x.denominator for x in exact.values())) if exact else 1
    return {s: int(x * unit) for s, x in exact.items()}


class Schedule:
    """The source (by number) of each slot, from a kept state on.

    ``done`` blocks of each source are placed before slot ``slot``; the phase
    began at ``begin`` with ``base`` blocks placed. Windows use whole numbers
    only: of a source with weight m of a total T, block j is released at
    floor((j - 1) T / m) and due by ceil(j T / m)."""

    def __init__(self, blocks: list, weights: list, slot: int, done: list, begin: int, base: list):
        self.blocks, self.weights, self.slot, self.begin = blocks, weights, slot, begin
        self.done, self.base = list(done), list(base)
        self.end = sum(blocks)
        self._open()

    def _open(self) -> None:
        """The phase's sources are those with blocks left at its beginning."""
        self.total = sum(w for w, n, b in zip(self.weights, self.blocks, self.base, strict=True) if b < n)
        self.waiting: list = []  # (release, source, block)
        self.ready: list = []  # (deadline, source, block)
        for i, (n, b) in enumerate(zip(self.blocks, self.base, strict=True)):
            if b < n:
                self._add(i, self.done[i] - b + 1)

    def _add(self, i: int, j: int) -> None:
        heapq.heappush(self.waiting, ((j - 1) * self.total // self.weights[i], i, j))

    def step(self) -> int:
        """Place one block; its source."""
        while True:
            now = self.slot - self.begin
            while self.waiting and self.waiting[0][0] <= now:
                _, i, j = heapq.heappop(self.waiting)
                heapq.heappush(self.ready, (-(-j * self.total // self.weights[i]), i, j))
            _, i, j = heapq.heappop(self.ready)
            if self.done[i] < self.blocks[i]:
                break
            self.begin, self.base = self.slot, list(self.done)  # this source has run out: the others go on without it
            self._open()
        self.done[i] += 1
        self.slot += 1
        self._add(i, j + 1)
        return i


class Phase:
    """A run of slots with one set of sources; source s has ``slots[s]`` parts of ``period``."""

    def __init__(self, first_slot: int, slots: dict):
        self.first_slot, self.slots, self.period = first_slot, slots, sum(slots.values())
        self.order: list = []


def plan(blocks: dict, weights: dict, period: int = PERIOD) -> list[Phase]:
    """The whole schedule by phases (``mix`` keeps states instead)."""
    names = sorted((s for s, n in blocks.items() if n > 0), key=str)
    exact = whole_weights({s: weights[s] for s in names})
    run = Schedule([blocks[s] for s in names], [exact[s] for s in names], 0, [0] * len(names), 0, [0] * len(names))
    phases: list[Phase] = []
    while run.slot < run.end:
        i = run.step()
        if not phases or run.begin != phases[-1].first_slot:
            phases.append(Phase(run.begin, {s: exact[s] for s, b in zip(names, run.base, strict=True) if b < blocks[s]}))
        phases[-1].order.append(names[i])
    return phases


class States:
    """The states kept by the driver, and the slots of blocks found from them."""

    def __init__(self, blocks: dict, weights: dict, period: int = PERIOD):
        self.names = sorted((s for s, n in blocks.items() if n > 0), key=str)
        self.number = {s: i for i, s in enumerate(self.names)}
        exact = whole_weights({s: weights[s] for s in self.names})
        self.blocks, self.weights = [blocks[s] for s in self.names], [exact[s] for s in self.names]
        none = [0] * len(self.names)
        run = Schedule(self.blocks, self.weights, 0, none, 0, none)
        self.every = max(period, 2 * len(self.names))
        done, base, begin = [], [], []
        while run.slot < run.end:
            if run.slot % self.every == 0:
                done.append(run.done.copy())
                base.append(run.base.copy())
                begin.append(run.begin)
            run.step()
        self.done, self.base = np.array(done, dtype=np.int64), np.array(base, dtype=np.int64)
        self.begin = begin

    def part(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Source and share of each slot between states k and k + 1."""
        run = Schedule(self.blocks, self.weights, k * self.every, self.done[k].tolist(), self.begin[k], self.base[k].tolist())
        length = min(self.every, run.end - run.slot)
        source, share = np.empty(length, dtype=np.int32), np.empty(length)
        for t in range(length):
            i = run.step()
            source[t], share[t] = i, run.weights[i] / run.total
        return source, share

    def find(self, i: int, number: np.ndarray, part) -> tuple[np.ndarray, np.ndarray]:
        """Slot and share of the blocks ``number`` (from 0) of source ``i``."""
        slot, share = np.empty(len(number), dtype=np.int64), np.empty(len(number))
        state = np.searchsorted(self.done[:, i], number, side="right") - 1
        for k in np.unique(state):
            mine = np.flatnonzero(state == k)
            source, shares = part(int(k))
            at = np.flatnonzero(source == i)[number[mine] - self.done[k, i]]
            slot[mine], share[mine] = k * self.every + at, shares[at]
        return slot, share


def mix(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source",
        block_docs: int = BLOCK_DOCS, period: int = PERIOD) -> DataFrame:
    """``docs`` with ``source_rank`` (from 0, in its source), ``mix_slot``
    (the place of its block), ``mix_offset`` (its place in the block) and
    ``target_share`` (its source's share in that phase). Order by mix_slot,
    mix_offset for the mixture. ``weights`` default to the square root of the
    sources' sizes."""
    roles = {"id": id_col, "source": source_col}
    rows = isolate(docs, **roles)
    sizes = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = {s: -(-n // block_docs) for s, n in sizes.items()}
    if weights is None:
        target = {s: n ** ALPHA for s, n in sizes.items()}
    else:
        least = min((w for w in weights.values() if w > 0), default=1.0)
        target = {s: weights.get(s, least) if weights.get(s, least) > 0 else least for s in sizes}
    states = States(blocks, target, period)

    @F.pandas_udf("slot long, share double")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        part = lru_cache(maxsize=KEPT)(states.part)
        for source, block in batches:
            slot, share = np.zeros(len(block), dtype=np.int64), np.zeros(len(block))
            number = block.to_numpy()
            for s, own in source.groupby(source, dropna=False, sort=False).indices.items():
                slot[own], share[own] = states.find(states.number[None if pd.isna(s) else s], number[own], part)
            yield pd.DataFrame({"slot": slot, "share": share})

    buckets = 4 * shuffle_partitions(docs.sparkSession)
    dealt = rows.withColumn("deal", F.xxhash64("id", F.lit(8)))
    ranked = rank_within(dealt, "source", ["deal", "id"], buckets, "rank")
    done = ranked.withColumn("spot", place("source", F.floor(F.col("rank") / block_docs)))
    return restore(done, docs, roles, source_rank=F.col("rank"), mix_slot=F.col("spot.slot"),
                   mix_offset=F.col("rank") % block_docs, target_share=F.col("spot.share"))
