"""Filling containers of a fixed capacity with whole items.

Every partition of the sized items is packed by itself, without a shuffle, in loads
of bounded size. A load starts from best fit in the order of arrival; then a local
search over its underfull containers exchanges up to two items for up to two, or
moves them, whenever that raises the sum of squared fills, until nothing helps. Items of
containers that still have room go into the next round over fewer partitions, until
one load holds them all. Rounds that take off too little mix what is left over all
loads, by a shuffle; when mixed rounds take off too little as well, the containers
stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from throng.llm.bpe import token_counts
from throng.session import stage_table

#: Tokens a container holds.
CAPACITY = 4096
#: Items packed together; bounds the memory and the search of a task.
LOAD = 10_000
#: A container with no more room than this part of the capacity is closed.
CLOSED = 0.002
#: A round counts as progress if it takes off this part of the items in containers
#: with room, or this part of these containers; so the rounds come to an end.
ITEMS_LESS, CONTAINERS_LESS = 0.1, 0.01
#: Bits of a container's number for the container in its load, the load in its
#: partition and the partition; the rest is the round.
_NUMBER, _LOADS, _PARTS = 16, 17, 22
_PACKED = [T.StructField(c, T.LongType()) for c in ("part", "tokens", "container", "room")]


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Item numbers of each container, by best fit in the order of arrival."""
    bins: list[list[int]] = []
    room_of: dict[int, list[int]] = {}
    rooms = 0  # bit r is set while some container has room r
    for i, s in enumerate(sizes.tolist()):
        fits = rooms >> s
        if fits:
            r = (fits & -fits).bit_length() - 1 + s
            k = room_of[r].pop()
            if not room_of[r]:
                rooms ^= 1 << r
            bins[k].append(i)
        else:
            r, k = capacity, len(bins)
            bins.append([i])
        room_of.setdefault(r - s, []).append(k)
        rooms |= 1 << (r - s)
    return bins


def _sums(items: list[int], size: list[int]) -> np.ndarray:
    """0 and what one or two of the items hold, each sum once, ascending."""
    levels, times = np.unique(np.array([size[i] for i in items if size[i]], dtype=np.int64), return_counts=True)
    a, b = np.triu_indices(len(levels), 1)
    return np.unique(np.concatenate([[0], levels, levels[a] + levels[b], 2 * levels[times > 1]]))


def _pick(items: list[int], size: list[int], total: int) -> tuple[int, ...]:
    """At most two of the items that hold ``total`` together."""
    if not total:
        return ()
    of: dict[int, list[int]] = {}
    for i in items:
        of.setdefault(size[i], []).append(i)
    if total in of:
        return (of[total][0],)
    return next((s[0], of[total - t][-1]) for t, s in of.items() if total - t in of and (2 * t != total or len(s) > 1))


class _Search:
    """Containers under exchange; ``steps`` counts the exchanges made.

    Sums of up to two items are kept for groups of containers side by side, so a
    giver meets a whole group at once; a group is put together anew only after one
    of its containers was altered.
    """

    def __init__(self, bins: list[list[int]], sizes: np.ndarray, capacity: int) -> None:
        self.bins, self.size, self.capacity = bins, sizes.tolist(), capacity
        self.fill = np.array([sum(self.size[i] for i in b) for b in bins], dtype=np.int64)
        self.sums: dict[int, np.ndarray] = {}
        self.groups: dict[tuple[int, ...], tuple[np.ndarray, np.ndarray]] = {}
        self.within: dict[int, set[tuple[int, ...]]] = {}
        self.steps = 0

    def _sums_of(self, k: int) -> np.ndarray:
        if k not in self.sums:
            self.sums[k] = _sums(self.bins[k], self.size)
        return self.sums[k]

    def _group(self, takers: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        if takers not in self.groups:
            theirs = [self._sums_of(k) for k in takers]
            self.groups[takers] = np.concatenate(theirs), np.repeat(np.array(takers), [len(x) for x in theirs])
            for k in takers:
                self.within.setdefault(k, set()).add(takers)
        return self.groups[takers]

    def step(self, giver: int, groups: list[tuple[int, ...]]) -> int | None:
        """Make the exchange that brings most into a fuller container of the first
        group where any does; its taker, or None if there is none."""
        own = self._sums_of(giver)
        for takers in groups:
            back, of = self._group(takers)
            fill = self.fill[of]
            give = own[np.searchsorted(own, back + self.capacity - fill, "right") - 1]
            gain = np.where((of != giver) & (fill >= self.fill[giver]) & (fill < self.capacity), give - back, 0)
            best = int(gain.argmax())
            if gain[best] > 0:
                taker = int(of[best])
                self._move(giver, taker, int(give[best]), int(back[best]))
                return taker
        return None

    def _move(self, giver: int, taker: int, give: int, back: int) -> None:
        out, into = _pick(self.bins[giver], self.size, give), _pick(self.bins[taker], self.size, back)
        self.bins[giver] = [i for i in self.bins[giver] if i not in out] + list(into)
        self.bins[taker] = [i for i in self.bins[taker] if i not in into] + list(out)
        self.fill[giver] -= give - back
        self.fill[taker] += give - back
        self.steps += 1
        for k in (giver, taker):
            self.sums.pop(k, None)
            for g in self.within.pop(k, ()):
                self.groups.pop(g, None)

    def underfull(self) -> list[int]:
        """Containers that aren't full, the fullest first."""
        some = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity))
        return some[np.argsort(-self.fill[some], kind="stable")].tolist()

    def run(self) -> None:
        """Exchange until a pass over all underfull containers brings nothing."""
        altered: list[int] = []
        stuck: dict[tuple[int, ...], int] = {}
        moved = True
        while moved:
            moved = False
            short = self.underfull()
            near = _grouped(short)
            for giver in short[::-1]:
                while 0 < self.fill[giver] < (1 - CLOSED) * self.capacity:
                    sig = tuple(sorted(self.size[i] for i in self.bins[giver] if self.size[i]))
                    since = stuck.get(sig)
                    taker = self.step(giver, near if since is None else _grouped(sorted(set(altered[since:]))))
                    if taker is None:
                        stuck[sig] = len(altered)
                        break
                    altered += [taker, giver]
                    moved = True
                if not self.fill[giver] and self.bins[giver]:  # items of no tokens
                    self.bins[altered[-2]] += self.bins[giver]
                    self.bins[giver] = []


def _grouped(containers: list[int], most: int = 256) -> list[tuple[int, ...]]:
    return [tuple(containers[at : at + most]) for at in range(0, len(containers), most)]


def local_search(bins: list[list[int]], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Improve a packing by exchanges of up to two items for up to two.

    The emptiest container gives: each step puts a positive net amount into a
    fuller container, so the sum of squared fills grows, until the giver is empty
    or nothing helps; then the next emptiest gives, until a pass over all
    containers that aren't closed brings nothing. A giver that was stuck, and any
    other of the same sizes, meets only containers altered since.
    """
    search = _Search([list(b) for b in bins], sizes, capacity)
    search.run()
    return [b for b in search.bins if b]


def _pack(capacity: int, round_no: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        if part >> _PARTS or round_no >> 7:
            raise ValueError(f"no container numbers for partition {part} in round {round_no}")
        held: list[pa.RecordBatch] = []
        load = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal load
            items = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            if load >> _LOADS:
                raise ValueError(f"more than {load} loads in a partition; use more partitions")
            sizes = items["tokens"].to_numpy()
            bins = local_search(best_fit(sizes, capacity), sizes, capacity)
            order = np.concatenate([np.array(b, dtype=np.int64) for b in bins])
            number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
            container = ((((round_no << _PARTS) + part) << _LOADS) + load << _NUMBER) + number
            room = capacity - np.bincount(number, weights=sizes[order]).astype(np.int64)[number]
            load += 1
            out = items.take(pa.array(order)).select(["doc_id", "part", "tokens"])
            yield from out.append_column("container", pa.array(container)).append_column("room", pa.array(room)).combine_chunks().to_batches()

        for batch in batches:
            for at in range(0, batch.num_rows, most):
                held.append(batch.slice(at, most))
                if sum(b.num_rows for b in held) >= most:
                    yield from packed()
        if sum(b.num_rows for b in held):
            yield from packed()

    return run


def pack_items(items: DataFrame, capacity: int, load: int = LOAD) -> DataFrame:
    """``doc_id, part, tokens, container, room`` of items ``doc_id, tokens``.

    An item that exceeds the capacity is the only kind that is split: into parts
    of the capacity and a rest, numbered from 0. Every other item is one part 0.
    Items of no tokens, and of a null size, take no room and are assigned too;
    repeated rows are items of their own. ``room`` is what the container has left.
    Loads left partly filled are packed again in further rounds, as long as that
    helps: items that can't fill containers keep the containers they have.
    load: how many items are packed together.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    if not 1 <= load <= 1 << _NUMBER:
        raise ValueError(f"a load must hold 1 to {1 << _NUMBER} items")
    size = F.coalesce(F.col("tokens"), F.lit(0)).cast("long")
    last_part = F.greatest(F.lit(0), F.floor((F.col("all") - 1) / capacity)).cast("long")
    parts = items.select("doc_id", size.alias("all")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last_part)))
    todo = parts.select("doc_id", "part", F.least(F.lit(capacity), F.col("all") - F.col("part") * capacity).cast("long").alias("tokens"))
    schema = T.StructType([todo.schema["doc_id"], *_PACKED])
    done, round_no, loads = None, 1, 0
    before, kept, mixed = None, None, False
    while True:
        placed = stage_table(todo.mapInArrow(_pack(capacity, round_no, load), schema), f"p7-round{round_no}")
        if loads == 1:
            return done.unionByName(placed)
        unfilled = placed.where(F.col("room") > CLOSED * capacity)
        left = unfilled.count()
        now = (left, unfilled.select("container").distinct().count() if left > load else 0)
        stuck = left > load and before is not None and now[0] > (1 - ITEMS_LESS) * before[0] and now[1] > (1 - CONTAINERS_LESS) * before[1]
        if stuck and mixed:
            return done.unionByName(placed if placed.select("container").distinct().count() <= before[1] else kept)
        shut = placed.where(F.col("room") <= CLOSED * capacity)
        done = shut if done is None else done.unionByName(shut)
        if not left:
            return done
        again, loads, round_no = unfilled.drop("container", "room"), -(-left // load), round_no + 1
        before, kept, mixed = now, unfilled, mixed or stuck
        # one load more, as shares of a shuffle aren't quite equal
        todo = again.repartition(loads + 1) if mixed and loads > 1 else again.coalesce(loads)


def containers(documents: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """The documents assigned to containers of ``capacity`` tokens of byte_bpe_50k."""
    return pack_items(token_counts(documents, path=path), capacity)


def summary(packed: DataFrame, capacity: int) -> DataFrame:
    """How well containers are filled: containers, tokens, least possible, fill."""
    by = packed.groupBy("container").agg(F.sum("tokens").alias("t"))
    out = by.agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"))
    return out.select("containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least"), (F.col("tokens") / (F.col("containers") * capacity)).alias("fill"))
