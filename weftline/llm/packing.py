"""Problem 6: filling containers of fixed capacity with documents.

Documents are spread over shards of some ``SHARD`` items by a hash of their
identity, and every shard is packed on its own, so no task grows with the
collection. In a shard the cost of a container is that of a training sequence:
linear in its tokens plus quadratic in each document's (attention). Items go in
descending order to the container of lowest cost that has room. The number of
containers starts at the lower bound. For items left over, room is gathered in
one container by exchanging items of nearly equal size; only where this fails is
a container added and the shard placed anew.

A text above the capacity is cut into full pieces and a rest, by token ranges;
no other text is cut. Results for odd input: null and empty texts have no
tokens and no container (null); rows with a null or repeated ``doc_id`` are
items of their own; further columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.tokens import TOKENIZER, sized

CAPACITY, SHARD, MOST_TASKS, TRIES, LINEAR, QUADRATIC = 1024, 20_000, 20_000, 64, 1.0, 1.0 / 1024


def _place(sizes: np.ndarray, bins: int, capacity: int) -> tuple[np.ndarray, list[int]]:
    """Containers of the items (descending sizes; -1 where none had room) and the room left in each container."""
    room, out = [capacity] * bins, np.full(len(sizes), -1, np.int64)
    heap: list[tuple[float, int]] = [(0.0, b) for b in range(bins)]
    aside: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]  # by room, too small for now
    low = capacity  # sizes so far were at least this
    for i, size in enumerate(sizes.tolist()):
        while low > size:
            low -= 1
            for entry in aside[low]:
                heapq.heappush(heap, entry)
            aside[low] = []
        while heap and room[heap[0][1]] < size:
            entry = heapq.heappop(heap)
            aside[room[entry[1]]].append(entry)
        if heap:
            cost, b = heap[0]
            room[b] -= size
            heapq.heapreplace(heap, (cost + LINEAR * size + QUADRATIC * size * size, b))
            out[i] = b
    return out, room


class _Containers:
    """Placed items by container, containers by room, and the containers with room that hold an item of a size."""

    def __init__(self, sizes: list[int], placed: np.ndarray, room: list[int]):
        self.sizes, self.placed, self.room = sizes, placed, room
        self.inside: list[list[int]] = [[] for _ in room]
        for i, b in enumerate(placed.tolist()):
            if b >= 0:
                self.inside[b].append(i)
        self.by_room: list[set[int]] = [set() for _ in range(max(room, default=0) + 1)]
        self.holders: dict[int, set[int]] = {}
        for b in range(len(room)):
            self._list(b)

    def _list(self, b: int) -> None:
        if self.room[b]:
            while len(self.by_room) <= self.room[b]:
                self.by_room.append(set())
            self.by_room[self.room[b]].add(b)
            for i in self.inside[b]:
                self.holders.setdefault(self.sizes[i], set()).add(b)

    def _unlist(self, b: int) -> None:
        if self.room[b]:
            self.by_room[self.room[b]].discard(b)
            for i in self.inside[b]:
                self.holders[self.sizes[i]].discard(b)

    def put(self, i: int, b: int) -> None:
        self._unlist(b)
        self.inside[b].append(i)
        self.room[b] -= self.sizes[i]
        self.placed[i] = b
        self._list(b)

    def swap(self, i: int, b: int, j: int, c: int) -> None:
        self._unlist(b)
        self._unlist(c)
        self.inside[b][self.inside[b].index(i)] = j
        self.inside[c][self.inside[c].index(j)] = i
        gain = self.sizes[i] - self.sizes[j]
        self.room[b] += gain
        self.room[c] -= gain
        self.placed[i], self.placed[j] = c, b
        self._list(b)
        self._list(c)

    def widest(self, shut: set[int]) -> int | None:
        """The container of most room but those shut, of equal ones the one of most items."""
        for r in range(len(self.by_room) - 1, 0, -1):
            if self.by_room[r] and (open_ := self.by_room[r] - shut):
                return max(open_, key=lambda b: (len(self.inside[b]), -b))
        return None

    def wider(self, b: int, need: int) -> bool:
        """Gives a container more room, at most ``need``, by exchanging an item against one a little smaller whose container has room for the difference."""
        most = len(self.by_room) - 1
        while most > 0 and not (len(self.by_room[most]) > 1 or self.by_room[most] and b not in self.by_room[most]):
            most -= 1
        most = min(need, most)
        for gain in range(most, 0, -1):
            for i in self.inside[b]:
                for c in self.holders.get(self.sizes[i] - gain, ()):
                    if c != b and self.room[c] >= gain:
                        j = next(j for j in self.inside[c] if self.sizes[j] == self.sizes[i] - gain)
                        self.swap(i, b, j, c)
                        return True
        return False


def _exchange(ranked: np.ndarray, placed: np.ndarray, room: list[int]) -> None:
    """Makes room for items left over: the room of many containers is gathered in the widest one by exchanges of items of nearly equal size.

    Such an exchange hardly changes the cost of either container. Every step widens the container, so it ends.
    """
    held = _Containers(ranked.tolist(), placed, room)
    for i in np.flatnonzero(placed < 0).tolist():
        shut: set[int] = set()
        while placed[i] < 0 and len(shut) < TRIES and (b := held.widest(shut)) is not None:
            while held.room[b] < held.sizes[i] and held.wider(b, held.sizes[i] - held.room[b]):
                pass
            if held.room[b] >= held.sizes[i]:
                held.put(i, b)
            shut.add(b)
        if placed[i] < 0:
            return


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """A container for each item; none of the sizes exceeds the capacity. Placed at lowest cost, in as few containers as that fills."""
    order = np.argsort(-sizes, kind="stable")
    ranked = sizes[order]
    bins = max(1, -(-int(ranked.sum()) // capacity), int((2 * ranked > capacity).sum()))
    while True:
        placed, room = _place(ranked, bins, capacity)
        if (placed < 0).any():
            _exchange(ranked, placed, room)
        left = ranked[placed < 0]
        if not len(left):
            break
        bins += max(1, int(left.sum()) // (2 * capacity))
    out = np.empty(len(sizes), np.int64)
    out[order] = placed
    return out


def _pack_shard(capacity: int):
    schema = pa.schema([("doc_id", pa.int64()), ("part_no", pa.int64()), ("tok_beg", pa.int64()), ("tok_end", pa.int64()), ("container_id", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("part_no", "ascending"), ("tok_end", "ascending")])
        beg, end = table.column("tok_beg").to_numpy(), table.column("tok_end").to_numpy()
        some, container = end > beg, np.zeros(len(beg), np.int64)
        container[some] = pack((end - beg)[some], capacity) + (table.column("shard")[0].as_py() << 32)
        return pa.table([table.column("doc_id"), table.column("part_no"), beg, end, pa.array(container, mask=~some)], schema=schema)

    return run


def packed(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, part_no, tok_beg, tok_end, container_id``: where each document, or each piece of an oversized one, lies."""
    shards = max(1, -(-docs.count() // shard))
    sizes = sized(docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("spread")), ["doc_id", "spread"], path=path)
    last = F.greatest(F.lit(0), F.ceil(F.col("tokens") / capacity) - 1)
    items = sizes.select("doc_id", F.pmod("spread", F.lit(shards)).alias("shard"), "tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("part_no"))
    items = items.select("doc_id", "shard", "part_no", (F.col("part_no") * capacity).alias("tok_beg"), F.least("tokens", (F.col("part_no") + 1) * capacity).alias("tok_end"))
    schema = "doc_id bigint, part_no bigint, tok_beg bigint, tok_end bigint, container_id bigint"
    # The number of partitions is given, as the rows are small and the work on them is not.
    return items.repartition(min(2 * shards, MOST_TASKS), "shard").groupBy("shard").applyInArrow(_pack_shard(capacity), schema)


def fill_report(packing: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``containers, tokens, least_containers, fill``: how full the containers are."""
    used = packing.where("container_id IS NOT NULL").groupBy("container_id").agg(F.sum(F.col("tok_end") - F.col("tok_beg")).alias("tokens"))
    total = used.agg(F.count("*").alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return total.select("containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least_containers"), F.try_divide(F.col("tokens"), F.col("containers") * capacity).alias("fill"))
