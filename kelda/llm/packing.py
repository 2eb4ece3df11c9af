"""Items of varying length in containers of fixed capacity.

Hierarchical residual packing: every task packs its items by best fit, emits the bins that
are nearly full, and hands on the others; those are then items of the next round, packed
by fewer tasks, until one task's worth is left. A bin is a list of item references, so no
join is needed to find where an item went, and a task holds a bounded number of bins.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kelda.session import cut_lineage


@dataclass(frozen=True)
class PackRules:
    """capacity: units of a container. full: fill from which a bin is closed before the last
    round. per_task: open bins one task of a later round packs. worth: share of the open bins
    that a round must do away with for another one to follow."""

    capacity: int = 2048
    full: float = 0.995
    per_task: int = 200_000
    worth: float = 0.1


class BestFit:
    """Best-fit decreasing over a batch of items: each goes into the fullest bin that takes it."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.rooms: list[int] = []
        self.bins: dict[int, list[list]] = defaultdict(list)

    def _put(self, room: int, content: list) -> None:
        if not self.bins[room]:
            insort(self.rooms, room)
        self.bins[room].append(content)

    def add(self, size: int, content: list) -> None:
        at = bisect_left(self.rooms, size)
        if at == len(self.rooms):
            self._put(self.capacity - size, content)
            return
        room = self.rooms[at]
        target = self.bins[room].pop()
        if not self.bins[room]:
            self.rooms.pop(at)
        self._put(room - size, target + content)

    def close(self) -> Iterator[tuple[int, list]]:
        """(fill, content) of every bin, fullest first."""
        for room in self.rooms:
            for content in self.bins[room]:
                yield self.capacity - room, content


_BINS = "fill int, content array<struct<item:long,piece:int,size:int>>"


def _packer(rules: PackRules):
    kind = pa.list_(pa.struct([("item", pa.int64()), ("piece", pa.int32()), ("size", pa.int32())]))
    schema = pa.schema([("fill", pa.int32()), ("content", kind)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_fill: dict[int, list] = defaultdict(list)
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            packed = BestFit(rules.capacity)
            for fill in sorted(by_fill, reverse=True):
                for content in by_fill[fill]:
                    packed.add(fill, content)
            by_fill.clear()
            rows = list(packed.close())
            for at in range(0, len(rows), 10_000):
                part = rows[at : at + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f for f, _ in part], pa.int32()), pa.array([[dict(zip(("item", "piece", "size"), x)) for x in c] for _, c in part], kind)], schema=schema
                )

        for batch in batches:
            fills = batch.column(0).to_pylist()
            content = batch.column(1)
            flat, offsets = content.flatten(), content.offsets.to_numpy()
            base = offsets[0]
            triples = list(zip(flat.field(0).to_pylist(), flat.field(1).to_pylist(), flat.field(2).to_pylist()))
            for i, fill in enumerate(fills):
                by_fill[fill].append(triples[offsets[i] - base : offsets[i + 1] - base])
            held += len(fills)
            if held >= rules.per_task * 4:
                yield from flush()
                held = 0
        yield from flush()

    return pack


def pack(items: DataFrame, item: str, size: str, rules: PackRules = PackRules()) -> DataFrame:
    """container, item, piece, size, fill: every piece of every item once, no container above capacity.

    An item longer than the capacity is cut into full pieces and a rest; others are whole
    (piece 0). ``item`` must be a long that tells rows apart.

    Defined cases: NULL, zero and negative sizes need no room and come out with a NULL
    container; equal items may share a container; an empty input gives no rows. Rounds go
    on while open bins need more than one task and a round still joins a good part of them.
    """
    sized = items.select(F.col(f"`{item}`").cast("long").alias("item"), F.greatest(F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    sized = cut_lineage(sized)
    none = sized.where("size = 0").select(F.lit(None).cast("string").alias("container"), "item", F.lit(0).alias("piece"), F.lit(0).alias("size"), F.lit(0).alias("fill"))
    cap = rules.capacity
    piece = F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / cap).cast("int") - 1)).alias("piece")
    pieces = sized.where("size > 0").select("item", "size", piece)
    pieces = pieces.select("item", "piece", F.least(F.lit(cap), F.col("size") - F.col("piece") * cap).cast("int").alias("size"))
    bins = pieces.select(F.col("size").alias("fill"), F.array(F.struct("item", "piece", "size")).alias("content"))
    packed = cut_lineage(bins.mapInArrow(_packer(rules), _BINS))
    closed: DataFrame | None = None
    tasks, before = packed.rdd.getNumPartitions(), None
    bar = int(rules.full * rules.capacity)
    while True:
        left = packed.where(F.col("fill") < bar)
        n = left.count()
        last = tasks == 1 or n == 0 or (before is not None and n > (1 - rules.worth) * before)
        done = packed if last else packed.where(F.col("fill") >= bar)
        closed = done if closed is None else closed.unionByName(done)
        if last:
            break
        before, tasks = n, max(1, min(-(-n // rules.per_task), tasks // 2))
        packed = cut_lineage(left.repartition(tasks).mapInArrow(_packer(rules), _BINS))
    named = closed.select(
        F.sha2(F.concat_ws(":", F.col("content")[0]["item"].cast("string"), F.col("content")[0]["piece"].cast("string")), 256).substr(1, 24).alias("container"), "fill", F.explode("content").alias("c")
    )
    return named.select("container", "c.item", "c.piece", "c.size", "fill").unionByName(none)
