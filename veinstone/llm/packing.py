"""Filling containers of fixed capacity with items of varying size.

Items are dealt by hash to groups of bounded size. In a group a first filling (largest item first into the
tightest bin) is improved by local search: items move between underfull bins, change places one for one, or
two for one, always so that the sum of squared fills grows, until bins run empty and no exchange is left. Full
enough bins are final; what lies in the others is dealt again to fewer groups, pack by pack, until one group is
left or a round has made less than LEAST_FINAL of a pack's items final (dealing again then finds no more).

Defined results: an item larger than the capacity is cut into pieces of the capacity and a rest; no other
item is split; items of size 0 or null take no place and have no row; equal items are kept apart by their key.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veinstone.session import cut

#: Most different containers of one call.
MAX_PACKS = 100
#: Items that one task packs at a time.
GROUP_ITEMS = 4096
#: Share of the capacity from which a bin is final before the last round.
FULL_SHARE = 0.98
#: Share of a pack's items that a round must make final for the rest to be dealt again.
LEAST_FINAL = 0.01


class _Bin:
    __slots__ = ("fill", "items", "number")

    def __init__(self) -> None:
        self.fill, self.items, self.number = 0, [], -1  # (size, item), ascending; place among the takers

    def add(self, size: int, item: int) -> None:
        insort(self.items, (size, item))
        self.fill += size

    def take(self, size: int, item: int) -> None:
        self.items.pop(bisect_left(self.items, (size, item)))
        self.fill -= size


def first_filling(sizes: list[int], capacity: int) -> list[_Bin]:
    """Largest first into the bin with the least room that is enough."""
    bins: list[_Bin] = []
    room: list[tuple[int, int]] = []  # (room, bin), ascending
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[item]
        at = bisect_left(room, (size, -1))
        if at == len(room):
            bins.append(_Bin())
            index = len(bins) - 1
        else:
            index = room.pop(at)[1]
        bins[index].add(size, item)
        if bins[index].fill < capacity:
            insort(room, (capacity - bins[index].fill, index))
    return bins


def _given(items: list[tuple[int, int]]) -> np.ndarray:
    """Distinct sizes of one or two items, ascending; equal sizes count once, however many items a bin holds."""
    sizes = np.array([size for size, _ in items], np.int64)
    single, times = np.unique(sizes, return_counts=True)
    left, right = np.triu_indices(len(single), 1)
    return np.unique(np.concatenate([single, single[left] + single[right], 2 * single[times > 1]]))


def _pick(items: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """One item of that size, else two that add up to it, by two pointers over the ascending sizes."""
    at = bisect_left(items, (size, -1))
    if at < len(items) and items[at][0] == size:
        return [items[at]]
    low, high = 0, len(items) - 1
    while low < high:
        total = items[low][0] + items[high][0]
        if total == size:
            return [items[low], items[high]]
        low, high = (low + 1, high) if total < size else (low, high - 1)
    raise ValueError("no such items")


class _Takers:
    """Bins that may take, with their sizes in one ascending array of (bin, size); each has a size 0, which stands for nothing back."""

    def __init__(self, bins: list[_Bin], capacity: int) -> None:
        self.bins, self.width = bins, capacity + 1
        counts = np.array([len(b.items) + 1 for b in bins], np.int64)
        self.end = np.cumsum(counts)
        flat = np.fromiter((size for b in bins for size in (0, *(size for size, _ in b.items))), np.int64, int(counts.sum()))
        self.keys = flat + np.repeat(np.arange(len(bins)) * self.width, counts)
        self.fill = np.array([b.fill for b in bins], np.int64)
        for number, b in enumerate(bins):
            b.number = number
        self.number = np.arange(len(bins))
        self.room = capacity - self.fill

    def best(self, donor: _Bin) -> tuple[_Bin, int, int] | None:
        """(taker, given size, size back) of the exchange that fills a bin best, else makes squared fills grow most; None if none does."""
        able = np.flatnonzero((self.fill >= donor.fill) & (self.room > 0) & (self.number != donor.number))
        given = _given(donor.items)
        if not len(able) or not len(given):
            return None
        # what comes back for a given size is the least item that makes it fit, nothing if it fits as it is
        least = np.maximum(given[None, :] - self.room[able, None], 0)
        at = np.searchsorted(self.keys, able[:, None] * self.width + least)
        back = self.keys[np.minimum(at, len(self.keys) - 1)] - able[:, None] * self.width
        gain = np.where((at < self.end[able, None]) & (back < given[None, :]), given[None, :] - back, 0)
        # squared fills grow by 2 * gain * (taker.fill - donor.fill + gain), which is positive here
        growth = gain * (self.fill[able, None] - donor.fill + gain).astype(np.float64)
        score = np.where((gain > 0) & (gain == self.room[able, None]), growth + 4.0 * self.width**2, growth)
        i, j = np.unravel_index(int(score.argmax()), score.shape)
        return (self.bins[able[i]], int(given[j]), int(back[i, j])) if gain[i, j] > 0 else None


def _exchange(donor: _Bin, taker: _Bin, size: int, back: int) -> None:
    """Moves one or two items of the given size from donor to taker, and one of size back (0 for none) the other way."""
    out = _pick(donor.items, size)
    for item in out:
        donor.take(*item)
    if back:
        returned = taker.items[bisect_left(taker.items, (back, -1))]
        taker.take(*returned)
        donor.add(*returned)
    for item in out:
        taker.add(*item)


def improve(bins: list[_Bin], capacity: int) -> list[_Bin]:
    """Local search from the emptiest bin upwards, until a pass finds nothing; returns the bins that hold something."""
    while True:
        open_bins = sorted((b for b in bins if 0 < b.fill < capacity), key=lambda b: b.fill)
        found = False
        takers = _Takers(open_bins, capacity)
        for donor in open_bins:
            while donor.items and (best := takers.best(donor)) is not None:
                _exchange(donor, *best)
                found = True
                takers = _Takers([b for b in takers.bins if 0 < b.fill < capacity], capacity)
        if not found:
            return [b for b in bins if b.items]


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of the items of each bin."""
    return [[item for _, item in b.items] for b in improve(first_filling(sizes, capacity), capacity)]


_PACKED = "pack_name string, bin_id string, item_id long, piece int, size long, final boolean"


def pack_items(items: DataFrame, packs: DataFrame, group_items: int = GROUP_ITEMS, full_share: float = FULL_SHARE) -> DataFrame:
    """pack_name, bin_id, item_id, piece, size: every item of items (item_id long, size long) in bins of each capacity of packs.

    packs has pack_name and capacity, at most MAX_PACKS rows of it; each item is packed once per row.
    """
    offered = packs.filter("capacity > 0").select("pack_name", F.col("capacity").cast("long").alias("capacity")).limit(MAX_PACKS + 1).collect()
    if len(offered) > MAX_PACKS:
        raise ValueError(f"more than {MAX_PACKS} containers")
    listed = F.array(*[F.struct(F.lit(r.pack_name).alias("pack_name"), F.lit(r.capacity).cast("long").alias("capacity")) for r in offered])
    if not offered:
        return items.sparkSession.createDataFrame([], _PACKED).drop("final")
    whole = items.filter("size > 0").withColumn("pack", F.explode(listed)).select("item_id", "size", "pack.pack_name", "pack.capacity")
    pieces = (F.ceil(F.col("size") / F.col("capacity"))).cast("int")
    left = cut(
        whole.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
        .select("pack_name", "capacity", F.col("item_id").cast("long").alias("item_id"), "piece", F.least("capacity", F.col("size") - F.col("piece") * F.col("capacity")).cast("long").alias("size"))
    )

    def run(last: frozenset[str], turn: int):
        def one(table: pa.Table) -> pa.Table:
            name, capacity, group = table.column("pack_name")[0].as_py(), table.column("capacity")[0].as_py(), table.column("grp")[0].as_py()
            order = table.sort_by([("item_id", "ascending"), ("piece", "ascending")])
            sizes = order.column("size").to_pylist()
            bins = pack(sizes, capacity)
            ids, numbers, final = [""] * len(sizes), [0] * len(sizes), [False] * len(sizes)
            for i, members in enumerate(bins):
                done = name in last or sum(sizes[m] for m in members) >= full_share * capacity
                for m in members:
                    ids[m], final[m] = f"{turn}-{group}-{i}", done
            return pa.table({
                "pack_name": pa.array([name] * len(sizes), pa.string()), "bin_id": pa.array(ids, pa.string()), "item_id": order.column("item_id"),
                "piece": order.column("piece"), "size": order.column("size"), "final": pa.array(final, pa.bool_()),
            })

        return one

    capacity_of = F.create_map(*[F.lit(x) for r in offered for x in (r.pack_name, r.capacity)])
    results: list[DataFrame] = []
    turn, before = 0, {}
    while True:
        counts = {r.pack_name: r.n for r in left.groupBy("pack_name").agg(F.count("*").alias("n")).collect()}
        if not counts:
            break
        groups = {name: max(1, -(-n // group_items)) for name, n in counts.items()}
        last = frozenset(name for name, n in counts.items() if groups[name] == 1 or (name in before and n > (1 - LEAST_FINAL) * before[name]))
        pairs = F.create_map(*[F.lit(x) for name, n in groups.items() for x in (name, n)])
        # two groups' worth of hash values may differ in size by a few per cent; a hot key is no matter, keys are item and piece
        grouped = left.withColumn("grp", F.pmod(F.xxhash64(F.lit(turn), "item_id", "piece"), pairs[F.col("pack_name")]))
        packed = cut(grouped.groupBy("pack_name", "grp").applyInArrow(run(last, turn), _PACKED))
        results.append(packed.filter("final"))
        left = packed.filter(~F.col("final")).withColumn("capacity", capacity_of[F.col("pack_name")]).select("pack_name", "capacity", "item_id", "piece", "size")
        before, turn = counts, turn + 1
    if not results:
        return items.sparkSession.createDataFrame([], _PACKED).drop("final")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out.drop("final")
