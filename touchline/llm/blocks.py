"""Verification in blocks: groups of candidates are cut so that no task holds a whole group, and each block's texts move once.

A star is a centre and members to be compared with it alone: members are dealt to blocks by a hash, and the centre goes once to
each block. A group is compared with itself: a small one is a block; of a large one, the members outside its largest component
are dealt to blocks, all members to others, and each of the former meets each of the latter. Members of the largest component
needn't meet each other, so a group of which nearly all are linked costs little more than its size. Within a block, pairs of one
component are skipped, the others are bounded by group counts and then verified exactly, and a link joins their components for
the pairs that follow; so a block gives fewer links than it has members, however many of its pairs are similar.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members of a block.
BLOCK = 256
#: Items of a block's sets, together; a larger set has a block of its own.
ITEMS = 1 << 22
#: Characters of blocks that are verified together, if a block isn't longer; counts of points held for them; pairs listed at a
#: time.
CHARS, CELLS, PAIRS = 1 << 18, 1 << 20, 1 << 18

Sets = Callable[[pa.Array], Iterable[np.ndarray]]


def stars(pairs: DataFrame, block: int) -> DataFrame:
    """pairs(a, b): b is to be compared with its centre a. Rows (key, low, high, side, id)."""
    spread = pairs.groupBy("a").agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    members = pairs.join(spread, "a").select(F.col("a").alias("key"), F.pmod(F.xxhash64("b"), F.col("_n")).cast("int").alias("low"), F.lit(1).alias("side"), F.col("b").alias("id"))
    centres = spread.select(F.col("a").alias("key"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("low"), F.lit(0).alias("side"), F.col("a").alias("id"))
    return members.unionByName(centres).select("key", "low", F.lit(0).alias("high"), "side", "id")


def meetings(rows: DataFrame, block: int, *keep: str) -> DataFrame:
    """rows(key, id, part, size, keep...): all members of a key that are of different parts are to be compared. Rows (key, low,
    high, side, id, part, keep...), for keys with several parts."""
    by_part = rows.groupBy("key", "part").agg(F.count("*").alias("_c"), F.sum("size").alias("_z"))
    by_key = by_part.groupBy("key").agg(F.max(F.struct("_c", "part")).alias("_m"), F.sum("_c").alias("_k"), F.sum("_z").alias("_z"), F.count("*").alias("_parts")).where("_parts > 1")
    every = F.greatest(F.ceil(F.col("_k") / block), F.ceil(F.col("_z") / ITEMS))
    minor = F.ceil(every * (F.col("_k") - F.col("_m._c")) / F.col("_k"))
    known = rows.join(by_key.select("key", F.col("_m.part").alias("_major"), every.cast("int").alias("_every"), minor.cast("int").alias("_minor")), "key")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    at = lambda low, high, side: F.struct(*(x.cast("int").alias(c) for x, c in ((low, "low"), (high, "high"), (F.lit(side), "side"))))
    each = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    few = F.when(F.col("part") != F.col("_major"), each("_every", lambda i: at(own("_minor"), i, 0))).otherwise(F.array().cast("array<struct<low:int,high:int,side:int>>"))
    all_ = each("_minor", lambda i: at(i, own("_every"), 1))
    # all of a row's places in one list: rows are computed for the sums and once more
    places = F.when(F.col("_every") == 1, F.array(at(F.lit(0), F.lit(0), 2))).otherwise(F.concat(few, all_))
    return known.select("key", F.explode(places).alias("_at"), "id", "part", *keep).select("key", "_at.low", "_at.high", "_at.side", "id", "part", *keep)


def overlap_points(sets: list[np.ndarray]) -> np.ndarray:
    """Each set's counts of items by group; the smaller counts of two sets sum to their overlap at least. About as many groups as
    a large set has items keep the bound close, as far as CELLS allows."""
    want = max(map(len, sets), default=0).bit_length()
    groups = 1 << max(6, min(want, (CELLS // max(1, len(sets))).bit_length() - 1))
    at = np.repeat(np.arange(len(sets)) * groups, [s.size for s in sets])
    group = (np.concatenate(sets) >> np.uint64(20)) & np.uint64(groups - 1) if sets else np.zeros(0, np.uint64)
    return np.bincount(at + group.astype(np.int64), minlength=len(sets) * groups).astype(np.int32).reshape(-1, groups)


def part_links(sets: list[np.ndarray], cell: np.ndarray, part: np.ndarray, side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Components that similar sets of one cell link, in pairs: enough of them to join all that any pair would. sets: sorted,
    without repeats; cell, part: numbers of each one's cell and component; side: 0 or 1 if only sets of different sides are to be
    compared, else 2. Similar: den * overlap >= num * union, with an overlap."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    points = overlap_points(sets)
    order = np.lexsort([size, cell])
    order = order[size[order] > 0]
    size, cell, part, side = size[order], cell[order], part[order], side[order]
    # candidates of a set follow it in its cell; the larger of two similar ones is at most den / num times the smaller
    rank = np.unique(cell, return_inverse=True)[1].astype(np.int64) * (int(size.max(initial=0)) * den + den)
    stop = np.searchsorted(rank + size * num, rank + np.minimum(size * den, int(size.max(initial=0)) * num), side="right")
    count = stop - np.arange(size.size) - 1
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out, first, step = [], 0, max(1, CELLS // points.shape[1] // 16)
    ends = np.cumsum(count)
    while first < size.size:
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, side="right")))
        a = np.repeat(np.arange(first, last), count[first:last])
        b = a + 1 + np.arange(a.size) - np.repeat(np.cumsum(count[first:last]) - count[first:last], count[first:last])
        first = last
        ok = (part[a] != part[b]) & ((side[a] == 2) | (side[a] != side[b]))
        a, b = a[ok], b[ok]
        for x in range(0, a.size, step):
            i, j = a[x : x + step], b[x : x + step]
            near = np.minimum(points[order[i]], points[order[j]]).sum(axis=1) * (num + den) >= num * (size[i] + size[j])
            for i, j in zip(i[near].tolist(), j[near].tolist()):
                one, other = root(int(part[i])), root(int(part[j]))
                if one != other:
                    both = np.concatenate([sets[order[i]], sets[order[j]]])
                    both.sort()
                    shared = np.count_nonzero(both[1:] == both[:-1])
                    if shared and shared * (num + den) >= num * (size[i] + size[j]):
                        out.append((min(one, other), max(one, other)))
                        parent[out[-1][1]] = out[-1][0]
    return out


def verified(rows: DataFrame, texts: DataFrame, sets: Sets, num: int, den: int) -> DataFrame:
    """rows(key, low, high, side, id, part) and texts(id, text) as links(a, b) between parts. Blocks are streamed to their tasks
    one after the other and verified some at a time; an id with several texts has a row for each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell, held, chars = None, 0, ([], [], [], []), 0

        def out() -> pa.RecordBatch:
            cells, part, side, text = held
            # the same text is often in several cells
            kinds = dict.fromkeys(text)
            own = dict(zip(kinds, sets(pa.array(list(kinds), pa.large_string()))))
            links = part_links([own[t] for t in text], *(np.array(x, np.int64) for x in (cells, part, side)), num, den) if text else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for b in batches:
            for key, low, high, s, p, text in zip(*(c.to_numpy().tolist() for c in b.columns[:5]), b.column(5).to_pylist()):
                if (key, low, high) != now:
                    now, cell = (key, low, high), cell + 1
                    if chars >= CHARS:
                        yield out()
                        held, chars = ([], [], [], []), 0
                for column, x in zip(held, (cell, p, s, text)):
                    column.append(x)
                chars += len(text or "")
        yield out()

    placed = rows.join(texts, "id").select("key", "low", "high", "side", "part", "text").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return placed.mapInArrow(run, "a long, b long").distinct()
