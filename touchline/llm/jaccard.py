"""Exact n-gram Jaccard join by count vectors.

Texts become sets of word shingles; texts with equal sets are one class. Shingles are hashed to groups, more of them for larger
sets, and a class is the point of its group counts: for two sets, the sum of the smaller counts of each group bounds their overlap, and over two
boxes of points the sum of the smaller corners bounds it for all their pairs. Points are indexed as leaves of boxes (a packed
R-tree), leaves and then points are compared by that bound, and the pairs that survive are verified on their whole texts.

An index of all points would have to visit nearly every leaf, as boxes in many dimensions overlap; so there is a tree for each
cell of classes that share a shingle among their rarest (sets of Jaccard similarity t share one among the first
n - ceil(t n) + 1 in any common order, and the smaller set among its first n - ceil(2 t n / (1 + t)) + 1). The order puts
shingles that documents are known to share last. Cells lose no link: every class is in the cells of all its leading shingles.

Links are looked for twice. First each cell's classes meet its centre, the one whose leading shingles are shared the most: near
copies of one text differ from each other more than from that text, which holds all that they share. Then, in cells that still
hold different components, the trees leave a graph of pairs that the bound can't rule out. No such pair leaves a component of
that graph, so each of them is verified as one group, to which every text goes once; large groups are cut to blocks. Pairs within
one component of links cannot change the result and are skipped.

Rows: a null or empty text, or one without words, has an empty set and links with nothing; texts of any length are used whole;
rows that repeat a doc_id are one document with several texts, each row with its own n_shingles; a null doc_id links with
nothing and has a null component; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .common import components, finished, likely, table, unlikely, without, written
from .shingles import shingle_sets

#: Least number of groups of shingles, points of a leaf, and classes of a cell that are compared in one task.
GROUPS, LEAF, BLOCK = 128, 32, 512
#: Bits of the map of shared shingles, documents of one task that make a shingle shared, and cells of the map in a row of
#: it. They only change the order, never the result.
MAP_BITS, SHARED, SEGMENT = 25, 4, 1 << 20


def leading(n: int, num: int, den: int) -> tuple[int, int]:
    """Lengths of the leading parts of a set of n for similarity num / den: as the larger of a pair, and as the smaller."""
    return n - -(-num * n // den) + 1, n - -(-2 * num * n // (num + den)) + 1


def shared_shingles(docs: DataFrame) -> np.ndarray:
    """A map of 2^MAP_BITS cells, a bit each: those of shingles that SHARED documents of one task hold. Shingles of a passage
    that many documents share are all but sure to meet in some task; one that few share makes a small cell anyway. Counters and
    map have a fixed size; where the map fills up, the order comes to be that of the hashes alone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(1 << MAP_BITS, np.uint8)
        held: list[np.ndarray] = []

        def settle() -> None:
            cells = np.sort((np.concatenate(held) >> np.uint64(64 - MAP_BITS)).astype(np.int32)) if held else np.zeros(0, np.int32)
            first = np.flatnonzero(np.concatenate([cells[:1] == cells[:1], cells[1:] != cells[:-1]]))
            n = np.diff(np.append(first, cells.size))
            times[cells[first]] = np.minimum(times[cells[first]] + n, 255)
            held.clear()

        for b in batches:
            size = 0
            for s in shingle_sets(b.column(0)):
                held.append(s)
                size += s.size
                if size > 1_000_000:
                    settle()
                    size = 0
            settle()
        cells = np.flatnonzero(times >= SHARED)
        words, at = np.unique(cells >> 6, return_index=True)
        bits = np.bitwise_or.reduceat(np.int64(1) << (cells & 63), at) if cells.size else cells
        yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int32)), pa.array(bits)], names=["word", "bits"])

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        part = np.zeros(SEGMENT >> 6, np.int64)
        part[pdf["word"].to_numpy(np.int64) % (SEGMENT >> 6)] = pdf["bits"].to_numpy(np.int64)
        return pd.DataFrame({"segment": [key[0]], "bits": [part.tobytes()]})

    words = docs.select("text").mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    # the driver gets the map in a few rows of 128 kB, as many for any input
    segments = words.groupBy(F.floor(F.col("word") / (SEGMENT >> 6)).cast("int").alias("segment")).applyInPandas(fill, "segment int, bits binary")
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    for r in segments.collect():
        out[r["segment"] * (SEGMENT >> 6) :][: SEGMENT >> 6] = np.frombuffer(r["bits"], np.int64)
    return out


def packed_point(s: np.ndarray) -> bytes:
    """Counts by group: a power of two of groups, at least GROUPS and, beyond that, one for one or two shingles; a byte each, or
    four, after a byte that says so."""
    groups = max(GROUPS, 1 << (max(s.size, 1).bit_length() - 1))
    n = np.bincount(((s >> np.uint64(20)) % np.uint64(groups)).astype(np.int64), minlength=groups)
    wide = bool(n.max(initial=0) > 255)
    return bytes([wide]) + n.astype("<u4" if wide else "u1").tobytes()


def point_of(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u4" if packed[0] else "u1", offset=1).astype(np.int32)


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    """A point, or points in rows, with so many groups or fewer; the groups of fewer are unions of those of more."""
    return point if point.shape[-1] <= groups else point.reshape(*point.shape[:-1], -1, groups).sum(axis=-2)


def signatures(docs: DataFrame, num: int, den: int) -> DataFrame:
    """docs(doc_id, text) as doc_id, n_shingles, f1, f2 (together the set's fingerprint), counts, lead (leading shingles in
    the common order) and small (how many of them lead it as the smaller of a pair)."""
    common = docs.sparkSession.sparkContext.broadcast(shared_shingles(docs))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = common.value
        with np.errstate(over="ignore"):
            for b in batches:
                n, f1, f2, counts, lead, small = [], [], [], [], [], []
                for s in shingle_sets(b.column(1)):
                    n.append(s.size)
                    f1.append(int(np.add.reduce(s * np.uint64(0x9FB21C651E98DF25)).view(np.int64)) if s.size else 0)
                    f2.append(int(np.add.reduce((s ^ (s >> np.uint64(31))) * s).view(np.int64)) if s.size else 0)
                    counts.append(packed_point(s))
                    large, few = leading(s.size, num, den) if s.size else (0, 0)
                    cell = (s >> np.uint64(64 - MAP_BITS)).astype(np.int64)
                    late = (shared[cell >> 6] >> (cell & 63)) & 1 == 1
                    s = np.concatenate([s[~late], s[late]])
                    lead.append(s[:large].view(np.int64))
                    small.append(few)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(counts, pa.binary()), pa.array(lead, pa.list_(pa.int64())), pa.array(small, pa.int32())],
                    names=["doc_id", "n_shingles", "f1", "f2", "counts", "lead", "small"],
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, counts binary, lead array<long>, small int")


def near(pairs: DataFrame, points: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs(a, b), those that the bound of their points(cls, n, counts) doesn't rule out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(*(b.column(i).to_pylist() for i in (2, 3))):
                x, y = point_of(x), point_of(y)
                groups = min(x.size, y.size)
                keep.append(int(np.minimum(folded(x, groups), folded(y, groups)).sum()) * (num + den) >= num * int(x.sum() + y.sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, other = (points.select(F.col("cls").alias(c), F.col("counts").alias(x)) for c, x in (("a", "x"), ("b", "y")))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of documents that may be among ids(id); the bounded filter lets all that are among them pass."""
    return likely(docs, ids, "doc_id").select(F.col("doc_id").alias("id"), "text")


def tree_graph(n: np.ndarray, part: np.ndarray, points: list[np.ndarray], side: np.ndarray, num: int, den: int) -> np.ndarray:
    """For each row of a cell the least row that it is connected to by pairs of different components that the bound doesn't rule
    out; -1 for a row without such a pair. n: sizes, in ascending order; side: 0 or 1 if only rows of different sides are to be
    paired, else 2."""
    root, met = np.arange(n.size), np.zeros(n.size, bool)
    # points of a leaf have equally many groups; with fewer, the bound would be looser than theirs
    cuts = np.flatnonzero(np.diff([p.size for p in points], prepend=0, append=0)).tolist()
    leaves = [slice(i, min(i + LEAF, y)) for x, y in zip(cuts, cuts[1:]) for i in range(x, y, LEAF)]
    held = [np.stack(points[s]) for s in leaves]
    tops = [p.max(axis=0) for p in held]
    sizes = np.array([(n[s.start], n[s.stop - 1]) for s in leaves])
    for i, s in enumerate(leaves):
        groups = held[i].shape[1]
        # the larger of two similar sets is at most den / num times the smaller
        for j in (np.flatnonzero(sizes[i:, 0] * num <= sizes[i, 1] * den) + i).tolist():
            # boxes, then points
            if np.minimum(folded(tops[j], groups), tops[i]).sum() * (num + den) < num * (sizes[i, 0] + sizes[j, 0]):
                continue
            t = leaves[j]
            others = folded(held[j], groups)
            for a in range(s.start, s.stop):
                b = np.arange(max(t.start, a + 1), t.stop)
                b = b[(part[b] != part[a]) & (n[b] * num <= n[a] * den) & ((side[b] == 2) | (side[b] != side[a]))]
                if b.size:
                    b = b[np.minimum(others[b - t.start], held[i][a - s.start]).sum(axis=1) * (num + den) >= num * (n[a] + n[b])]
                if b.size:
                    met[a] = met[b] = True
                    joined = np.unique(np.append(root[b], root[a]))
                    if joined.size > 1:
                        root[np.isin(root, joined)] = joined[0]
    return np.where(met, root, -1)


def _cell_graph(batches: Iterable[pd.DataFrame], num: int, den: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by cell and block pair; a cell's rows may go on in the next batch."""
    rest = None
    keys = ["key", "low", "high"]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        n, part, side, cls = (pdf[c].to_numpy(np.int64) for c in ("n", "part", "side", "id"))
        points = [point_of(p) for p in pdf["counts"]]
        edge = np.flatnonzero((pdf[keys].to_numpy()[1:] != pdf[keys].to_numpy()[:-1]).any(axis=1)) + 1
        a, b = [], []
        for x, y in zip([0, *edge.tolist()], [*edge.tolist(), len(pdf)]):
            order = x + np.lexsort([cls[x:y], n[x:y]])
            root = tree_graph(n[order], part[order], [points[k] for k in order.tolist()], side[order], num, den)
            live = np.flatnonzero((root >= 0) & (root != np.arange(root.size)))
            a.append(cls[order[root[live]]])
            b.append(cls[order[live]])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()

    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        last = (pdf[keys] == pdf[keys].iloc[-1]).all(axis=1).to_numpy() if len(pdf) else np.zeros(0, bool)
        if not last.all():
            yield work(pdf[~last])
        rest = pdf[last] if len(pdf) else None
    if rest is not None and len(rest):
        yield work(rest)


def cells_of(own: DataFrame, num: int, den: int) -> DataFrame:
    """own(cls, n, lead, small) as cells (token, cls, n, centre, centre_n): classes that share a leading shingle, at least one of
    them as the smaller of a pair. Counts of shingles are partial before they are shuffled, and a hot one's rows are split by
    the join."""
    token = own.select("cls", "n", "small", F.posexplode("lead").alias("_at", "token")).select("token", "cls", "n", (F.col("_at") < F.col("small")).alias("small"))
    shared = token.groupBy("token").agg(F.count("*").alias("k"), F.bool_or("small").alias("_ok")).where("k > 1 and _ok").select("token", "k")
    cells = written(token.select("token", "cls", "n").join(shared, "token"), "cells")
    # how much of what leads a class is shared, and by how many
    lead = F.col("n") - F.ceil(F.col("n") * num / den) + 1
    rank = cells.groupBy("cls").agg(F.sum(F.log2("k")).alias("_s"))
    ranked = cells.join(rank, "cls").select("token", "cls", "n", (F.col("_s") / lead).alias("_s"))
    centre = ranked.groupBy("token").agg(F.max(F.struct("_s", (-F.col("cls")).alias("_c"), "n")).alias("_m"))
    out = written(cells.select("token", "cls", "n").join(centre.select("token", (-F.col("_m._c")).alias("centre"), F.col("_m.n").alias("centre_n")), "token"), "cells")
    finished(cells)
    return out


def candidate_groups(cells: DataFrame, part: DataFrame, points: DataFrame, num: int, den: int) -> DataFrame:
    """(key, id, part, n): groups of classes that no pair leaves which the bounds of cells(token, cls, n) don't rule out, among
    those of different components part(node, component)."""
    told = written(cells.join(part.select(F.col("node").alias("cls"), "component"), "cls", "left").select("token", "cls", "n", F.coalesce("component", "cls").alias("part")), "told")
    # of cells with the same classes one is enough
    same = [F.bit_xor(F.xxhash64("cls", F.lit(i))).alias(f"_h{i}") for i in (0, 1)]
    stats = told.groupBy("token").agg(F.min("part").alias("_x"), F.max("part").alias("_y"), F.count("*").alias("_k"), *same).where("_x <> _y")
    one = stats.groupBy("_h0", "_h1", "_k").agg(F.min("token").alias("token"))
    apart = told.join(one.select("token"), "token").select(F.col("token").alias("key"), F.col("cls").alias("id"), "part", F.lit(0).alias("size"))
    # a set's size comes with its point: a doc_id with several texts has as many of both
    rows = blocks.meetings(apart, BLOCK).join(points.select(F.col("cls").alias("id"), "n", "counts"), "id")
    placed = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    graph = placed.select("key", "low", "high", "side", "id", "n", "part", "counts").mapInPandas(lambda it: _cell_graph(it, num, den), "a long, b long")
    group = components(graph, "groups").select(F.col("node").alias("id"), F.col("component").alias("key"))
    ids = told.select(F.col("cls").alias("id"), "n", "part").distinct()
    out = written(group.join(ids, "id").select("key", "id", "part", "n"), "groups")
    finished(told)
    return out


def join(docs: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """docs(doc_id, text) as doc_id, n_shingles, component_id: documents whose sets' Jaccard similarity is at least num / den
    are linked."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    every = written(signatures(docs, num, den), "signatures")
    some = every.where("n_shingles > 0 and doc_id is not null")
    # texts with equal sets are one class, known by its least doc_id
    classes = some.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("cls"), F.count("*").alias("_k")).where("_k > 1")
    equal = written(some.select("doc_id", "f1", "f2", "n_shingles").join(classes, ["f1", "f2", "n_shingles"]).select("doc_id", "f1", "cls").distinct(), "copies")
    copies = equal.where("doc_id <> cls").select(F.col("doc_id").alias("a"), F.col("cls").alias("b"))
    more = copies.select(F.col("a").alias("id")).distinct()
    gone = likely(some, more, "doc_id").join(equal.where("doc_id <> cls").select("doc_id", "f1"), ["doc_id", "f1"], "left_anti")
    own = unlikely(some, more, "doc_id").unionByName(gone.select(*some.columns)).select(F.col("doc_id").alias("cls"), F.col("n_shingles").alias("n"), "f1", "counts", "lead", "small")

    cells = cells_of(own.select("cls", "n", "lead", "small"), num, den)
    held = cells.select(F.col("cls").alias("id")).distinct()
    # a doc_id that repeats with other texts has several points; each row meets all of them, its own among them
    points = written(likely(own.select("cls", "f1", "n", "counts"), held, "cls").join(held, F.col("cls") == F.col("id"), "left_semi").dropDuplicates(["cls", "f1"]).select("cls", "n", "counts"), "points")
    sizes = written(every.select("doc_id", "n_shingles"), "sizes")
    finished(every)
    size = f"cls <> centre and least(n, centre_n) * {den} >= greatest(n, centre_n) * {num}"
    pairs = written(near(cells.where(size).select(F.col("centre").alias("a"), F.col("cls").alias("b")).distinct(), points, num, den), "star")
    star = written(blocks.stars(pairs, blocks.BLOCK).withColumn("part", F.col("id")), "stars")
    links = written(blocks.verified(star, texts_of(docs, star.select("id").distinct()), shingle_sets, num, den).unionByName(copies), "links")
    finished(pairs, star)
    part = written(components(links, "near"), "near")

    groups = candidate_groups(cells, part, points, num, den)
    finished(cells, points, part)
    meet = written(blocks.meetings(groups.withColumn("size", F.col("n")), blocks.BLOCK), "meet")
    more = written(blocks.verified(meet, texts_of(docs, meet.select("id").distinct()), shingle_sets, num, den), "links")
    whole = written(components(links.unionByName(more), "all"), "all")
    finished(groups, meet, links, more, equal)
    out = sizes.join(whole.select(F.col("node").alias("doc_id"), F.col("component")), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def thin_out(docs: DataFrame, num: int = 4, den: int = 5, also: DataFrame | None = None) -> DataFrame:
    """docs with all columns, of each group of linked documents one row: of the least doc_id and, where its rows repeat, the one
    with the least hash of its text. Rows with a null doc_id are in no group and stay. also(doc_id, text): further texts by
    which documents of docs are known, such as those from before an earlier stage's cuts; those of other doc_ids are ignored."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if also is not None:
        here = also.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        # most texts are the same as before; hashes tell which, and only others are moved, once, and kept for all that read them
        key = ["doc_id", F.xxhash64("text").alias("_h")]
        known = here.select(*key).join(texts.select(F.col("doc_id").alias("id")).where("id is not null").distinct(), F.col("doc_id") == F.col("id"), "left_semi")
        changed = written(known.join(texts.select(*key), ["doc_id", "_h"], "left_anti").select(F.col("doc_id").alias("id")).distinct(), "changed")
        earlier = written(likely(here, changed, "doc_id").join(changed, F.col("doc_id") == F.col("id"), "left_semi"), "earlier")
        finished(changed)
        texts = texts.unionByName(earlier)
    parts = join(texts, num, den).where("doc_id is not null")
    if also is not None:
        finished(earlier)
    gone = written(parts.where("component_id <> doc_id").select(F.col("doc_id").alias("id")).distinct(), "gone")
    left = without(docs, gone, "doc_id")
    again = written(left.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.count("*").alias("_k")).where("_k > 1 and id is not null").select("id"), "repeated")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    some = likely(left.select(row, F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_h")), again, "_id").join(again, F.col("_id") == F.col("id"), "left_semi")
    one = some.groupBy("_id").agg(F.min_by("_row", "_h").alias("_row")).select("_row.*")
    return without(left, again, "doc_id").unionByName(one)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every document's set size and component at similarity 0.8."""
    return join(table(spark, sf_dir, "documents"))
