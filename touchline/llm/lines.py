"""Fuzzy line deduplication by MinHash.

Lines with a word are lower-cased, their white space is made even, and their sets of CHARS-character shingles are signed by
one permutation whose values fall into bins; empty bins borrow from others by a fixed schedule. BANDS bands of ROWS bins make
the candidates: at similarity 0.8 a pair shares a band with probability 0.998. Pairs are verified by the exact Jaccard similarity of
their shingle sets, verified pairs are joined by distributed union-find, and of each component the occurrence in the least
(doc_id, line number) stays. Equal lines are one class from the start.

Links are looked for twice: first each line of a band's cell against the cell's shortest one, which joins most groups without
comparing all their members; then, in cells that still hold different components, all pairs of lines of different components.
Pairs within one component cannot change the result and are skipped.

Rows: a null text stays null, and lines without a word always stay; lines shorter than a shingle match only equal ones; texts
and lines of any length are used whole; rows that repeat a doc_id are one document, each losing the same lines; rows with a
null doc_id lose no line and make no other lose one; an empty table gives no rows. Other columns are kept as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .blockwise import RANGES, blocks_for, by_range
from .chunks import POWERS, _powers, mix
from .common import components, finished, likely, table, unlikely, written

#: Characters of a shingle; bands and their rows.
CHARS, BANDS, ROWS = 7, 12, 4
BINS = BANDS * ROWS
#: Characters of lines that are signed at a time, if a line isn't longer, and of those that are hashed at a time; lines that are
#: held to be dealt to ranges together.
WINDOW, PIECE, HELD = 400_000, 50_000, 1 << 17
#: Lines of a cell that are compared in one task with as many others.
BLOCK = 512
_ODD = np.uint64(0xD1342543DE82EF95)
#: White space as `str.split` has it, and hashes of code points; the last entry of the first stands for all that follow.
_WHITE = np.array([chr(i).isspace() for i in range(0x3002)])
_MIXED = mix(np.arange(1 << 14, dtype=np.uint64) + _ODD)

#: A line as it is dealt to a range by its digest, and a class as it is dealt to a range by the key of a band.
LINE = np.dtype([("d0", "<i8"), ("d1", "<i8"), ("doc", "<i8"), ("line", "<i4"), ("size", "<i4"), ("times", "<i8"), ("bands", "<i4", BANDS)])
CELL = np.dtype([("key", "<i8"), ("cid", "<i8"), ("size", "<i4")])
LINES = "doc_id long, line int, d0 long, d1 long, range int, packed binary"
CLASSES = "cid long, doc_id long, line int, times long, d0 long, d1 long, range int, packed binary"
MET = "key long, cid long, size int, first long, _k long"


def even(line: str) -> str:
    return " ".join(line.lower().split())


def evened(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """What `even` makes of lines without line feeds: their code points in one array, and where each line begins, with the end."""
    if not lines:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    text = "\n".join(lines).lower()
    codes = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    white = _WHITE.take(codes, mode="clip")
    # of a run of white space its first character stays, and every line feed
    keep = ~white
    keep[1:] |= keep[:-1].copy()
    keep |= codes == 10
    if not keep.all():
        codes, white = codes[keep], white[keep]
    feed = codes == 10
    last = white & ~feed
    codes = np.where(last, codes.dtype.type(32), codes)
    # but not where a line ends
    last[:-1] &= feed[1:]
    if last.any():
        codes, feed = codes[~last], feed[~last]
    ends = np.append(np.flatnonzero(feed), codes.size)
    return codes[~feed], np.concatenate([[0], ends - np.arange(ends.size)])


def shingles(codes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of evened lines, and where each line's begin, with the end; a shorter line is one shingle, an empty
    one none."""
    size, n = np.diff(begin), codes.size
    base = _powers(1 << POWERS)[0]
    with np.errstate(over="ignore"):
        one = _MIXED.take(codes, mode="clip")
        if (high := codes >= _MIXED.size).any():
            one[high] = mix(codes[high].astype(np.uint64) + _ODD)
        # polynomials of twice as many characters, and those of CHARS put together from them
        part, width, whole, got = one, 1, None, 0
        while width <= CHARS:
            if CHARS & width:
                if whole is None:
                    whole = part
                else:
                    more = part[got:] * base[got]
                    more += whole[: more.size]
                    whole = more
                got += width
            if 2 * width <= CHARS:
                more = part[width:] * base[width]
                more += part[: more.size]
                part = more
            width *= 2
        h = np.zeros(n, np.uint64)
        h[: whole.size] = whole
        h += np.uint64(CHARS)
        count = np.minimum(np.maximum(size - CHARS + 1, 1), size)
        short = np.flatnonzero((size > 0) & (size < CHARS))
        if short.size:
            sums = size[short].astype(np.uint64)
            for k in range(CHARS - 1):
                some = size[short] > k
                sums[some] += one[begin[short[some]] + k] * base[k]
            h[begin[short]] = sums
        keep = np.ones(n, bool)
        for k in range(1, CHARS):
            keep[(begin[1:] - k)[size - count >= k]] = False
        return mix(h[keep]), np.concatenate([[0], np.cumsum(count)])


def _schedule() -> np.ndarray:
    """For each bin, the bins that it borrows from, in turn."""
    rng = np.random.default_rng(15485863)
    return np.stack([rng.permutation(BINS) for _ in range(BINS)])


_BORROW = _schedule()


def pieces(begin: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of lines of PIECE characters, if a line isn't longer."""
    i = 0
    while i < begin.size - 1:
        j = max(i + 1, int(np.searchsorted(begin, begin[i] + PIECE, side="right")) - 1)
        yield i, j
        i = j


def minima(codes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The least value in each bin of each evened line; all bits where there is none."""
    h, begin = shingles(codes, begin)
    low = np.full((begin.size - 1) * BINS, np.uint64(2**64 - 1))
    top = (h >> np.uint64(40)).astype(np.uint32)
    at = np.repeat(np.arange(begin.size - 1) * BINS, np.diff(begin))
    at += top - top // np.uint32(BINS) * np.uint32(BINS)
    h *= _ODD
    h >>= np.uint64(1)
    np.minimum.at(low, at, h)
    return low


def bands(codes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Band keys (32 bits) of each evened line, a row each."""
    n, none = begin.size - 1, np.uint64(2**64 - 1)
    low = np.concatenate([minima(codes[begin[i] : begin[j]], begin[i : j + 1] - begin[i]) for i, j in pieces(begin)])
    low = low.reshape(n, BINS)
    full = low != none
    out = low.copy()
    row, col = np.nonzero(~full)
    for t in range(BINS):
        if not row.size:
            break
        source = _BORROW[col, t]
        got = full[row, source]
        out[row[got], col[got]] = low[row[got], source[got]] + np.uint64(t + 1)
        row, col = row[~got], col[~got]
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD, (n, BANDS)).copy()
        for r in range(ROWS):
            key = mix(key ^ out[:, r::ROWS]) * _ODD
    return (key >> np.uint64(32)).astype(np.uint32).view(np.int32)


def classes_of(rows: np.ndarray) -> np.ndarray:
    """Of LINE rows one for each digest: its least occurrence, and the times of all."""
    rows = rows[np.lexsort([rows["line"], rows["doc"], rows["d1"], rows["d0"]])]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, rows.size), bool), (rows["d0"][1:] != rows["d0"][:-1]) | (rows["d1"][1:] != rows["d1"][:-1])]))
    out = rows[first]
    out["times"] = np.add.reduceat(rows["times"], first) if rows.size else 0
    return out


def packed(rows: np.ndarray, at: np.ndarray, ranges: int) -> tuple[pa.Array, pa.Array]:
    """Numbers of ranges and, for each, those of the rows that are dealt to it, as bytes. at: the range of each row."""
    order = np.argsort(at, kind="stable")
    edge = np.searchsorted(at[order], np.arange(ranges + 1))
    some = np.flatnonzero(np.diff(edge)).tolist()
    rows = rows[order]
    return pa.array(some, pa.int32()), pa.array([rows[edge[r] : edge[r + 1]].tobytes() for r in some], pa.binary())


def _batch(schema: str, **columns: pa.Array) -> pa.RecordBatch:
    """A batch with nulls in the columns that aren't given."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    n = len(next(iter(columns.values())))
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([columns[c].cast(kinds[k]) if c in columns else pa.nulls(n, kinds[k]) for c, k in fields], names=[c for c, _ in fields])


def signed_lines(docs: DataFrame, ranges: int) -> DataFrame:
    """docs(doc_id, text) as LINES: a row with doc_id, line (its number) and digest (d0, d1) for each line with a word, and rows
    with a range and its LINE rows, in which a task's equal lines are one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for rows in windows(batches):
            held.append(rows)
            total += rows.size
            if total >= HELD:
                yield from out(np.concatenate(held))
                held, total = [], 0
        if total:
            yield from out(np.concatenate(held))

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            ids, numbers, lines, chars = [], [], [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                for i, line in enumerate((text.as_py() or "").split("\n")):
                    ids.append(doc_id)
                    numbers.append(i)
                    lines.append(line)
                    chars += len(line)
                    if chars >= WINDOW:
                        yield signed(ids, numbers, lines)
                        ids, numbers, lines, chars = [], [], [], 0
            yield signed(ids, numbers, lines)

    def signed(ids: list[int], numbers: list[int], lines: list[str]) -> np.ndarray:
        codes, begin = evened(lines)
        some = np.flatnonzero(np.diff(begin))
        rows = np.zeros(some.size, LINE)
        digest = np.frombuffer(b"".join(hashlib.blake2b(lines[i].encode(), digest_size=16).digest() for i in some.tolist()), "<i8").reshape(-1, 2)
        rows["doc"], rows["line"] = np.array(ids, np.int64)[some], np.array(numbers, np.int64)[some]
        rows["d0"], rows["d1"], rows["size"], rows["times"] = digest[:, 0], digest[:, 1], np.diff(begin)[some], 1
        if some.size:
            rows["bands"] = bands(codes, np.append(begin[some], codes.size))
        return rows

    def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield _batch(LINES, doc_id=pa.array(rows["doc"]), line=pa.array(rows["line"]), d0=pa.array(rows["d0"]), d1=pa.array(rows["d1"]))
        rows = classes_of(rows)
        yield _batch(LINES, **dict(zip(("range", "packed"), packed(rows, (rows["d0"].view(np.uint64) % np.uint64(ranges)).astype(np.int64), ranges))))

    return docs.mapInArrow(run, LINES)


def line_classes(lines: DataFrame, ranges: int) -> DataFrame:
    """LINES as CLASSES: a row for each different line, with its least occurrence, and rows with a range and its CELL rows: the
    keys of bands, a number for each band and key."""

    def work(number: int, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held = classes_of(np.concatenate([np.frombuffer(x, LINE) for _, x in rows]))
        cid = np.arange(held.size) + (number << 40)
        for i in range(0, held.size, HELD):
            part, own = held[i : i + HELD], cid[i : i + HELD]
            yield _batch(CLASSES, cid=pa.array(own), doc_id=pa.array(part["doc"]), line=pa.array(part["line"]), times=pa.array(part["times"]), d0=pa.array(part["d0"]), d1=pa.array(part["d1"]))
            cells = np.zeros(part.size * BANDS, CELL)
            cells["key"] = ((np.arange(BANDS) << 32) + part["bands"]).ravel()
            cells["cid"], cells["size"] = np.repeat(own, BANDS), np.repeat(part["size"], BANDS)
            yield _batch(CLASSES, **dict(zip(("range", "packed"), packed(cells, (mix(cells["key"].astype(np.uint64)) % np.uint64(ranges)).astype(np.int64), ranges))))

    return by_range(lines.where("range is not null").select("range", "packed"), work, CLASSES, ranges)


def line_cells(classes: DataFrame, ranges: int) -> DataFrame:
    """CLASSES as (key, cid, size, first, _k): the bands' cells of two classes and more, how many these are, and the shortest."""

    def work(_: int, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        cells = np.concatenate([np.frombuffer(x, CELL) for _, x in rows])
        order = np.argsort(cells["key"], kind="stable")
        key = cells["key"][order]
        same = key[1:] == key[:-1]
        cells = cells[order[np.append(same, False) | np.append(False, same)]]
        cells = cells[np.lexsort([cells["cid"], cells["size"], cells["key"]])]
        first = np.flatnonzero(np.diff(cells["key"], prepend=cells["key"][:1] - 1))
        k = np.diff(np.append(first, cells.size))
        for i in range(0, cells.size, HELD):
            part = cells[i : i + HELD]
            centre, times = (np.repeat(x, k)[i : i + HELD] for x in (cells["cid"][first], k))
            yield _batch(MET, key=pa.array(part["key"]), cid=pa.array(part["cid"]), size=pa.array(part["size"]), first=pa.array(centre), _k=pa.array(times))

    return by_range(classes.where("range is not null").select("range", "packed"), work, MET, ranges)


def line_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sets of shingles of lines, sorted. Many are sorted at once, by keys of the line's number and as many bits of the
    shingle's hash as fit."""
    codes, begin = evened(texts.to_pylist())
    # as many for all pieces: their sets are compared
    bits, out = np.uint64(len(texts).bit_length()), []
    for i, j in pieces(begin):
        h, at = shingles(codes[begin[i] : begin[j]], begin[i : j + 1] - begin[i])
        h >>= bits
        h |= np.repeat(np.arange(j - i, dtype=np.uint64) << (np.uint64(64) - bits), np.diff(at))
        h.sort()
        h = h[np.concatenate([[True], h[1:] != h[:-1]])] if h.size else h
        edge = np.searchsorted(h, np.arange(1, j - i, dtype=np.uint64) << (np.uint64(64) - bits)).tolist()
        h &= np.uint64(2**64 - 1) >> bits
        out += [h[a:b] for a, b in zip([0, *edge], [*edge, h.size])]
    return out


def apart_cells(cells: DataFrame, part: DataFrame) -> DataFrame:
    """Blocks of the cells(key, cid, size) that hold different components of part(node, component). Of cells with the same lines
    one is enough."""
    told = cells.join(part.select(F.col("node").alias("cid"), "component"), "cid", "left").select("key", "cid", "size", F.coalesce("component", "cid").alias("part"))
    told = written(told, "line-cells-told")
    same = [F.bit_xor(F.xxhash64("cid", F.lit(i))).alias(f"_h{i}") for i in (0, 1)]
    stats = told.groupBy("key").agg(F.min("part").alias("_x"), F.max("part").alias("_y"), F.count("*").alias("_k"), *same).where("_x <> _y")
    one = stats.groupBy("_h0", "_h1", "_k").agg(F.min("key").alias("key"))
    apart = told.join(one.select("key"), "key").select("key", F.col("cid").alias("id"), "part", "size")
    out = written(blocks.meetings(apart, BLOCK), "line-apart")
    finished(told)
    return out


def removals(docs: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """docs(doc_id, text) as doc_id, line: the lines that go."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).where("doc_id is not null and text is not null")
    ranges = min(blocks_for(docs), RANGES)
    every = written(signed_lines(docs, ranges), "lines")
    # equal lines are one class; a class is known by its least occurrence
    classes = written(line_classes(every, ranges), "classes")
    met = written(line_cells(classes, ranges), "line-cells")
    whole = classes.where("cid is not null")
    pairs = written(met.where("cid <> first").select(F.col("first").alias("a"), F.col("cid").alias("b")).distinct(), "line-pairs")

    ids = met.select("cid").distinct()
    asked = written(whole.join(ids, "cid", "left_semi").select("cid", F.col("doc_id").alias("_doc"), F.col("line").alias("_line")), "asked")
    held = likely(docs, asked.select(F.col("_doc").alias("id")).distinct(), "doc_id").select("doc_id", F.posexplode(F.split("text", "\n")).alias("_n", "text"))
    held = likely(held.withColumn("_at", F.xxhash64("doc_id", "_n")), asked.select(F.xxhash64("_doc", "_line").alias("id")), "_at")
    # rows that repeat a doc_id give one text; the join's own partitioning serves to drop the others
    texts = held.join(asked, (F.col("doc_id") == F.col("_doc")) & (F.col("_n") == F.col("_line"))).dropDuplicates(["doc_id", "_n", "cid"])
    texts = written(texts.select(F.col("cid").alias("id"), "text"), "line-texts")
    links = written(blocks.verified(blocks.stars(pairs, BLOCK).withColumn("part", F.col("id")), texts, line_sets, num, den), "line-links")
    part = written(components(links, "lines"), "line-parts")
    finished(pairs, asked, links)

    # cells in which components are still apart; in one of two lines both were compared
    meet = apart_cells(met.where("_k > 2").select("key", "cid", "size"), part)
    links = written(blocks.verified(meet, texts, line_sets, num, den), "line-links")
    finished(meet, met, texts)
    more = components(links, "line-parts").select(F.col("node").alias("_root"), F.col("component").alias("_to"))
    lone = more.join(part.select(F.col("node").alias("_root")), "_root", "left_anti").select(F.col("_root").alias("node"), F.col("_to").alias("component"))
    both = part.join(more, F.col("component") == F.col("_root"), "left").select("node", F.coalesce("_to", "component").alias("component")).unionByName(lone)
    both = written(both, "line-parts")
    finished(part, links)

    # of each component the least occurrence stays
    told = whole.select("cid", "times", "d0", "d1", F.struct("doc_id", "line").alias("at")).join(both.select(F.col("node").alias("cid"), "component"), "cid", "left").where("times > 1 or component is not null")
    told = told.select("d0", "d1", "at", F.coalesce("component", "cid").alias("component"))
    keeper = told.groupBy("component").agg(F.min("at").alias("stays"))
    goes = written(told.join(keeper, "component").select("d0", "d1", "stays"), "line-keepers")
    finished(classes, both)
    gone = every.where("doc_id is not null").select("doc_id", "line", "d0", "d1").join(goes, ["d0", "d1"]).where((F.col("doc_id") != F.col("stays.doc_id")) | (F.col("line") != F.col("stays.line")))
    return gone.select("doc_id", "line")


def dedup(docs: DataFrame, num: int = 4, den: int = 5, lines: str = "_lines", removed: str = "_removed") -> DataFrame:
    """docs with every column, its text without the lines that go, and the numbers of its lines and of those removed."""
    gone = written(removals(docs, num, den).groupBy(F.col("doc_id").alias("_gone_id")).agg(F.collect_set("line").alias("_gone")), "gone")
    # documents that lose no line aren't moved for the join
    ids = gone.select(F.col("_gone_id").alias("id"))
    # gone grows with the documents, so it isn't broadcast at any size
    some = likely(docs, ids, "doc_id").join(gone.hint("merge"), F.col("doc_id").cast("long") == F.col("_gone_id"), "left")
    rest = unlikely(docs, ids, "doc_id").withColumns({"_gone_id": F.lit(None).cast("long"), "_gone": F.lit(None).cast("array<int>")})
    both = some.unionByName(rest)
    both = both.withColumn("_split", F.when(F.col("_gone").isNotNull(), F.split("text", "\n")))
    left = F.array_except(F.sequence(F.lit(0), F.size("_split") - 1), "_gone")
    kept = F.array_join(F.transform(left, lambda i: F.get("_split", i)), "\n")
    text = F.when(F.col("_gone").isNull() | F.col("text").isNull(), F.col("text")).otherwise(kept)
    counts = [F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias(lines), F.when(F.col("text").isNull() | F.col("_gone").isNull(), F.lit(0)).otherwise(F.size("_gone")).cast("long").alias(removed)]
    return both.select(*(text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns), *counts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every document without the lines that other lines repeat."""
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), lines="n_lines", removed="n_removed")
