"""Questions about all documents, asked by blocks of them.

Documents are dealt to blocks of about BLOCK bytes of text by a hash. A block asks for its different 64-bit keys, each once
however often it occurs, with its count of it; keys are dealt to ranges, in which the counts of all blocks meet, and each block
gets its answers back. Keys move as sorted arrays, a row for each block and range, so a key that every block holds is a number in
each row and no hot group. There are as many ranges as blocks, but RANGES at most, so that rows stay long. Ranges are read row by
row: what a task holds are a range's different keys, or a block's, but never all that blocks ask. The answers then meet the
block's documents, which are read one after the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import text_bytes

#: Bytes of texts of a block; bytes of texts that are worked on at a time, if a text isn't longer; least number of blocks; keys
#: that are held before those that are equal are put together; ranges, at most; keys of a row of totals.
BLOCK, WINDOW, LEAST, HELD, RANGES, ROW = 1 << 24, (1 << 20) - 1, 8, 1 << 20, 4096, 1 << 20
#: Rows of a batch that are taken up at a time.
ROWS = 256

Keys = tuple[np.ndarray, np.ndarray]
QUESTIONS = "block int, range int, size int, keys binary, counts binary"


def blocks_for(docs: DataFrame, block: int = BLOCK) -> int:
    """The number of blocks for docs(text)."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(LEAST, -(-size // block))


def dealt(docs: DataFrame, blocks: int) -> DataFrame:
    """docs(doc_id, text, ...) with their block. Rows with the same doc_id and text are of one block."""
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))


def pack(values: np.ndarray, sorted_: bool) -> bytes:
    """Unsigned 64-bit integers, or the differences of sorted ones, byte by byte."""
    steps = np.diff(values, prepend=values[:1] * 0) if sorted_ else values
    return zstandard.ZstdCompressor(level=1).compress(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(data: bytes, sorted_: bool) -> np.ndarray:
    steps = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64) if sorted_ else steps


def together(keys: np.ndarray, counts: np.ndarray) -> Keys:
    """Sorted different keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable") if keys.size else np.zeros(0, np.int64)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if keys.size else order
    return keys[first], np.add.reduceat(counts, first) if keys.size else counts


class Gathered:
    """Keys of many windows."""

    def __init__(self) -> None:
        self.held: list[Keys] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.held.append((keys, counts))
        self.size += keys.size
        if self.size > HELD:
            one = self.done()
            self.held, self.size = [one], 0

    def done(self) -> Keys:
        return together(np.concatenate([k for k, _ in self.held] or [np.zeros(0, np.uint64)]), np.concatenate([c for _, c in self.held] or [np.zeros(0, np.int64)]))


def windows(batch: pa.RecordBatch, text: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of a batch, from row i to row j: their bytes, and where each text begins, with the end."""
    size = pc.binary_length(batch.column(text)).fill_null(0).to_numpy().astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + WINDOW, side="right")) - 1)
        yield i, j, *text_bytes(batch.column(text).slice(i, j - i))
        i = j


def runs(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Stretches of rows with the same number in a column."""
    values = batch.column(column).to_numpy()
    edge = np.flatnonzero(np.diff(values, prepend=values[:1] - 1)).tolist() if values.size else []
    for a, b in zip(edge, [*edge[1:], values.size]):
        yield int(values[a]), batch.slice(a, b - a)


def questions(docs: DataFrame, keys_of: Callable[[pa.RecordBatch, int, int, np.ndarray, np.ndarray], Keys], range_of: Callable[[np.ndarray], np.ndarray], blocks: int) -> DataFrame:
    """docs(block, text, ...) as QUESTIONS. keys_of: keys and counts of a window of a batch; range_of: a number for each key, of
    which the remainder by the number of ranges is its range."""
    ranges = min(blocks, RANGES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, Gathered()

        def out() -> Iterator[pa.RecordBatch]:
            keys, counts = held.done()
            at = (range_of(keys) % np.uint64(ranges)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            edge = np.searchsorted(at[order], np.arange(ranges + 1))
            some = np.flatnonzero(np.diff(edge)).tolist()
            parts = [order[edge[r] : edge[r + 1]] for r in some]
            columns = [pa.array([now] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array(list(map(len, parts)), pa.int32()), pa.array([pack(keys[p], True) for p in parts], pa.binary()), pa.array([pack(counts[p], False) for p in parts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "range", "size", "keys", "counts"])

        for b in batches:
            for block, part in runs(b, 0):
                if block != now:
                    if now is not None:
                        yield from out()
                    now, held = block, Gathered()
                for window in windows(part, 1):
                    held.add(*keys_of(part, *window))
        if now is not None:
            yield from out()

    rest = [c for c in docs.columns if c not in ("block", "text")]
    placed = docs.select("block", "text", *rest).repartition(blocks, "block").sortWithinPartitions("block")
    return placed.mapInArrow(run, QUESTIONS)


def by_range(rows: DataFrame, work: Callable[[int, Iterator[tuple]], Iterator[pa.RecordBatch]], schema: str, blocks: int, order: str | None = None) -> DataFrame:
    """work on the rows(range, ...) of each range, given one after the other, by a column's order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (r for b in batches for i in range(0, b.num_rows, ROWS) for r in zip(*(c.to_pylist() for c in b.slice(i, ROWS).columns)))
        for number, part in groupby(each, key=lambda r: r[0]):
            yield from work(number, part)

    placed = rows.select("range", *(c for c in rows.columns if c != "range")).repartition(min(blocks, RANGES), "range")
    return placed.sortWithinPartitions("range", *([order] if order else [])).mapInArrow(run, schema)


def _totals(number: int, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held = Gathered()
    for _, keys, counts in rows:
        held.add(unpack(keys, True), unpack(counts, False).view(np.int64))
    keys, counts = held.done()
    for i in range(0, keys.size, ROW):
        columns = [pa.array([number], pa.int32()), pa.array([pack(keys[i : i + ROW], True)], pa.binary()), pa.array([pack(counts[i : i + ROW], False)], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["range", "keys", "counts"])


def totals(asked: DataFrame, blocks: int) -> DataFrame:
    """(range, keys, counts): the different keys of all blocks and the sums of their counts, some to a row."""
    return by_range(asked.select("range", "keys", "counts"), _totals, "range int, keys binary, counts binary", blocks)


def answers(asked: DataFrame, known: DataFrame, work: Callable[[list[tuple]], Callable[[np.ndarray], bytes | None]], blocks: int, more: DataFrame | None = None) -> DataFrame:
    """(block, range, answer) to asked. work: from a range's rows (keys, counts, *more) of known and more(range, ...), which have nulls for
    each other's columns, makes what answers sorted keys of the range; None is no answer."""
    rest = more.columns[1:] if more is not None else []
    kinds = {f.name: f.dataType for f in more.schema} if more is not None else {}
    none = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    rows = known.select("range", F.lit(-1).alias("block"), "keys", "counts", *(none(c) for c in rest))
    if more is not None:
        rows = rows.unionByName(more.select("range", F.lit(-1).alias("block"), F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("counts"), *rest))
    rows = rows.unionByName(asked.select("range", "block", "keys", F.lit(None).cast("binary").alias("counts"), *(none(c) for c in rest)))

    def run(number: int, part: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held, answer = [], None
        for _, block, *row in part:
            if block < 0:
                held.append(row)
                continue
            if answer is None:
                answer = work(held)
                held = []
            if (said := answer(unpack(row[0], True))) is not None:
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([number], pa.int32()), pa.array([said], pa.binary())], names=["block", "range", "answer"])

    return by_range(rows, run, "block int, range int, answer binary", blocks, "block")


def known_keys(rows: list[tuple]) -> Keys:
    """The keys and totals among a range's rows, sorted."""
    own = [(unpack(k, True), unpack(c, False).view(np.int64)) for k, c, *_ in rows if k is not None]
    own.sort(key=lambda x: int(x[0][0]))
    return np.concatenate([k for k, _ in own] or [np.zeros(0, np.uint64)]), np.concatenate([c for _, c in own] or [np.zeros(0, np.int64)])


def with_answers(docs: DataFrame, answers: DataFrame, work: Callable[[dict[int, bytes], Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, blocks: int) -> DataFrame:
    """work on each block's answers(block, range, answer), by range, and its docs(block, text, ...), which come in batches with a
    null first column and then text and the others."""
    rest = [c for c in docs.columns if c not in ("block", "text")]
    kinds = {f.name: f.dataType for f in docs.schema}
    rows = docs.select("block", F.lit(None).cast("int").alias("_range"), F.lit(None).cast("binary").alias("_answer"), "text", *rest)
    first = answers.select("block", F.col("range").alias("_range"), F.col("answer").alias("_answer"), F.lit(None).cast("string").alias("text"), *(F.lit(None).cast(kinds[c]).alias(c) for c in rest))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = ((block, part) for b in batches for block, part in runs(b, 0))
        ahead = next(parts, None)
        while ahead is not None:
            now, told, texts = ahead[0], {}, []

            def documents(now: int = now, told: dict[int, bytes] = told) -> Iterator[pa.RecordBatch]:
                """The block's documents; answers come before all of them."""
                nonlocal ahead
                while ahead is not None and ahead[0] == now:
                    part = ahead[1]
                    answered = part.column(1).is_valid().to_numpy(zero_copy_only=False)
                    for r, a in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                        if r is not None:
                            told[r] = a
                    if not answered.all():
                        yield pa.RecordBatch.from_arrays(part.columns[2:], names=["_", "text", *rest]).filter(pa.array(~answered))
                    ahead = next(parts, None)

            stream = documents()
            head = next(stream, None)
            if head is not None:
                yield from work(told, _chained(head, stream))

    placed = rows.unionByName(first).repartition(blocks, "block").sortWithinPartitions("block", F.col("_range").asc_nulls_last())
    return placed.mapInArrow(run, schema)


def _chained(head: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield head
    yield from rest
