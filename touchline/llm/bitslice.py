"""Exact top-k inner products over a bit-sliced index.

Vectors become integers, floor(scale * x). A block of the index holds, for each dimension and each bit of the offset
integers, a bitmap over the block's rows. A query's score of all rows of a block is added up from these bitmaps by carry-save
adders, weighing each slice with the bits of the query's integer; a negative one takes the complemented slices, so
everything stays unsigned and a constant is added at the end. The largest rows are selected from the most significant slice
of the sums downward; rows that tie at the boundary are resolved exactly, smaller vec_id first.

The index is a table of blocks as slices: bitmaps, least values, ids. A copy of each block of queries is addressed to each block
of the index, by number, and they meet in an equi-join on it; the pairs of a block follow each other in its task. Each meeting
keeps k rows for each query, and Spark ranks those. Comparing every query with every row is the work that is asked for.

Rows: vectors that are null, empty or hold a null or non-finite component take no part, nor do null vec_ids; only vectors of
equal length meet; a row that repeats a vec_id is a candidate of its own, but never of a query with that vec_id, and a query
vec_id that repeats is asked once, with its largest vector; scores are exact while they fit in 64 bits; other columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Rows of an index block, and queries of a query block.
BLOCK, ASK = 8192, 2048
#: Tasks that the index's blocks are dealt to at most.
TASKS = 10_000


def slices(values: np.ndarray, bits: int) -> np.ndarray:
    """values(rows, dims) >= 0 as bitmaps(dims, bits, words) of 64 rows a word."""
    rows, dims = values.shape
    padded = np.zeros((dims, -(-rows // 64) * 64), np.uint64)
    padded[:, :rows] = values.T
    out = np.empty((dims, bits, padded.shape[1] // 64), np.uint64)
    for b in range(bits):
        out[:, b] = np.packbits(((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view(np.uint64)
    return out


def add_up(levels: dict[int, list[np.ndarray]], words: int) -> np.ndarray:
    """Bitmaps of weight 2^level, summed: the slices of the sums. Three bitmaps of a weight become one of it and one of the
    next by a full adder, all threes of a level at once."""
    out, level = [], 0
    top = max(levels, default=-1)
    while level <= top:
        stack = np.concatenate(levels[level]) if levels.get(level) else np.zeros((0, words), np.uint64)
        carried = []
        while len(stack) > 1:
            n = len(stack) // 3
            if n:
                a, b, c = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
                half = a ^ b
                carried.append((a & b) | (half & c))
                stack = np.concatenate([half ^ c, stack[3 * n :]])
            else:
                a, b = stack[:1], stack[1:2]
                carried.append(a & b)
                stack = a ^ b
        out.append(stack[0] if len(stack) else np.zeros(words, np.uint64))
        if carried:
            levels.setdefault(level + 1, []).extend(carried)
            top = max(top, level + 1)
        level += 1
    return np.array(out).reshape(-1, words)


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def select_top(sums: np.ndarray, live: np.ndarray, k: int) -> np.ndarray:
    """Rows that may be among the k largest sums: all surely in, and all that tie at the boundary."""
    sure, tied = np.zeros_like(live), live.copy()
    for s in sums[::-1]:
        more = tied & s
        n = _count(sure) + _count(more)
        if n >= k:
            tied = more
        else:
            sure |= more
            tied &= ~s
    both = sure | tied
    return np.flatnonzero(np.unpackbits(both.view(np.uint8), bitorder="little"))


class Block:
    """One block of the index: its ids, each dimension's least value, and the slices of what is above it."""

    def __init__(self, ids: np.ndarray, low: np.ndarray, maps: np.ndarray) -> None:
        self.ids, self.low, self.maps = ids, low, maps
        self.bits, self.words = maps.shape[1:]
        self.full = (1 << self.bits) - 1
        self.live = np.packbits(np.arange(self.words * 64) < len(ids), bitorder="little").view(np.uint64)

    @classmethod
    def of(cls, ids: np.ndarray, values: np.ndarray) -> Block:
        low = values.min(axis=0)
        span = values - low
        return cls(ids, low, slices(span, max(1, int(span.max(initial=0)).bit_length())))

    def packed(self) -> tuple[bytes, bytes, bytes, int]:
        return self.ids.tobytes(), self.low.tobytes(), self.maps.tobytes(), self.bits

    @classmethod
    def unpacked(cls, ids: bytes, low: bytes, maps: bytes, bits: int) -> Block:
        held = np.frombuffer(low, np.int64)
        return cls(np.frombuffer(ids, np.int64), held, np.frombuffer(maps, np.uint64).reshape(held.size, bits, -1))

    def top(self, query_id: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(vec_id, score) of the k largest inner products with q, ties to smaller vec_ids, the query's own row aside."""
        size = np.abs(q)
        levels: dict[int, list[np.ndarray]] = {}
        for j in range(int(size.max(initial=0)).bit_length()):
            on = np.flatnonzero((size >> j) & 1)
            if on.size:
                flip = np.where(q[on] < 0, ~np.uint64(0), np.uint64(0))[:, None]
                for b in range(self.bits):
                    levels.setdefault(j + b, []).append(self.maps[on, b] ^ flip)
        sums = add_up(levels, self.words)
        live = self.live.copy()
        for own in np.flatnonzero(self.ids == query_id).tolist():
            live[own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
        rows = select_top(sums, live, k)
        word, shift = rows // 64, (rows % 64).astype(np.uint64)
        got = np.zeros(rows.size, np.int64)
        for level, s in enumerate(sums):
            got += ((s[word] >> shift) & np.uint64(1)).astype(np.int64) << level
        # |q| (full - c) stands for q c where q < 0
        score = got + int((q * self.low).sum()) - int(size[q < 0].sum()) * self.full
        order = np.lexsort([self.ids[rows], -score])[:k]
        return list(zip(self.ids[rows][order].tolist(), score[order].tolist()))


def integers(vectors: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, dims, values): vectors that take part, as integers."""
    x = F.col(vec_col)
    good = F.col(id_col).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.size(x).alias("dims"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("values"))


def _dealt(rows: DataFrame, size: int, tag: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the number of a block of about size rows, and (dims, blocks). Blocks are dealt by a hash of the id, so how many
    there are depends on the row count alone."""
    counts = written(rows.groupBy("dims").agg(F.greatest(F.ceil(F.count("*") / size), F.lit(1)).cast("int").alias("blocks")), f"{tag}-counts")
    # a row for each length of vectors
    return rows.join(counts, "dims").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), counts


def _values(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    pdf = pdf.sort_values("id", kind="stable")
    return pdf["id"].to_numpy(np.int64), np.stack(pdf["values"].tolist()).astype(np.int64)


def build(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index of candidates(id, dims, values), a row (dims, block, ids, low, maps, bits) a block, and (dims, blocks)."""
    dealt, counts = _dealt(candidates, BLOCK, "slices")

    def gather(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, low, maps, bits = Block.of(*_values(pdf)).packed()
        return pd.DataFrame({"dims": [key[0]], "block": [key[1]], "ids": [ids], "low": [low], "maps": [maps], "bits": [bits]})

    return written(dealt.groupBy("dims", "block").applyInPandas(gather, "dims int, block int, ids binary, low binary, maps binary, bits int"), "slices"), counts


def search(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """candidates and queries(id, dims, values) as query_id, rank, vec_id, score."""
    index, counts = build(candidates)
    asked, _ = _dealt(queries.groupBy("id", "dims").agg(F.max("values").alias("values")), ASK, "asked")

    def gather(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, values = _values(pdf)
        return pd.DataFrame({"dims": [key[0]], "q_ids": [ids.tobytes()], "q_rows": [values.tobytes()]})

    ask = written(asked.groupBy("dims", "block").applyInPandas(gather, "dims int, q_ids binary, q_rows binary"), "asked")
    sent = ask.join(counts, "dims").select("dims", "q_ids", "q_rows", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    # blocks are few and dear, so each is a task's own as far as possible; the join keeps the pairs of a block together
    tasks = max(1, min(TASKS, counts.agg(F.sum("blocks")).first()[0] or 0))
    met = index.repartition(tasks, "dims", "block").join(sent, ["dims", "block"])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, block = None, None
        for pdf in batches:
            for dims, number, ids, low, maps, bits, q_ids, q_rows in pdf[["dims", "block", "ids", "low", "maps", "bits", "q_ids", "q_rows"]].itertuples(index=False):
                if now != (dims, number):
                    now, block = (dims, number), Block.unpacked(ids, low, maps, bits)
                out = [(q, v, s) for q, x in zip(np.frombuffer(q_ids, np.int64).tolist(), np.frombuffer(q_rows, np.int64).reshape(-1, dims)) for v, s in block.top(q, x, k)]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype(np.int64)

    best = met.mapInPandas(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.select("query_id", F.row_number().over(order).cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the 5 best rows for each vec_id divisible by 50."""
    rows = written(integers(table(spark, sf_dir, "embeddings"), 256, "vec_id", "embedding"), "vectors")
    return search(rows, rows.where("id % 50 = 0"), 5)


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
           FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
