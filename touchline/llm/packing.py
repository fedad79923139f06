"""Packing along a space-filling curve.

Each document's token ids are hashed to a vector, projected to four dimensions and given a Hilbert key, so that documents
near each other on the curve are alike. Documents are range-sorted by the key and laid end to end along the curve; the line
is cut into sequences of max_tokens, so only its tail is short, and the tail is cut into powers of two, which need no padding.

The ids are written once; only narrow rows (a key and a length each) are range-sorted and summed. A document's place on the
line follows from its range's total and its own running sum, then its ids are cut where they are.

Rows: a null text counts as empty, an empty text is the end id alone; long texts span sequences; a document of no known id
(null doc_id) is packed too, with doc_id null; repeated rows are packed once each; equal keys are ordered by doc_id; other
columns are not read; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import library_encoder
from .common import table, written

#: Buckets of a hashed document vector, dimensions of the curve, and bits of each.
BUCKETS, DIMS, BITS = 256, 4, 15

_rng = np.random.default_rng(7919)
_PROJECT = _rng.standard_normal((BUCKETS, DIMS))
_SIGN_SALT, _BUCKET_SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def document_vector(ids: np.ndarray) -> np.ndarray:
    """Signed, log-damped counts of ids hashed to buckets, projected; length 1 before the projection."""
    x = ids.astype(np.uint64)
    bucket = ((x * _BUCKET_SALT) >> np.uint64(48)).astype(np.int64) % BUCKETS
    sign = np.where((x * _SIGN_SALT) >> np.uint64(63), 1.0, -1.0)
    v = np.bincount(bucket, sign, BUCKETS)
    v = np.sign(v) * np.log1p(np.abs(v))
    return (v / max(np.linalg.norm(v), 1e-12)) @ _PROJECT


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer points (a row each): Skilling's transform, for all points at once."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(vectors: np.ndarray) -> np.ndarray:
    """Keys of projected vectors; coordinates are squashed evenly onto the grid."""
    grid = np.clip((np.tanh(vectors) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert_keys(grid.astype(np.int64))


def tail_cuts(total: int, max_tokens: int) -> list[int]:
    """Ends of the tail's sequences: powers of two, largest first."""
    at, left, ends = total - total % max_tokens, total % max_tokens, []
    for b in range(left.bit_length() - 1, -1, -1):
        if left >> b & 1:
            at += 1 << b
            ends.append(at)
    return ends


def pack(docs: DataFrame, vocab: str, end_id: int, max_tokens: int = 2048, byte_level: bool = False, keep_ids: bool = True) -> DataFrame:
    """docs(doc_id, text) as pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with keep_ids the
    piece's ids (little-endian unsigned 32-bit integers)."""
    spark = docs.sparkSession

    def tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, at = library_encoder(vocab, byte_level), TaskContext.get().partitionId() << 33
        end = np.array([end_id], np.uint32)
        for b in batches:
            raw, size, vectors = [], [], []
            for ids in enc.encode_many(b.column(1)):
                ids = np.concatenate([ids, end])
                raw.append(ids.astype("<u2" if ids.max() < 1 << 16 else "<u4").tobytes())
                size.append(ids.size)
                vectors.append(document_vector(ids))
            keys = curve_keys(np.array(vectors).reshape(-1, DIMS))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(size))), b.column(0), pa.array(size, pa.int64()), pa.array(keys), pa.array(raw, pa.binary())], names=["uid", "doc_id", "n", "key", "ids"])
            at += len(size)

    held = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(tokens, "uid long, doc_id long, n long, key long, ids binary"), "tokens")
    line = held.select("uid", "doc_id", "n", "key").repartitionByRange("key", "doc_id", "uid").sortWithinPartitions("key", "doc_id", "uid")

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column(1).to_numpy()
            local = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(len(n), part, np.int32)), pa.array(local)], names=["uid", "n", "part", "local"])

    line = written(line.select("uid", "n").mapInArrow(places, "uid long, n long, part int, local long"), "line")
    # a row for each range, as many as there are shuffle partitions
    totals = line.groupBy("part").agg(F.sum("n").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    whole, ends = total - total % max_tokens, np.array(tail_cuts(total, max_tokens), np.int64)
    place = line.join(F.broadcast(totals.select("part", "before")), "part").select("uid", (F.col("before") + F.col("local")).alias("place"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else [])]
        for b in batches:
            rows = []
            for doc_id, n, raw, at in zip(*(b.column(i).to_pylist() for i in range(4))):
                wide = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes()
                start = 0
                while start < n:
                    g = at + start
                    if g < whole:
                        seq, offset = divmod(g, max_tokens)
                        stop = g - offset + max_tokens
                    else:
                        k = int(np.searchsorted(ends, g, side="right"))
                        seq, offset, stop = whole // max_tokens + k, g - (int(ends[k - 1]) if k else whole), int(ends[k])
                    length = min(n - start, stop - g)
                    ids = wide[4 * start : 4 * (start + length)]
                    rows.append((doc_id, start, length, zlib.crc32(ids), n, seq, offset, *((ids,) if keep_ids else ())))
                    start += length
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if c == "ids" else pa.int64()) for x, c in zip(cols, names)], names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if keep_ids else "")
    return held.select("uid", "doc_id", "n", "ids").join(place, "uid").select("doc_id", "n", "ids", "place").mapInArrow(cut, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document packed into sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, keep_ids=False)
