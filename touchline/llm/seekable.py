"""Token ids in independent zstandard frames with a trailing seek table.

A shard is a run of documents in ascending doc_id order: frames of whole documents (one longer than a frame fills several of
its own), then the seek table of zstandard's public seekable format, a skippable frame with each frame's compressed size,
size and checksum (low 32 bits of XXH64 of its content). Any zstandard tool can decompress a shard; a reader that wants some
documents decompresses only their frames. Shards are rows of a Parquet table beside their documents' ids and lengths, so
Spark's commit protocol guards the files: a lost executor's task is written again, and no half file is ever read.

Rows: a null text counts as empty, an empty text has only the end id; texts of any length are kept whole; null doc_ids come
first; repeated doc_ids are separate documents, ordered by their text; other columns are not read; an empty table gives no
rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import library_encoder
from .common import scratch_path, table

#: Ids in a frame, and in a shard, before the next is begun.
FRAME, SHARD = 1 << 16, 1 << 22
#: Fixed values of the public seekable format.
SKIPPABLE, SEEKABLE, CHECKED = 0x184D2A5E, 0x8F92EAB1, 0x80

SCHEMA = "part int, seq int, n_ids long, width int, doc_ids array<long>, lengths array<long>, shard binary"
_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("shard", pa.binary())])


class ShardWriter:
    def __init__(self, width: int) -> None:
        self.kind = np.dtype(f"<u{width}")
        self.frames: list[bytes] = []
        self.table: list[bytes] = []
        self.open: list[np.ndarray] = []
        self.held = self.n_ids = 0
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self.zstd = zstandard.ZstdCompressor(level=1, write_checksum=True)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(ids.size)
        self.n_ids += ids.size
        if self.held and self.held + ids.size > FRAME:
            self._close()
        for a in range(0, ids.size, FRAME):
            self.open.append(ids[a : a + FRAME])
            self.held += self.open[-1].size
            if self.held >= FRAME:
                self._close()

    def _close(self) -> None:
        raw = np.concatenate(self.open).astype(self.kind).tobytes()
        frame = self.zstd.compress(raw)
        self.frames.append(frame)
        self.table.append(struct.pack("<III", len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.open, self.held = [], 0

    def finish(self) -> bytes:
        if self.held:
            self._close()
        body = b"".join(self.table) + struct.pack("<IBI", len(self.table), CHECKED, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(body)) + body


class ShardReader:
    """Random access to a shard; only frames that are asked for are decompressed and checked."""

    def __init__(self, shard: bytes, width: int) -> None:
        n, flags, magic = struct.unpack("<IBI", shard[-9:])
        if magic != SEEKABLE or flags != CHECKED:
            raise ValueError("not a shard with a checked seek table")
        entries = np.frombuffer(shard, "<u4", 3 * n, len(shard) - 9 - 12 * n).reshape(n, 3).astype(np.int64)
        self.shard, self.kind, self.check = shard, np.dtype(f"<u{width}"), entries[:, 2]
        self.at = np.concatenate([[0], np.cumsum(entries[:, 0])])
        self.first = np.concatenate([[0], np.cumsum(entries[:, 1] // width)])
        self.zstd = zstandard.ZstdDecompressor()
        self.last: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))

    def frame(self, k: int) -> np.ndarray:
        if self.last[0] != k:
            raw = self.zstd.decompress(self.shard[self.at[k] : self.at[k + 1]])
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.check[k]:
                raise ValueError(f"frame {k} fails its checksum")
            self.last = k, np.frombuffer(raw, self.kind)
        return self.last[1]

    def read(self, start: int, n: int) -> np.ndarray:
        """The n ids from start on."""
        out, k = [], int(np.searchsorted(self.first, start, side="right")) - 1
        while n > 0:
            got = self.frame(k)[start - self.first[k] :][:n]
            out.append(got)
            start, n, k = start + got.size, n - got.size, k + 1
        return np.concatenate(out) if out else np.zeros(0, self.kind)


def write(docs: DataFrame, path: str, vocab: str, end_id: int, vocab_size: int, byte_level: bool = True) -> None:
    """Encodes docs(doc_id, text) with the tokenizers library and writes shards, in ascending doc_id order, to path."""
    width = 2 if max(vocab_size, end_id + 1) <= 1 << 16 else 4

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq, out = library_encoder(vocab, byte_level), TaskContext.get().partitionId(), 0, ShardWriter(width)
        end = np.array([end_id], np.uint32)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, seq, out.n_ids, width, out.doc_ids, out.lengths, out.finish()), _ARROW)], schema=_ARROW)

        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode_many(b.column(1))):
                out.add(doc_id, np.concatenate([ids, end]))
                if out.n_ids >= SHARD:
                    yield row()
                    seq, out = seq + 1, ShardWriter(width)
        if out.doc_ids:
            yield row()

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    thin.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, SCHEMA).write.parquet(path)


def directory(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, doc_id, local, n_tokens, start): where each document lies; reads no frame."""
    shards = spark.read.schema(SCHEMA).parquet(path).select("part", "seq", "n_ids", "doc_ids", "lengths")
    # one row a shard of some 16 MB; their running sum is small work
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    before = shards.select("part", "seq", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("_before"))
    docs = shards.select("part", "seq", F.posexplode(F.arrays_zip("doc_ids", "lengths")).alias("_at", "_d"))
    run = Window.partitionBy("part", "seq").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.select("part", "seq", F.col("_d.doc_ids").alias("doc_id"), F.coalesce(F.sum("_d.lengths").over(run), F.lit(0)).alias("local"), F.col("_d.lengths").alias("n_tokens"))
    return docs.join(before, ["part", "seq"]).select("part", "seq", "doc_id", "local", "n_tokens", (F.col("_before") + F.col("local")).alias("start"))


def read_documents(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents of wanted(doc_id); other documents' frames stay compressed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, width, docs in zip(*(b.column(i).to_pylist() for i in range(3))):
                r = ShardReader(shard, width)
                got = [(d["doc_id"], r.read(d["local"], d["n_tokens"]).astype("<u4").tobytes()) for d in sorted(docs, key=lambda d: d["local"])]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([x for _, x in got], pa.binary())], names=["doc_id", "ids"])

    # a list holds at most the documents of one shard, which is bounded by SHARD
    asked = directory(spark, path).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("part", "seq").agg(F.collect_list(F.struct("doc_id", "local", "n_tokens")).alias("docs"))
    shards = spark.read.schema(SCHEMA).parquet(path).select("part", "seq", "shard", "width")
    return shards.join(asked, ["part", "seq"]).select("shard", "width", "docs").mapInArrow(run, "doc_id long, ids binary")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Reads every shard back, frame by frame: (doc_id, start, n_tokens, ids_crc32)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("part", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
        for b in batches:
            for part, seq, width, doc_ids, lengths, shard in zip(*(b.column(i).to_pylist() for i in range(6))):
                r, at, rows = ShardReader(shard, width), 0, []
                for d, n in zip(doc_ids, lengths):
                    rows.append((part, seq, d, at, n, zlib.crc32(r.read(at, n).astype("<u4").tobytes())))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])

    shards = spark.read.schema(SCHEMA).parquet(path)
    docs = shards.select("part", "seq", "width", "doc_ids", "lengths", "shard").mapInArrow(run, "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long")
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    before = shards.select("part", "seq", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("_before"))
    return docs.join(before, ["part", "seq"]).select("doc_id", (F.col("_before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every document written as shards and read back."""
    path = scratch_path(spark, "shards")
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, vocab_size=50257)
    return digests(spark, path)
