import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from tokenizers import Tokenizer

from touchline.llm import bpe, packing, seekable
from touchline.llm.chunks import library_encoder
from touchline.llm.common import scratch_path

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def _ids(path, texts):
    tok = Tokenizer.from_file(path)
    return [np.array(e.ids, np.uint32) for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path,byte_level", [(BYTE, True), (WORD, False)])
def test_chunks_give_what_the_library_gives(corpus, path, byte_level):
    texts = [r[1] for r in corpus]
    odd = ["a  b\n\n c", " lead", "trail ", "\r\nx\ty \t z", "q  w", "a   y", "x \ny", "é ́x İ ΣΑΣ É'S x'S", "\x1c\x85 a", "foo\n", "\n", "."]
    got = list(library_encoder(path, byte_level).encode_many(pa.array(texts + odd)))
    assert all(np.array_equal(a, b) for a, b in zip(got, _ids(path, texts + odd), strict=True))


def test_bpe_is_exact(docs, corpus, nothing):
    texts = [r[1] for r in corpus]
    rows = bpe.encode(docs, BYTE).collect()
    tok = Tokenizer.from_file(BYTE)
    want = sorted((str(r[0]), i.size, hashlib.sha256(i.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(i.tolist(), skip_special_tokens=False).encode()).hexdigest()) for r, i in zip(corpus, _ids(BYTE, texts)))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == want
    assert bpe.encode(nothing, BYTE).isEmpty()


def test_bpe_speculation_is_verified():
    c = bpe.codec(BYTE)
    words = [w.encode() for w in (" thonener", "aaaa", "x" * 200, " indistinguishable", "réeuxment", "0" * 50)]
    assert c.encode_words(words) == [c.merge(w) for w in words]
    assert c.decode(np.array([c.byte_id[0xFF], c.byte_id[65]])) == "�A"


def test_packing_places_every_id_once(docs, corpus, nothing):
    pieces = packing.pack(docs, WORD, end_id=1, max_tokens=64).toPandas()
    want = sorted(zlib.crc32(np.append(i, 1).astype("<u4").tobytes()) for i in _ids(WORD, [r[1] for r in corpus]))
    assert (pieces["length"] > 0).all() and (pieces.groupby("sequence_id")["length"].sum() <= 64).all()
    for _, s in pieces.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (s["offset"] == s["length"].cumsum() - s["length"]).all()
    full = pieces.groupby("sequence_id")["length"].sum()
    assert all(n == 64 or n & (n - 1) == 0 for n in full)
    one = pieces[pieces["doc_id"].notna()].sort_values("start").drop_duplicates(["doc_id", "start", "length", "sequence_id", "offset"])
    joined = sorted(zlib.crc32(b"".join(g["ids"])) for d, g in one.groupby("doc_id") if g["length"].sum() == g["doc_tokens"].iloc[0])
    assert set(joined) <= set(want) and len(joined) > 70
    assert int(pieces["length"].sum()) == sum(i.size + 1 for i in _ids(WORD, [r[1] for r in corpus]))
    assert packing.pack(nothing, WORD, end_id=1).isEmpty()


def test_hilbert_neighbours_touch():
    grid = np.array([(x, y) for x in range(16) for y in range(16)])
    path = grid[np.argsort(packing.hilbert_keys(grid, 4))]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shards_round_trip(spark, docs, corpus, nothing):
    path = scratch_path(spark, "test")
    seekable.write(docs, path, BYTE, end_id=2, vocab_size=50257)
    got = seekable.digests(spark, path).orderBy("start").collect()
    order = sorted(range(len(corpus)), key=lambda i: (corpus[i][0] is not None, corpus[i][0] or 0, corpus[i][1] is not None, (corpus[i][1] or "").encode()))
    ids = _ids(BYTE, [r[1] for r in corpus])
    at = 0
    for r, i in zip(got, order, strict=True):
        x = np.append(ids[i], 2)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (corpus[i][0], at, x.size, zlib.crc32(x.astype("<u4").tobytes()))
        at += x.size
    some = {r["doc_id"]: r["ids"] for r in seekable.read_documents(spark, path, spark.createDataFrame([(77,), (3,)], "doc_id long")).collect()}
    assert {k: zlib.crc32(v) for k, v in some.items()} == {r["doc_id"]: r["ids_crc32"] for r in got if r["doc_id"] in (3, 77)}
    empty = scratch_path(spark, "test")
    seekable.write(nothing, empty, BYTE, end_id=2, vocab_size=50257)
    assert seekable.digests(spark, empty).isEmpty()


def test_shards_are_plain_zstandard_and_checked():
    w = seekable.ShardWriter(2)
    ids = np.arange(150_000) % 50_000
    w.add(1, ids[:10])
    w.add(2, ids)
    shard = w.finish()
    r = seekable.ShardReader(shard, 2)
    assert np.array_equal(r.read(10, ids.size), ids) and np.array_equal(r.read(3, 4), ids[3:7])
    raw = zstandard.ZstdDecompressor().stream_reader(shard, read_across_frames=True).read()
    assert np.array_equal(np.frombuffer(raw, "<u2"), np.concatenate([ids[:10], ids]))
    broken = bytearray(shard)
    broken[len(shard) - 9 - 12 * len(w.table) + 8] ^= 1
    with pytest.raises(ValueError):
        seekable.ShardReader(bytes(broken), 2).read(0, 5)
