"""Byte-pair encoding by speculating and verifying, and decoding.

For each pre-token, greedy longest match proposes tokens. The proposal is what exact merging gives just when each of its
tokens is built by its own merges and no merge would cross the boundary of any adjacent pair, which one vectorised check
tests for all pairs at once. Only pre-tokens that fail go through exact merging.

Rows: a null text counts as empty; an empty text has no ids; texts of any length are encoded whole; repeated rows and
null doc_ids give a row each; other columns of the input are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import TextEncoder, byte_level_pieces
from .common import table

FAR = np.int64(2**62)


def _byte_letters() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairCodec:
    """A byte-level BPE vocabulary file, without the library that it was made for."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        n = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * n
        for s, i in vocab.items():
            if s not in self.special:
                self.bytes_of[i] = raw(s)
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right = np.full(n, -1), np.full(n, -1)
        rank = np.full(n, -1, np.int64)
        times = np.zeros(n, int)
        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (x, y) in enumerate(merges):
            a, b, c = vocab[x], vocab[y], vocab[x + y]
            pairs[a, b] = (r, c)
            left[c], right[c], rank[c] = a, b, r
            times[c] += 1
        self.n, self.pairs, self.left, self.right, self.rank = n, pairs, left, right, rank
        self.byte_id = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        keys = np.array([a * n + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in pairs.values()], np.int64)[order]
        # tokens that exact merging of their own bytes gives: from the first merge on, so that the halves are known
        sound = np.zeros(n, bool)
        sound[self.byte_id] = True
        made = np.array([vocab[x + y] for x, y in merges])
        alone = self.joins(left[made], right[made], rank[made], rank[made])
        for c, ok in zip(made.tolist(), alone.tolist()):
            sound[c] = ok and times[c] == 1 and sound[left[c]] and sound[right[c]]
        self.tokens = {self.bytes_of[i]: i for i in np.flatnonzero(sound).tolist()}
        self.longest = max(map(len, self.tokens))

    def joins(self, a: np.ndarray, b: np.ndarray, until_a: np.ndarray | int = FAR, until_b: np.ndarray | int = FAR) -> np.ndarray:
        """Whether tokens a and b can stand side by side: no merge across their boundary comes before those inside.

        Going back in time from the finished pair, the younger of the two tokens at the boundary is undone; each pair that
        stood there is looked up. It would have merged if its merge came before the merges that consumed its left token,
        and not after those that consumed its right one (of equal merges the left one is first).
        """
        x, y = np.array(a, np.int64), np.array(b, np.int64)
        ux, uy = np.broadcast_to(until_a, x.shape).astype(np.int64), np.broadcast_to(until_b, y.shape).astype(np.int64)
        ok, live = np.ones(x.shape, bool), np.arange(x.size)
        while live.size:
            xs, ys = x[live], y[live]
            key = xs * self.n + ys
            at = np.minimum(np.searchsorted(self.pair_keys, key), self.pair_keys.size - 1)
            r = np.where(self.pair_keys[at] == key, self.pair_ranks[at], FAR)
            crossed = (r < ux[live]) & (r <= uy[live]) & (r < FAR)
            ok[live[crossed]] = False
            rx, ry = self.rank[xs], self.rank[ys]
            go_x, go_y = ~crossed & (rx > ry), ~crossed & (rx <= ry) & (ry >= 0)
            i, j = live[go_x], live[go_y]
            ux[i], x[i] = rx[go_x], self.right[xs[go_x]]
            uy[j], y[j] = ry[go_y], self.left[ys[go_y]]
            live = live[go_x | go_y]
        return ok

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, i, end, get = [], 0, len(word), self.tokens.get
        while i < end:
            for j in range(min(end, i + self.longest), i, -1):
                if (t := get(word[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the earliest merge, of equal ones the leftmost; linear memory, n log n steps."""
        ids = [self.byte_id[c] for c in word]
        n = len(ids)
        after, before, pairs = list(range(1, n + 1)), list(range(-1, n - 1)), self.pairs
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := pairs.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = pairs[a, b][1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := pairs.get((ids[i], ids[k])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (m := pairs.get((ids[h], ids[i]))):
                heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
        return [t for t in ids if t >= 0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        out = [self.propose(w) for w in words]
        size = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter((t for ts in out for t in ts), np.int64, int(size.sum()))
        word = np.repeat(np.arange(len(out)), size)
        inside = word[1:] == word[:-1] if flat.size else np.zeros(0, bool)
        a, b = flat[:-1][inside], flat[1:][inside]
        if a.size:
            pair, back = np.unique(a * self.n + b, return_inverse=True)
            bad = ~self.joins(pair // self.n, pair % self.n)[back]
            for i in np.unique(word[1:][inside][bad]).tolist():
                out[i] = self.merge(words[i])
        return out

    def encode_strings(self, strings: list[str], whole: bool = False) -> list[np.ndarray]:
        """Ids of strings; whole: special tokens' strings in them are those tokens."""
        cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special and whole else None
        words: dict[bytes, int] = {}
        plan: list[list[tuple[int, int]]] = []
        put = words.setdefault
        for s in strings:
            steps, at = [], 0
            for m in cut.finditer(s) if cut else ():
                steps += [(put(w.encode(), len(words)), -1) for w in byte_level_pieces(s[at : m.start()])] + [(-1, self.special[m[0]])]
                at = m.end()
            plan.append(steps + [(put(w.encode(), len(words)), -1) for w in byte_level_pieces(s[at:] if at else s)])
        ids = self.encode_words(list(words))
        return [np.array([t for w, sp in steps for t in (ids[w] if w >= 0 else (sp,))], np.uint32) for steps in plan]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; bytes that are not UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> BytePairCodec:
    return BytePairCodec(path)


@lru_cache(maxsize=2)
def text_encoder(path: str) -> TextEncoder:
    c = codec(path)
    return TextEncoder(c.encode_strings, c.special)


def encode(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """(id_col, n_tokens, SHA-256 digests of the ids as little-endian unsigned 32-bit integers and of their decoded text;
    with keep also ids and decoded themselves). Runs where the text is; nothing is shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, c = text_encoder(vocab), codec(vocab)
        for b in batches:
            rows = []
            for ids in enc.encode_many(b.column(1)):
                raw, text = ids.astype("<u4").tobytes(), c.decode(ids).encode()
                rows.append((ids.size, hashlib.sha256(raw).hexdigest(), hashlib.sha256(text).hexdigest(), *((raw, text.decode()) if keep else ())))
            cols = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip(cols, kinds.values()))], names=[id_col, *kinds])

    kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} | ({"ids": pa.binary(), "decoded": pa.string()} if keep else {})
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if keep else "")
    return docs.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every document encoded and decoded."""
    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=False)
