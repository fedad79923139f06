"""Spelling variants: words at one edit from each other, by a self-join of the vocabulary's trie with active nodes.

The vocabulary is a trie that is cut into parts: a part holds the words below one prefix, and a prefix with more than PART words
is cut again further down. Within a part, tasks go down the trie from its root, whose only active node is itself. Where a node
branches, each pair of its children becomes active for one another at distance one (a letter replaced), and each child for its
parent (a letter inserted). From a pair at distance one only equal letters lead on, to pairs of children, until both nodes end
words: a terminal pair.

Nodes of different parts are at distance one only if the edit lies in the letters that lead to them, so from there on the rest
of both words is the same. Such pairs are propagated by joins instead of going down two parts: each word is known by itself with
one of those letters left open, and by itself without it. At most as many words as there are letters meet in one key.

Words are counted in the tasks before they are shuffled. Tables that grow with the vocabulary meet by shuffles only (`sorted_join`):
their files are small for their rows, more so where words are spread over their letters, so Spark would take them for tables to
broadcast. The graph of pairs is reduced to a row a word by partial aggregates,
and roots are found by pointer doubling, as a form is at least twice as frequent as its word.

Rows: a null or empty text has no words; texts and runs of any length are used whole; repeated rows count each; a null doc_id
counts as an empty one in the hash that plants misspellings; ties go by the smallest word in code-point order; other columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import span_hashes, text_bytes
from .common import table, written

#: Words of a part of the trie; bytes of texts that are counted together, if a text isn't longer.
PART, WINDOW = 4096, 2_000_000
#: Code points of a word and its occurrences, at least; how much more frequent its form is.
LETTERS, TIMES, MORE = 5, 3, 2

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ASCII = np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_CRC = _crc_table()


def _runs(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of Latin letters start and stop. U+00C0 to U+00FF are the byte 0xC3 and a byte of 0x80 to 0xBF."""
    lead = data == 0xC3
    inside = _ASCII[data] | lead
    inside[1:] |= lead[:-1]
    edge = np.zeros(data.size + 1, bool)
    edge[begin] = True
    starts = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1])) if data.size else np.zeros(0, np.int64)
    stops = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])) + 1 if data.size else starts
    return starts, stops


def _crc(data: np.ndarray, starts: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """crc32 of each span, going on from a seed; a byte of all spans at a time."""
    order = np.argsort(-size, kind="stable")
    state = (seed ^ np.uint32(0xFFFFFFFF))[order]
    at, left = starts[order], size[order]
    live = state.size
    for k in range(int(min(left[0], 64)) if live else 0):
        live = int(np.searchsorted(-left, -k, side="left"))
        state[:live] = _CRC[(state[:live] ^ data[at[:live] + k]) & np.uint32(255)] ^ (state[:live] >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for i in order[: int(np.searchsorted(-left, -64, side="left"))].tolist():  # the few long runs
        out[i] = zlib.crc32(data[starts[i] : starts[i] + size[i]].tobytes(), int(seed[i]))
    return out


def word_counts(ids: list[int | None], data: np.ndarray, begin: np.ndarray, every: int) -> tuple[list[str], np.ndarray]:
    """Words of whole texts and their occurrences. Of a run whose hash with its text's id is a multiple of `every`, a letter is
    left out, chosen by that hash."""
    data = _LOWER[data]
    starts, stops = _runs(data, begin)
    size = stops - starts
    seeds = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    owner = np.searchsorted(begin, starts, side="right") - 1
    h = _crc(data, starts, size, seeds[owner])
    hit = h % np.uint32(every) == 0
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    letters = heads[stops] - heads[starts]
    cut: dict[str, int] = {}
    raw = data.tobytes()
    for a, b, x in zip(starts[hit].tolist(), stops[hit].tolist(), h[hit].tolist()):
        word = raw[a:b].decode()
        if len(word) > LETTERS:
            k = x % len(word)
            word = word[:k] + word[k + 1 :]
            cut[word] = cut.get(word, 0) + 1
    plain = ~hit & (letters >= LETTERS)
    starts, stops = starts[plain], stops[plain]
    _, first, times = np.unique(span_hashes(data, starts, stops), return_index=True, return_counts=True)
    words = [raw[a:b].decode() for a, b in zip(starts[first].tolist(), stops[first].tolist())]
    return words + list(cut), np.concatenate([times, np.fromiter(cut.values(), np.int64, len(cut))])


def vocabulary(docs: DataFrame, every: int = 97) -> DataFrame:
    """docs(doc_id, text) as (word, n): words of LETTERS code points at least that occur TIMES at least."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, begin = text_bytes(b.column(1))
            ids, i, n = b.column(0).to_pylist(), 0, begin.size - 1
            while i < n:
                j = max(i + 1, int(np.searchsorted(begin, begin[i] + WINDOW, side="right")) - 1)
                words, times = word_counts(ids[i:j], data[begin[i] : begin[j]], begin[i : j + 1] - begin[i], every)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(times, pa.int64())], names=["word", "n"])
                i = j

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TIMES)


def parts(words: DataFrame) -> DataFrame:
    """words(word, n) with cut, the code points of the prefix whose part a word is in. A prefix with more than PART words is cut
    twice as far down, until none is left."""
    done, rest, depth = None, words.withColumn("cut", F.lit(0)), 2
    while True:
        prefix = F.substring("word", 1, depth).alias("_p")
        heavy = rest.groupBy(prefix).agg(F.count("*").alias("_k")).where(F.col("_k") > PART)
        told = written(rest.withColumn("_p", prefix).join(heavy, "_p", "left").select("word", "n", F.lit(depth).alias("cut"), F.col("_k").isNotNull().alias("_more")), "trie")
        here = told.where("not _more").select("word", "n", "cut")
        done = here if done is None else done.unionByName(here)
        rest = told.where("_more").select("word", "n", "cut")
        if rest.isEmpty():
            return done.select("word", "n", F.least("cut", F.length("word")).alias("cut"))
        depth *= 2


def terminal_pairs(words: list[str], depth: int) -> Iterator[tuple[int, int]]:
    """Numbers of words at one edit from each other, each pair once. words: sorted, different, with a common prefix of so many
    letters. A node is a range of words and a depth."""

    def kids(lo: int, hi: int, k: int) -> list[tuple[str, int, int]]:
        lo += len(words[lo]) == k
        out = []
        while lo < hi:
            c = words[lo][k]
            end = lo + 1 if hi - lo == 1 else bisect_right(words, c, lo, hi, key=lambda w: w[k])
            out.append((c, lo, end))
            lo = end
        return out

    def matched(a: tuple[int, int, int], b: tuple[int, int, int]) -> Iterator[tuple[int, int]]:
        """Terminal pairs below two active nodes at distance one: equal letters only."""
        todo = [(a, b)]
        while todo:
            (lo, hi, k), (low, high, m) = todo.pop()
            if hi - lo == 1 or high - low == 1:
                one, other, turned = ((lo, k), (low, high, m), False) if hi - lo == 1 else ((low, m), (lo, hi, k), True)
                want = words[other[0]][: other[2]] + words[one[0]][one[1] :]
                at = bisect_left(words, want, other[0], other[1])
                if at < other[1] and words[at] == want:
                    yield (at, one[0]) if turned else (one[0], at)
                continue
            if len(words[lo]) == k and len(words[low]) == m:
                yield lo, low
            there = {c: (x, y) for c, x, y in kids(low, high, m)}
            todo += [((x, y, k + 1), (*there[c], m + 1)) for c, x, y in kids(lo, hi, k) if c in there]

    nodes = [(0, len(words), depth)] if len(words) > 1 else []
    while nodes:
        lo, hi, k = nodes.pop()
        # the next node that branches
        first, last = words[lo], words[hi - 1]
        while k < len(first) and k < len(last) and first[k] == last[k]:
            k += 1
        below = kids(lo, hi, k)
        nodes += [(x, y, k + 1) for _, x, y in below if y - x > 1]
        for i, (c, x, y) in enumerate(below):
            for _, p, q in below[:i]:  # a letter replaced
                yield from matched((p, q, k + 1), (x, y, k + 1))
            # a letter inserted: the child against its parent, whose own way on by the same letter is the child itself
            if len(words[lo]) == k and len(words[x]) == k + 1:
                yield lo, x
            if len(below) > 1:
                deeper = {d: (p, q) for d, p, q in kids(x, y, k + 1)}
                for d, p, q in below:
                    if d != c and d in deeper:
                        yield from matched((p, q, k + 1), (*deeper[d], k + 2))


def within_parts(words: DataFrame) -> DataFrame:
    """(a, b): pairs of one part, each once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part: list[str]) -> pa.RecordBatch:
            part.sort()
            found = list(terminal_pairs(part, 0))
            return pa.RecordBatch.from_arrays([pa.array([part[p[i]] for p in found], pa.string()) for i in (0, 1)], names=["a", "b"])

        now, held = None, []
        for b in batches:
            for prefix, word in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if prefix != now:
                    if len(held) > 1:
                        yield out(held)
                    now, held = prefix, []
                held.append(word)
        if len(held) > 1:
            yield out(held)

    placed = words.select(F.expr("substring(word, 1, cut)").alias("prefix"), "word").repartition("prefix").sortWithinPartitions("prefix")
    return placed.mapInArrow(run, "a string, b string")


def sorted_join(a: DataFrame, b: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that is never a broadcast, whatever size Spark takes b for."""
    return a.join(b.hint("merge"), on, how)


def across_parts(words: DataFrame) -> DataFrame:
    """(a, b): pairs whose edit is in the letters that lead to their parts, each once."""
    at = words.select("word", F.posexplode(F.expr("transform(sequence(1, cut), i -> struct(substring(word, i, 1) as c, substring(word, i + 1, 1) as d, concat(substring(word, 1, i - 1), substring(word, i + 1)) as rest))")).alias("i", "x")).select("word", "i", "x.*")
    # a letter replaced: both words leave the same one open
    one = at.select("i", "rest", F.col("word").alias("a"), F.col("c").alias("ca"))
    replaced = sorted_join(one, at.select("i", "rest", F.col("word").alias("b"), F.col("c").alias("cb")), ["i", "rest"]).where("ca < cb").select("a", "b")
    # a letter deleted: of equal letters in a row, the last one
    shorter = sorted_join(at.where("c <> d"), words.select(F.col("word").alias("rest")), "rest").select(F.col("rest").alias("a"), F.col("word").alias("b"))
    return replaced.unionByName(shorter)


def variants(docs: DataFrame, every: int = 97) -> DataFrame:
    """docs(doc_id, text) as word, form, root, n, n_near, form_n."""
    words = written(vocabulary(docs, every), "vocabulary")
    cut = written(parts(words), "trie")
    pairs = within_parts(cut).unionByName(across_parts(cut))
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other")), F.struct(F.col("b").alias("word"), F.col("a").alias("other")))).alias("_p")).select("_p.*")
    known = sorted_join(both, words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    near = known.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w"))).alias("best"))
    formed = sorted_join(words, near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.m") >= MORE * F.col("n"), F.col("best")).alias("_f"))
    formed = written(formed.select("word", F.col("_f.w").alias("form"), "n", "n_near", (-F.col("_f.m")).alias("form_n")), "forms")
    # a chain of forms doubles n at each step at least, so doubling the reach this many times comes to its end
    most = formed.agg(F.max("n")).first()[0] or 1
    reach = written(formed.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    for _ in range(math.ceil(math.log2(max(2, math.log2(most + 1) + 1)))):
        reach = written(sorted_join(reach, reach.select(F.col("word").alias("root"), F.col("root").alias("_on")), "root", "left").select("word", F.coalesce("_on", "root").alias("root")), "roots")
    return sorted_join(formed, reach, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: every word of the documents with its near words, form and root."""
    return variants(table(spark, sf_dir, "documents"))
