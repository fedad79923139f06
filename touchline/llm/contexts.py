"""Language-model scores by context-tree weighting over bytes.

A text is its bytes and an end mark, 0xFF, which no text holds; before it come end marks, too. A byte is eight binary decisions,
each at a node: the context (up to DEPTH bytes before it, nearest first) and the bits already known. A node's Krichevsky-Trofimov
estimate depends on nothing but its counts of zeros and ones over the training texts, so a tree needs counts alone. From the
longest contexts up, a node's weighted probability is the mean of its own estimate's and the product of its children's; down the
same path a bit's probability mixes the estimates of all depths, by weights that follow from those. A context that never came
counts as a node without any bits, whose estimate is a half.

Blocks of documents ask for their byte contexts and words (`blockwise`); contexts of the same nearest TOP bytes are of one range,
where their part of the tree is built. Only sums for the nodes of the TOP - 1 nearest bytes leave a range; from these come the
upper levels, of at most 256^2 contexts, as small tables, and from those each path's mix of the upper depths: a straight line in
what the lower ones say. In a second pass a range gives each block the logarithms of its contexts' probabilities.

Contexts and words of all documents are in the tables, those of held-out ones with a count of 0, so every score comes from the
whole of the training texts. Words are known by 63-bit hashes.

Rows: a null text is empty, and scores its end mark alone; texts of any length are read whole; repeated rows and null doc_ids are
scored each, the latter held out never; other columns are not read; an empty table gives no rows, and without training texts
every bit has probability a half.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blockwise
from .chunks import mix, span_hashes
from .common import table, written

#: Bytes of a context; nearest bytes by which contexts are dealt.
DEPTH, TOP = 6, 3
#: Documents that are scored together: their number goes with each key in a byte; keys of a part of the tree.
GROUP, PART = 256, 1 << 19
_WORD = np.uint64(1 << 63)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_HALF = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1 << 16) + 0.5))])
_WHOLE = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, (1 << 16) + 1)))])


def _gamma(table: np.ndarray, n: np.ndarray, shift: float) -> np.ndarray:
    """log of Gamma(n + shift) / Gamma(shift): a table, and Stirling's series beyond it."""
    out = table[np.minimum(n, table.size - 1)]
    far = n >= table.size
    if far.any():
        x = n[far] + shift
        out[far] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - math.lgamma(shift)
    return out


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The logarithm of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return _gamma(_HALF, n0, 0.5) + _gamma(_HALF, n1, 0.5) - _gamma(_WHOLE, n0 + n1, 1.0)


def grams(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each byte of each text and its end: the bytes before it, nearest first, and itself; and where each text's begin,
    with the end."""
    n = begin.size - 1
    at = np.arange(n, dtype=np.int64)
    # DEPTH end marks before each text and one after it
    wide = np.full(data.size + n * (DEPTH + 1) + 1, 0xFF, np.uint64)
    size = np.diff(begin)
    first = begin[:-1] + at * (DEPTH + 1) + DEPTH
    wide[np.arange(data.size) + np.repeat(first - begin[:-1], size)] = data
    ends = np.concatenate([[0], np.cumsum(size + 1)])
    place = np.arange(ends[-1]) + np.repeat(first - ends[:-1], size + 1)
    key = np.zeros(wide.size, np.uint64)
    for k in range(1, DEPTH + 1):
        key[k:] |= wide[:-k] << np.uint64(8 * (DEPTH + 1 - k))
    return (key | wide)[place], ends


def words(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each word, and for each text's end as its last token; and where each text's begin, with the end."""
    data = _LOWER[data]
    inside = ~_SPACE[data]
    edge = np.zeros(data.size + 1, bool)
    edge[begin] = True
    starts = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1])) if data.size else np.zeros(0, np.int64)
    stops = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])) + 1 if data.size else starts
    owner = np.searchsorted(begin, starts, side="right") - 1
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=begin.size - 1) + 1)]) if begin.size > 1 else np.zeros(1, np.int64)
    out = np.full(ends[-1], _WORD)  # the end's key: no word has the hash 0
    if starts.size:
        out[np.arange(starts.size) + owner] = np.maximum(span_hashes(data, starts, stops) >> np.uint64(1), np.uint64(1)) | _WORD
    return out, ends


def _different(keys: np.ndarray) -> blockwise.Keys:
    """Sorted different keys and how often each comes."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if keys.size else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, keys.size))


def _asked(batch: pa.RecordBatch, i: int, j: int, data: np.ndarray, begin: np.ndarray) -> blockwise.Keys:
    held = batch.column(2).slice(i, j - i).to_numpy(zero_copy_only=False).astype(bool)
    found = []
    for keys, ends in (grams(data, begin), words(data, begin)):
        out = np.repeat(held, np.diff(ends))
        learned, times = _different(keys[~out])
        found += [(learned, times)]
        if out.any():
            other, _ = _different(keys[out])
            found.append((other, np.zeros(other.size, np.int64)))
    return np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found])


def range_of(keys: np.ndarray) -> np.ndarray:
    """Contexts by their nearest TOP bytes, words by their hash."""
    return mix(np.where(keys >= _WORD, keys, keys >> np.uint64(8 * (DEPTH + 1 - TOP))))


class Part:
    """The part of the tree below some contexts of TOP bytes: at each depth from DEPTH to TOP the different contexts with the byte that
    follows, sorted, and their counts; up: where each of a depth is in the next."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts, self.up = [keys], [counts], []
        for _ in range(DEPTH - TOP):
            low = self.keys[-1]
            short = ((low >> np.uint64(16)) << np.uint64(8)) | (low & np.uint64(255))
            order = np.argsort(short, kind="stable")
            new = np.concatenate([[True], short[order][1:] != short[order][:-1]]) if order.size else np.zeros(0, bool)
            up = np.empty(order.size, np.int64)
            up[order] = np.cumsum(new) - 1
            self.up.append(up)
            self.keys.append(short[order][new])
            self.counts.append(np.bincount(up, self.counts[-1], int(new.sum())).astype(np.int64))

    def bit(self, k: int) -> Iterator[tuple[np.ndarray, ...]]:
        """For each depth, from the longest contexts up: the node of each key at that bit, and of each node its first key, its zeros
        and ones, the logarithm of its weighted probability, and the share of its own estimate in its mix."""
        below = first = None
        for d, (keys, counts) in enumerate(zip(self.keys, self.counts)):
            at = keys >> np.uint64(8 - k)
            new = np.concatenate([[True], at[1:] != at[:-1]]) if keys.size else np.zeros(0, bool)
            node, was, first = np.cumsum(new) - 1, first, np.flatnonzero(new)
            ones = np.add.reduceat(counts * ((keys >> np.uint64(7 - k)) & np.uint64(1)).astype(np.int64), first) if keys.size else counts
            zeros = (np.add.reduceat(counts, first) if keys.size else counts) - ones
            own, share = log_kt(zeros, ones), np.ones(first.size)
            if d:
                children = np.bincount(node[self.up[d - 1][was]], below, own.size)
                share = 1 / (1 + np.exp(np.clip(children - own, -700, 700)))
                own = np.logaddexp(own, children) + math.log(0.5)
            below = own
            yield node, first, zeros, ones, own, share

    def summary(self) -> tuple[np.ndarray, ...]:
        """Of each node of depth TOP - 1: context, bits known, and its zeros, ones and sum of logarithms from this part."""
        out = []
        for k in range(8):
            *_, (_, first, zeros, ones, own, _) = self.bit(k)
            at = self.keys[-1][first]
            out.append(((at >> np.uint64(16)).astype(np.int64), _known(at, k), zeros, ones, own))
        context, known, *values = (np.concatenate(x) for x in zip(*out))
        order = np.lexsort([known, context])
        new = np.flatnonzero(np.concatenate([[True], (np.diff(context[order]) != 0) | (np.diff(known[order]) != 0)])) if order.size else order
        return context[order][new], known[order][new], *(np.add.reduceat(v[order], new) if order.size else v for v in values)

    def log10(self, lines: dict[int, np.ndarray]) -> np.ndarray:
        """The logarithm of each key's probability. lines: by context of TOP - 1 bytes, for each node, of the 256 that the bits known
        may be, what the upper depths make of a probability p: lines[context][0][node] + lines[context][1][node] * p."""
        low, total = self.keys[0], np.zeros(self.keys[0].size)
        upper = (low >> np.uint64(8 * (DEPTH + 2 - TOP))).astype(np.int64)
        edge = np.flatnonzero(np.diff(upper, prepend=-1))
        for k in range(8):
            p, at = None, np.arange(low.size)
            for d, (node, _, zeros, ones, _, share) in enumerate(self.bit(k)):
                at = self.up[d - 1][at] if d else at
                of = node[at]
                one = ((ones + 0.5) / (zeros + ones + 1.0))[of]
                p = share[of] * one + (1 - share[of]) * p if d else one
            known = _known(low, k)
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), upper.size]):
                line = lines[int(upper[a])]
                p[a:b] = line[0][known[a:b]] + line[1][known[a:b]] * p[a:b]
            total += np.log10(np.where((low >> np.uint64(7 - k)) & np.uint64(1) == 1, p, 1 - p))
        return total


def _known(keys: np.ndarray, k: int) -> np.ndarray:
    """The node of a byte's bit k: a one and the bits before it."""
    return ((keys & np.uint64(255) | np.uint64(256)) >> np.uint64(8 - k)).astype(np.int64)


def parts(keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple[slice, Part]]:
    """A range's contexts in parts of some PART keys, none of which cuts a context of TOP bytes."""
    upper = keys >> np.uint64(8 * (DEPTH + 1 - TOP))
    i = 0
    while i < keys.size:
        j = int(np.searchsorted(upper, upper[min(i + PART, keys.size) - 1], side="right"))
        yield slice(i, j), Part(keys[i:j], counts[i:j])
        i = j


def _summed(number: int, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    keys, counts = blockwise.known_keys([r[1:] for r in rows])
    split = int(np.searchsorted(keys, _WORD))
    seen = counts[split:]
    made = [(np.array([-1]), np.array([0]), np.array([(seen > 0).sum()]), np.array([seen.sum()]), np.zeros(1))]
    made += [part.summary() for _, part in parts(keys[:split], counts[:split])]
    columns = [np.concatenate(c) for c in zip(*made)]
    yield pa.RecordBatch.from_arrays([pa.array(np.full(columns[0].size, number), pa.int32()), *(pa.array(c.astype(np.int64)) for c in columns[:4]), pa.array(columns[4])], names=["range", "context", "known", "zeros", "ones", "log"])


def _weighted(nodes: DataFrame) -> DataFrame:
    """nodes(context, known, zeros, ones, log: of their children) with one (their estimate), weight (its share) and own (the
    logarithm of their weighted probability)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            context, known, n0, n1, children = (c.to_numpy() for c in b.columns)
            kt = log_kt(n0, n1)
            weight = 1 / (1 + np.exp(np.clip(children - kt, -700, 700)))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array((n1 + 0.5) / (n0 + n1 + 1.0)), pa.array(weight), pa.array(np.logaddexp(kt, children) + math.log(0.5))], names=["context", "known", "zeros", "ones", "one", "weight", "own"])

    return nodes.select("context", "known", "zeros", "ones", "log").mapInArrow(run, "context long, known long, zeros long, ones long, one double, weight double, own double")


def upper_lines(sums: DataFrame) -> DataFrame:
    """(context, lines): for each context of TOP - 1 bytes, its nodes, then for each of them the two numbers of the line that the upper
    depths make of a lower one's probability."""
    group = lambda d, log: d.groupBy("context", "known").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum(log).alias("log"))
    levels = [written(_weighted(group(sums, "log")), "levels")]
    for _ in range(TOP - 1):
        levels.append(written(_weighted(group(levels[-1].withColumn("context", F.shiftright("context", 8)), "own")), "levels"))
    # from the root down: a + b * p
    now = levels[-1].select("context", "known", (F.col("weight") * F.col("one")).alias("a"), (1 - F.col("weight")).alias("b"))
    for level in levels[-2::-1]:
        here = level.select(F.col("context").alias("_c"), F.shiftright("context", 8).alias("context"), "known", "one", "weight")
        now = here.join(now, ["context", "known"]).select(F.col("_c").alias("context"), "known", (F.col("a") + F.col("b") * F.col("weight") * F.col("one")).alias("a"), (F.col("b") * (1 - F.col("weight"))).alias("b"))
    # a context has 255 nodes at most
    every = now.groupBy("context").agg(F.collect_list(F.struct("known", "a", "b")).alias("_x"))
    return every.select("context", F.expr("concat(transform(_x, x -> double(x.known)), transform(_x, x -> x.a), transform(_x, x -> x.b))").alias("lines"))


def _answered(rows: list[tuple]):
    lines: dict[int, np.ndarray] = {}
    for _, _, context, nodes in rows:
        if context is not None:
            known, a, b = np.array(nodes).reshape(3, -1)
            lines[context] = np.zeros((2, 256))
            lines[context][:, known.astype(np.int64)] = a, b
    keys, counts = blockwise.known_keys(rows)
    split = int(np.searchsorted(keys, _WORD))
    log = np.concatenate([part.log10(lines).astype("<f4") for _, part in parts(keys[:split], counts[:split])] or [np.zeros(0, "<f4")])

    def answer(asked: np.ndarray) -> bytes:
        at = np.searchsorted(keys, asked)
        cut = int(np.searchsorted(asked, _WORD))
        pieces = [blockwise.pack(asked, True), _squeezed(log[at[:cut]]), blockwise.pack(counts[at[cut:]], False)]
        return b"".join(len(x).to_bytes(8, "little") + x for x in pieces)

    return answer


def _squeezed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(-1, 4).T.tobytes())


def _opened(answer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, logarithms of the contexts among them, and counts of the words."""
    out, at = [], 0
    while at < len(answer):
        size = int.from_bytes(answer[at : at + 8], "little")
        out.append(answer[at + 8 : at + 8 + size])
        at += 8 + size
    log = np.frombuffer(zstandard.ZstdDecompressor().decompress(out[1]), np.uint8).reshape(4, -1).T.copy().view("<f4").ravel()
    return blockwise.unpack(out[0], True), log, blockwise.unpack(out[2], False).view(np.int64)


def _looked_up(keys: np.ndarray, ends: np.ndarray, known: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    """For each text, sums of the values of its keys, of which every one is known. The keys of some texts are sorted together with
    the texts' numbers in their last byte, so that the search goes forward."""
    n, out = ends.size - 1, [[] for _ in values]
    for i in range(0, n, GROUP):
        j = min(n, i + GROUP)
        part = keys[ends[i] : ends[j]]
        tagged = np.sort((part << np.uint64(8)) | np.repeat(np.arange(j - i, dtype=np.uint64), np.diff(ends[i : j + 1])))
        at = np.searchsorted(known, tagged >> np.uint64(8))
        text = (tagged & np.uint64(255)).astype(np.int64)
        for o, v in zip(out, values):
            o.append(np.bincount(text, v[at], j - i))
    return [np.concatenate(o or [np.zeros(0)]) for o in out]


def _scored(total: int, different: int):
    low = math.log10(total + 0.1 * (different + 1)) if total or different else 0.0

    def work(told: dict[int, bytes], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            if model is None:
                opened = [_opened(x) for x in told.values()]
                told.clear()
                keys = np.concatenate([k[: v.size] for k, v, _ in opened])
                order = np.argsort(keys)
                named = np.concatenate([k[v.size :] for k, v, _ in opened]) & ~_WORD
                other = np.argsort(named)
                count = np.concatenate([c for _, _, c in opened])[other]
                model = keys[order], np.concatenate([v for _, v, _ in opened])[order].astype(np.float64), (named[other] >> np.uint64(7)), np.log10(count + 0.1) - low, (count > 0).astype(np.float64)
            columns: list[list[np.ndarray]] = [[] for _ in range(4)]
            for _, _, data, begin in blockwise.windows(b, 1):
                key, ends = grams(data, begin)
                columns[0] += _looked_up(key, ends, model[0], [model[1]])
                word, ends = words(data, begin)
                # 56 bits of a word's hash leave room for the text's number
                base, known = _looked_up((word & ~_WORD) >> np.uint64(7), ends, model[2], [model[3], model[4]])
                for c, x in zip(columns[1:], (base, known, np.diff(ends))):
                    c.append(x)
            score, base, known, n = (np.concatenate(c) for c in columns)
            yield pa.RecordBatch.from_arrays([b.column(3), b.column(2), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return work


def score(docs: DataFrame, held_out: str) -> DataFrame:
    """docs(doc_id, text) as doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. held_out: an expression; texts for
    which it holds aren't learned from."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.expr(f"coalesce({held_out}, false)").alias("held"))
    blocks = blockwise.blocks_for(docs)
    dealt = blockwise.dealt(docs, blocks).select("block", "text", "held", "doc_id")
    asked = written(blockwise.questions(dealt.select("block", "text", "held"), _asked, range_of, blocks), "asked")
    known = written(blockwise.totals(asked, blocks), "totals")
    sums = written(blockwise.by_range(known, _summed, "range int, context long, known long, zeros long, ones long, log double", blocks), "sums")
    different, total = sums.where("context < 0").agg(F.sum("zeros"), F.sum("ones")).first()
    sums = sums.where("context >= 0")
    each = sums.select("range", "context").distinct().join(upper_lines(sums.drop("range")), "context").select("range", "context", "lines")
    told = blockwise.answers(asked, known, _answered, blocks, each)
    out = blockwise.with_answers(dealt, told, _scored(total or 0, different or 0), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double", blocks)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total or 0).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: every document's score, and that of its words alone."""
    return score(table(spark, sf_dir, "documents"), "crc32(encode(cast(doc_id as string), 'UTF-8')) % 10 = 0")
