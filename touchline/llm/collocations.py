"""Collocations: phrases of two to four words that come together more often than their parts alone, by language.

The words of a shard of texts become ids, and its suffixes, up to the end of their piece of text, are sorted by their first words:
by prefix doubling, in which the order by two words follows from that by one, and the order by four from that by two. Equal
beginnings of neighbours in that order (LCP intervals) are the shard's phrases with their counts, which are summed by key over
all shards.

A phrase is frequent only if all its pairs of neighbouring words are, so shards first ask which of their pairs are (`blockwise`):
by keys of KEY bits, which may take two pairs for one and so let too much pass, but never too little. Pieces are then cut at the
pairs that aren't frequent, and only what is left is counted as text. Counts are exact, over all rows.

Rows: a null or empty text has no words; texts of any length are used whole; a null language is `und`; repeated rows count each;
null doc_ids count like others; ties go as the order by score, count and phrase says; other columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blockwise
from .chunks import mix, span_hashes
from .common import table, written

#: Words of a phrase, at most; occurrences of a candidate, at least; bits of a pair's key.
LONGEST, TIMES, KEY = 4, 30, 44
#: A candidate goes if a longer one that holds it comes in so many of its occurrences, of 100.
HELD_IN = 80

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[9, 32]] = True
_STOP[[*b".,;:!?", 10, 11, 12, 13]] = True
_STEP = np.uint64(0x2545F4914F6CDD1D)


class Shard:
    """The words of some texts, in order: hash (of word and language), start, stop, text, and the words from each to the end of
    its piece."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, langs: list[str]) -> None:
        self.data = _LOWER[data]
        inside = ~(_SPACE | _STOP)[self.data]
        edge = np.zeros(data.size + 1, bool)
        edge[begin] = True
        self.starts = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1])) if data.size else np.zeros(0, np.int64)
        self.stops = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])) + 1 if data.size else self.starts
        self.text = np.searchsorted(begin, self.starts, side="right") - 1
        stops = np.concatenate([[0], np.cumsum(_STOP[self.data])])
        self.joined = (self.text[1:] == self.text[:-1]) & (stops[self.starts[1:]] == stops[self.stops[:-1]]) if self.starts.size else np.zeros(0, bool)
        kinds = {x: np.uint64(hash_of(x)) for x in set(langs)}
        lang = np.array([kinds[x] for x in langs], np.uint64)
        self.hash = mix(span_hashes(self.data, self.starts, self.stops) * _STEP + lang[self.text]) if self.starts.size else np.zeros(0, np.uint64)

    def spaced(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all words with one space between them, and where each word starts and stops there."""
        size = self.stops - self.starts
        stops = np.cumsum(size + 1) - 1
        out = np.full(int(stops[-1]) if size.size else 0, 32, np.uint8)
        starts = stops - size
        at = np.repeat(np.arange(size.size), size)
        within = np.arange(at.size) - np.repeat(np.cumsum(size) - size, size)
        out[starts[at] + within] = self.data[self.starts[at] + within]
        return out, starts, stops

    def pair_keys(self) -> np.ndarray:
        """The key of each word's pair with the next one; 0 where its piece ends."""
        key = np.zeros(self.hash.size, np.uint64)
        if key.size:
            key[:-1] = np.where(self.joined, short(mix(self.hash[:-1] * _STEP + self.hash[1:])), np.uint64(0))
        return key

    def word_keys(self) -> np.ndarray:
        return short(mix(self.hash + _STEP))


def among(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which keys are among sorted different ones. Those are searched, never gone through, however many they are."""
    if not some.size:
        return np.zeros(keys.size, bool)
    return some[np.minimum(np.searchsorted(some, keys), some.size - 1)] == keys


def short(h: np.ndarray) -> np.ndarray:
    """KEY bits of a hash, never 0."""
    return np.maximum(h >> np.uint64(64 - KEY), np.uint64(1))


def hash_of(text: str) -> int:
    data = np.frombuffer(text.encode() or b"\x00", np.uint8)
    return int(span_hashes(data, np.zeros(1, np.int64), np.full(1, data.size))[0])


def lengths(joined: np.ndarray, n: int) -> np.ndarray:
    """Words from each word to the end of its piece; joined: whether each but the last goes on with the next."""
    ends = np.flatnonzero(np.append(~joined, True)) if n else np.zeros(0, np.int64)
    at = np.arange(n)
    return ends[np.searchsorted(ends, at)] - at + 1


def suffix_order(ids: np.ndarray, left: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes by their first words (a power of two of them), and how many of these each has in common with the one
    before. ids: from 0; left: words to the end of the piece."""
    rank, width, n = ids.astype(np.int64) + 1, 1, ids.size
    while width < words:
        # the rank of what follows, none where the piece ends
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:]
        after[left <= width] = 0
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + after, return_inverse=True)[1] + 1
        width *= 2
    order = np.argsort(rank, kind="stable")
    shared, alive = np.zeros(n, np.int64), np.ones(max(0, n - 1), bool)
    for k in range(words):
        a, b = order[:-1], order[1:]
        alive = alive & (left[a] > k) & (left[b] > k)
        alive[alive] = ids[a[alive] + k] == ids[b[alive] + k]
        shared[1:] += alive
    return order, shared


def phrases(ids: np.ndarray, joined: np.ndarray, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length, where a phrase of so many words begins (one place for each different one), and its count."""
    left = lengths(joined, ids.size)
    size = 1
    while size < words:
        size *= 2
    order, shared = suffix_order(ids, left, size)
    for k in range(1, words + 1):
        long = left[order] >= k
        interval = np.cumsum(shared < k)[long]
        if interval.size:
            first = np.flatnonzero(np.diff(interval, prepend=-1))
            yield k, order[long][first], np.diff(np.append(first, interval.size))


def _langs(batch: pa.RecordBatch, i: int, j: int, column: int) -> list[str]:
    return [x if x is not None else "und" for x in batch.column(column).slice(i, j - i).to_pylist()]


def _asked(batch: pa.RecordBatch, i: int, j: int, data: np.ndarray, begin: np.ndarray) -> blockwise.Keys:
    """Keys of a window's words and pairs, and their counts."""
    shard = Shard(data, begin, _langs(batch, i, j, 2))
    _, ids = np.unique(shard.hash, return_inverse=True)
    own = {1: shard.word_keys(), 2: shard.pair_keys()}
    found = [(own[k][at], n) for k, at, n in phrases(ids, shard.joined, 2)]
    return blockwise.together(np.concatenate([k for k, _ in found] or [np.zeros(0, np.uint64)]), np.concatenate([n for _, n in found] or [np.zeros(0, np.int64)]).astype(np.int64))


def _told(least: int):
    def work(rows: list[tuple]):
        """Which of a block's keys are frequent."""
        keys, counts = blockwise.known_keys(rows)
        frequent = keys[counts >= least]

        def answer(own: np.ndarray) -> bytes | None:
            some = own[np.isin(own, frequent, assume_unique=True)]
            return blockwise.pack(some, True) if some.size else None

        return answer

    return work


def _counted(words: int):
    def work(told: dict[int, bytes], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = None
        for b in batches:
            if frequent is None:
                frequent = np.sort(np.concatenate([blockwise.unpack(x, True) for x in told.values()] or [np.zeros(0, np.uint64)]))
            for i, j, data, begin in blockwise.windows(b, 1):
                langs = _langs(b, i, j, 2)
                shard = Shard(data, begin, langs)
                _, one, ids = np.unique(shard.hash, return_index=True, return_inverse=True)
                kinds, total = _by_lang(langs, shard.text)
                yield _counts(kinds, np.arange(len(kinds)), 0, pa.array([""] * len(kinds), pa.string()), np.array(total, np.int64))
                code = np.array([kinds.index(x) for x in langs], np.int64)
                spaced, starts, stops = shard.spaced()
                alone = among(shard.word_keys()[one], frequent)[ids]
                joined = shard.joined.copy()
                joined[joined] = among(shard.pair_keys()[:-1][joined], frequent)
                # words that aren't frequent stand in no phrase; those with no frequent neighbour count alone
                _, first, n = np.unique(ids[alone], return_index=True, return_counts=True)
                p = np.flatnonzero(alone)[first]
                yield _counts(kinds, code[shard.text[p]], 1, spans(spaced, starts[p], stops[p]), n)
                some = np.append(joined, False) | np.append(False, joined) if shard.hash.size else np.zeros(0, bool)
                at = np.flatnonzero(some)
                for k, where, n in phrases(ids[at], joined[at[:-1]] if at.size else joined[:0], words):
                    if k > 1:
                        p = at[where]
                        yield _counts(kinds, code[shard.text[p]], k, spans(spaced, starts[p], stops[p + k - 1]), n)

    return work


def spans(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    """Spans of UTF-8 bytes as strings."""
    size = stops - starts
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    values = data[np.repeat(starts - ends[:-1], size) + np.arange(ends[-1])]
    return pa.LargeStringArray.from_buffers(size.size, pa.py_buffer(ends), pa.py_buffer(values)).cast(pa.string())


def _counts(kinds: list[str], code: np.ndarray, words: int, phrase: pa.Array, f: np.ndarray) -> pa.RecordBatch:
    lang = pa.array(kinds, pa.string()).take(pa.array(code, pa.int64()))
    return pa.RecordBatch.from_arrays([lang, pa.array(np.full(code.size, words, np.int32)), phrase, pa.array(f.astype(np.int64))], names=["lang", "words", "phrase", "f"])


def _by_lang(langs: list[str], text: np.ndarray) -> tuple[list[str], list[int]]:
    """The words of each language."""
    kinds = sorted(set(langs))
    code = np.array([kinds.index(x) for x in langs], np.int64)
    return kinds, np.bincount(code[text], minlength=len(kinds)).tolist() if text.size else [0] * len(kinds)


def counts(docs: DataFrame, least: int = TIMES, words: int = LONGEST) -> DataFrame:
    """docs(doc_id, text, lang) as lang, words, phrase, f: phrases of up to so many words that occur `least` times, and a row with
    0 words for the number of all words of a language."""
    docs = docs.select("doc_id", F.col("text").alias("text"), F.col("lang").cast("string").alias("lang"))
    blocks = blockwise.blocks_for(docs)
    dealt = blockwise.dealt(docs, blocks).select("block", "text", "lang")
    asked = written(blockwise.questions(dealt, _asked, mix, blocks), "asked")
    told = blockwise.answers(asked, blockwise.totals(asked, blocks), _told(least), blocks)
    some = blockwise.with_answers(dealt, told, _counted(words), "lang string, words int, phrase string, f long", blocks)
    return some.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where((F.col("words") == 0) | (F.col("f") >= least))


def collocations(docs: DataFrame, least: int = TIMES, words: int = LONGEST, first: int = 2000, scale: int = 2_000_000, held_in: int = HELD_IN) -> DataFrame:
    """docs(doc_id, text, lang) as lang, rank, phrase, a, l, r, n, score: each language's first phrases by score."""
    every = written(counts(docs, least, words), "phrases")
    part = every.where("words > 0").select("lang", "phrase", "f")
    candidate = every.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("_w"))
    # each cut: the first words and the rest
    cuts = candidate.select("lang", "phrase", "a", "_w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.expr("slice(_w, 1, k)"), " ").alias("_l"), F.array_join(F.expr("slice(_w, k + 1, size(_w))"), " ").alias("_r"))
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("_l"), F.col("f").alias("l")), ["lang", "_l"]).join(part.select("lang", F.col("phrase").alias("_r"), F.col("f").alias("r")), ["lang", "_r"])
    wide = "decimal(38,0)"
    score = F.expr(f"(cast({scale} as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))").cast("long")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("_b"))
    # phrases in longer ones
    span = "flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(_w, i, m), ' '))))"
    inside = candidate.where("words > 2").select("lang", F.explode(F.array_distinct(F.expr(span))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_held"))
    left = best.join(inside, ["lang", "phrase"], "left").where(F.col("_held").isNull() | (F.col("_held").cast(wide) * 100 < F.col("a").cast(wide) * held_in))
    total = every.where("words = 0").select("lang", F.col("f").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("_b.score").desc(), F.col("a").desc(), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "_b.l", "_b.r", "n", "_b.score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: each language's first 2000 phrases."""
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(list_slice(ws, i, i + k - 1), ' '))) AS phrase FROM w, range(1, 5) t(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, CAST(count(*) AS BIGINT) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 30),
c AS (SELECT lang, k AS words, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cuts AS (SELECT lang, words, phrase, a, k, array_to_string(list_slice(ws, 1, k), ' ') AS lp, array_to_string(list_slice(ws, k + 1, words), ' ') AS rp FROM c, range(1, 4) t(k) WHERE k < words),
scored AS (SELECT cuts.lang, cuts.phrase, a, cuts.k, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (x.f + y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = lp JOIN f y ON y.lang = cuts.lang AND y.phrase = rp),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, phrase, max(a) AS held FROM (SELECT lang, a, unnest(list_transform(range(1, words - m + 2), lambda i: array_to_string(list_slice(ws, i, i + m - 1), ' '))) AS phrase
  FROM c, range(2, 4) t(m) WHERE m < words) GROUP BY lang, phrase),
ranked AS (SELECT b.lang, b.phrase, a, l, r, score, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE held IS NULL OR CAST(held AS HUGEINT) * 100 < CAST(a AS HUGEINT) * 80)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
