"""Toxicity by a weighted lexicon.

Texts are folded first: lower case, look-alike letters of other scripts and full-width forms to Latin, digits and signs that
stand for letters inside words to those letters, everything else to spaces. One Aho-Corasick automaton then finds all
lexicon stems at word starts together with exception phrases; a stem inside an exception phrase doesn't count. The summed
weights are divided by the text's length in words, and a logistic curve turns that density into a score.

The lexicon, the exception phrases and the curve are learned from a bounded sample of labelled rows (max_rows, lowest hashes of
doc_id first). An entry is a stem, 4 to 24 letters at the start of a word, or a whole word of fewer or more letters, with its
log-odds as weight; all that occur in the sample are candidates and counted by Spark. Scores use
the text alone.

Rows: a null or empty text scores as a text without any hit; texts of any length are read whole; repeated rows and null
doc_ids are scored each, the latter never held out; labels that are null or without a document are not learned from; other columns are not read; an
empty table gives no rows, and without labels of both kinds every score is 0.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Letters of other scripts that look like Latin ones, and signs that stand for letters.
LOOKALIKES = dict(zip("аеорсухіјѕԁһԛԝвмнкт" "αεορνικτυχ", "aeopcyxijsdhqwbmhkt" "aeopviktux"))
STANDS_FOR = dict(zip("0134578@$", "oieastbas"))

#: Letters of a stem, at least and at most; toxic rows that must hold an entry; least log-odds; keys that a task counts at a time,
#: if a text hasn't more.
SHORT, LONG, ROWS, ODDS, KEYS = 4, 24, 4, 2.0, 200_000


class Folding(dict):
    """For str.translate: a character's folded form, remembered."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if 0xFF01 <= code <= 0xFF5E:
            c = chr(code - 0xFEE0)
        low = c.lower()
        out = STANDS_FOR.get(c) or LOOKALIKES.get(low) or (low if low.isalpha() and len(low) == 1 else " ")
        self[code] = out
        return out


_FOLDING = Folding()


def fold(text: str | None) -> str:
    """The folded text, with a space at either end."""
    if not text:
        return " "
    words = text.translate(_FOLDING).split()
    return f" {' '.join(words)} "


def stems(words: Iterable[str]) -> set[str]:
    """Candidates: the stems of words, and shorter and longer words with the space that ends them."""
    return {w[:k] if len(w) >= SHORT else f"{w} " for w in words for k in range(min(len(w), SHORT), min(len(w), LONG) + 1)} | {f"{w} " for w in words if len(w) > LONG}


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float] = (-50.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for s, w in self.weights.items():
            a.add_word(f" {s}", (w, len(s) + 1))
        for p in self.exceptions:
            a.add_word(f" {p} ", (0.0, len(p) + 2))
        if len(a):
            a.make_automaton()
        return a


def hits(folded: str, a: ahocorasick.Automaton) -> tuple[float, int]:
    """Summed weight and number of hits; of nested stems at one word start the heaviest counts, none inside an exception."""
    if not len(a):
        return 0.0, 0
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (w, n) in a.iter(folded):
        start = end - n + 1
        if w == 0.0:
            spared.append((start, end))
        else:
            best[start] = max(w, best.get(start, 0.0))
    if spared:
        spared.sort()
        starts, reach = [x for x, _ in spared], list(accumulate((y for _, y in spared), max))
        inside = lambda s: (i := bisect_right(starts, s)) and reach[i - 1] > s
        best = {s: w for s, w in best.items() if not inside(s)}
    return sum(best.values()), len(best)


def density(weight: float, words: int) -> float:
    """Weight by length; the constant keeps one hit in a very short text from counting as a text full of them."""
    return math.log1p(1000.0 * weight / (words + 20.0))


def sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(text, label) of at most max_rows labelled rows, lowest hashes first; a bounded side, so it can be broadcast. Of a doc_id that
    repeats the least text counts."""
    few = labels.where("doc_id is not null and label is not null").select(F.col("doc_id").alias("_id"), F.col("label").cast("int").alias("label")).orderBy(F.xxhash64("_id"), "_id", "label").limit(max_rows)
    met = docs.select(F.col("doc_id").alias("_doc"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few.distinct()), F.col("_doc") == F.col("_id"))
    return met.groupBy("_id", "label").agg(F.min("text").alias("text")).select("text", "label")


def _counts(rows: DataFrame, key) -> DataFrame:
    """Rows that hold each key: (k, label, n). key(text): a text's set of keys; tasks count before anything is shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            for text, label in zip(b.column(0), b.column(1).to_pylist()):
                n.update((k, label) for k in key(text.as_py()))
                if len(n) > KEYS:
                    yield out(n)
                    n = Counter()
        yield out(n)

    def out(n: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in n], pa.string()), pa.array([x for _, x in n], pa.int32()), pa.array(n.values(), pa.int64())], names=["k", "label", "n"])

    return rows.select("text", "label").mapInArrow(run, "k string, label int, n long").groupBy("k", "label").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Lexicon:
    """labels(doc_id, label): 1 for toxic rows."""
    rows = written(sample(docs, labels, max_rows), "toxic-sample")
    total = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n_toxic, n_clean = total.get(1, 0), total.get(0, 0)
    lex = Lexicon()
    if not n_toxic or not n_clean:
        return lex

    def all_stems(text: str | None) -> set[str]:
        return stems(set(fold(text).split()))

    n = _counts(rows, all_stems).groupBy("k").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))
    found = {r["k"]: (r["odds"], r["t"]) for r in n.where(F.col("t") >= ROWS).select("k", "t", odds.alias("odds")).where(F.col("odds") >= ODDS).collect()}
    # the best stem of each family: weight by support; of equals the longest, which is the most specific
    heads: dict[str, list[str]] = {}
    for k in sorted(found, key=lambda k: (-found[k][0] * math.sqrt(found[k][1]), -len(k), k)):
        family = heads.setdefault(k[:SHORT], [])
        if not any(k.startswith(s) or (s.startswith(k) and found[s][1] >= 0.9 * found[k][1]) for s in family):
            family.append(k)
            lex.weights[k] = found[k][0]
    known = dict(lex.weights)

    def phrases(text: str | None) -> set[str]:
        words, out = fold(text).split(), set()
        for i, w in enumerate(words):
            if not known.keys().isdisjoint(stems((w,))):
                out.update(" ".join(p) for p in (words[i - 1 : i + 1] if i else [], words[i : i + 2]) if len(p) == 2)
        return out

    seen: dict[str, list[int]] = {}
    for r in _counts(rows, phrases).where("n >= 3").collect():
        seen.setdefault(r["k"], [0, 0])[r["label"]] += r["n"]
    lex.exceptions = sorted(p for p, (c, t) in seen.items() if c >= 3 and t * n_clean < 0.2 * c * n_toxic)
    points = densities(rows, lex, ["label"]).select("label", "density").toPandas()
    lex.curve = logistic(points["density"].to_numpy(), points["label"].to_numpy())
    return lex


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Intercept and slope by Newton's method; the slope isn't let below 0, so more toxic words never lower a score."""
    a = np.stack([np.ones_like(x), x], 1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * b)
        b += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), max(0.0, float(b[1]))


def found_in(spark: SparkSession, lex: Lexicon) -> Callable[..., Column]:
    """A function of a text: its hits and density. Only texts go through Python, whatever else a row holds."""
    held = spark.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        a = held.value.automaton()
        for texts in batches:
            n, d = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            for i, text in enumerate(texts):
                folded = fold(text.as_py())
                w, n[i] = hits(folded, a)
                d[i] = density(w, folded.count(" ") - 1)
            yield pa.StructArray.from_arrays([pa.array(n), pa.array(d)], names=["hits", "density"])

    # marked so that each text is looked through once, where several expressions use the result
    return F.arrow_udf(run, "hits long, density double").asNondeterministic()


def densities(docs: DataFrame, lex: Lexicon, keep: list[str]) -> DataFrame:
    """docs(keep..., text) as keep..., hits, density."""
    return docs.select(*keep, found_in(docs.sparkSession, lex)("text").alias("_found")).select(*keep, "_found.*")


def chance(lex: Lexicon, found: Column) -> Column:
    """The score of a density."""
    a, b = lex.curve
    return 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * found)))


def score(docs: DataFrame, lex: Lexicon, keep: list[str]) -> DataFrame:
    """docs(keep..., text) as keep..., hits, score."""
    return densities(docs, lex, keep).select(*keep, "hits", chance(lex, F.col("density")).alias("score"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = 20_000) -> DataFrame:
    """The documents that score below threshold, with all their columns. labels(doc_id, label)."""
    lex = learn(docs, labels, max_rows)
    return docs.where(chance(lex, found_in(docs.sparkSession, lex)("text")["density"]) < threshold)


def training_labels(labels: DataFrame, column: str, folds: int, held_out: int) -> DataFrame:
    return labels.where(F.expr(f"crc32(encode(cast(doc_id as string), 'UTF-8')) % {folds} <> {held_out}")).select("doc_id", F.col(column).alias("label"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document's toxicity score."""
    docs = table(spark, sf_dir, "documents")
    lex = learn(docs, training_labels(table(spark, sf_dir, "labels"), "toxic", 3, 1))
    held = F.expr("coalesce(crc32(encode(cast(doc_id as string), 'UTF-8')) % 3 = 1, false)").alias("held_out")
    return score(docs, lex, ["doc_id"]).select("doc_id", held, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "hits")
