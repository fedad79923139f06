"""A training corpus from raw documents, in five stages. Each stage takes all that the one before kept.

Toxic documents go first, then those that the quality rules reject; of lines that repeat each other, exactly or nearly, one
stays, and a document that has no line left goes; of documents that are near copies, one stays; what remains is packed.

Line dedup leaves a near copy only the lines that differ from its original's, too little to be known by, so the join knows each
document by its text as it came, too. Of each group of lines that repeat each other one is still there after line dedup.

Columns named like documents' own are expected (doc_id, text, lang, source); others are passed on unread. Each stage handles
nulls, empty tables, repeated rows and long texts as its operator's docstring says. What a stage is given must have been written:
scratch tables of the stage before are dropped as the next one begins.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import jaccard, lines, outliers, packing, toxicity
from touchline.llm.common import finished, release, scratch_made, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Scratch tables that the last stage made.
_left: set[str] = set()


def stage(work: Stage) -> Stage:
    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(_left, reading=docs)
        before = scratch_made()
        out = work(spark, docs, sf_dir)
        _left.clear()
        _left.update(scratch_made() - before)
        return out

    return run_stage


@stage
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from labels.toxic, scores below 0.7."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")))


@stage
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and aren't outliers of their language and source."""
    return outliers.clean(docs)


@stage
def once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that earlier ones repeat. Those that lose their last line with a word go."""
    thinned = lines.dedup(docs, lines="_n_lines", removed="_n_removed")
    whole = thinned.where((F.col("_n_removed") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    chars = [F.when(F.col("_n_removed") == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return whole.select(*chars)


@stage
def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by word-shingle similarity of 0.8 or more, of texts as they are or as they came."""
    try:
        also = table(spark, sf_dir, "documents")
    except AnalysisException as e:  # a folder without the raw table: documents are known by their texts as they are
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        also = None
    return jaccard.thin_out(docs, also=also)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, neighbours on the curve together."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, keep_ids=False)


STAGES = [("toxicity", toxic), ("quality rules", rules), ("line dedup", once), ("n-gram join", apart), ("packing", packed)]

#: The learned lexicon, the robust estimates and tokenisation have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, work) in enumerate(STAGES):
        before, docs = docs, written(work(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        if i:
            finished(before)
    release(_left, reading=docs)
    _left.clear()
    return docs
