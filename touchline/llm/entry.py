"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import archive, bitslice, bpe, collocations, contexts, gam, jaccard, lines, outliers, packing, seekable, spelling, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_additive_pairs": gam.query,
    "op2_bit_sliced_top_k": bitslice.query,
    "op3_hilbert_packing": packing.query,
    "op4_content_addressed_warc": archive.query,
    "op5_mcd_outliers": outliers.query,
    "op6_folded_lexicon": toxicity.query,
    "op7_count_vector_join": jaccard.query,
    "op8_seekable_tokens": seekable.query,
    "op9_fuzzy_lines": lines.query,
    "op10_speculative_bpe": bpe.query,
    "op11_trie_spelling": spelling.query,
    "op12_context_tree": contexts.query,
    "op13_suffix_collocations": collocations.query,
}
ORACLES: dict[str, str] = {"op2_bit_sliced_top_k": bitslice.SQL, "op4_content_addressed_warc": archive.SQL, "op13_suffix_collocations": collocations.SQL}
