"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from millrace.llm import compression, exact_dedup, hard_negatives, licences, line_dedup, merkle, mixing, ngram_join, pieces, quality, suffix_dedup, surrogates, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_surrogates": surrogates.op8_surrogates,
    "op9_licence_scan": licences.op9_licence_scan,
    "op10_quality": quality.op10_quality,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_compression_quality": compression.op13_compression_quality,
}
ORACLES = {**exact_dedup.SQL, **hard_negatives.SQL, **line_dedup.SQL, **merkle.SQL, **mixing.SQL}
