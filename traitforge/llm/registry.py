"""Queries of the training-data operators and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from . import bpe, decontaminate, embeddings, fixity, language, minhash, preference, quality, recompress, repair, resample, suffix_dedup, toxicity

QUERIES = {
    "op1_merkle_fixity": fixity.op1_merkle_fixity,
    "op2_benchmark_decontamination": decontaminate.op2_benchmark_decontamination,
    "op3_suffix_array_dedup": suffix_dedup.op3_suffix_array_dedup,
    "op4_preference_pairs": preference.op4_preference_pairs,
    "op5_compression_quality": quality.op5_compression_quality,
    "op6_pruned_graph": embeddings.op6_pruned_graph,
    "op7_bpe_speculate_verify": bpe.op7_bpe_speculate_verify,
    "op8_crf_language": language.op8_crf_language,
    "op9_minhash_hamming_join": minhash.op9_minhash_hamming_join,
    "op10_tfidf_toxicity": toxicity.op10_tfidf_toxicity,
    "op11_crc_resampling": resample.op11_crc_resampling,
    "op12_recompression_dedup": recompress.op12_recompression_dedup,
    "op13_conversation_repair": repair.op13_conversation_repair,
}

ORACLE_SQL = {
    "op1_merkle_fixity": fixity.OP1_SQL,
    "op4_preference_pairs": preference.OP4_SQL,
    "op6_pruned_graph": embeddings.OP6_SQL,
    "op9_minhash_hamming_join": minhash.OP9_SQL,
    "op2_benchmark_decontamination": decontaminate.OP2_SQL,
    "op11_crc_resampling": resample.OP11_SQL,
    "op12_recompression_dedup": recompress.OP12_SQL,
    "op13_conversation_repair": repair.OP13_SQL,
}
