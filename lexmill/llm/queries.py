"""The queries of the corpus operators, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, interactions, language, minhash, phrases, pii, quality, simhash, suffixes, toxicity, tries, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_spaced_seeds": decontaminate.query,
    "op2_tokeniser_fertility": quality.query,
    "op3_warc_capture_index": warc.query,
    "op4_word_crf": language.query,
    "op5_backtracking_bpe": bpe.query,
    "op6_phrase_automata": phrases.query,
    "op7_suffix_array_levels": suffixes.query,
    "op8_bootstrapped_contexts": pii.query,
    "op9_block_max_neighbours": toxicity.query,
    "op10_simhash_deletion_variants": simhash.query,
    "op11_multi_index_hamming": minhash.query,
    "op12_lcp_cartesian_tree": tries.query,
    "op13_subset_zeta": interactions.query,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc_capture_index": warc.ORACLE_SQL,
    "op11_multi_index_hamming": minhash.ORACLE_SQL,
    "op12_lcp_cartesian_tree": tries.ORACLE_SQL,
    "op13_subset_zeta": interactions.ORACLE_SQL,
}
