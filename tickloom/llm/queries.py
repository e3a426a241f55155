"""The queries of this subpackage, by name, and their SQL where SQL can say the same."""

from __future__ import annotations

import corpus_pipeline
from tickloom.llm import bpe, exact_dedup, lm_score, near_dedup, packing, phrases, quality, repeats, secrets, spotsigs, topk, toxicity, whitening


def queries():
    return {
        "op1_noisy_channel": toxicity.op1_noisy_channel,
        "op2_spotsigs": spotsigs.op2_spotsigs,
        "op3_suffix_trees": repeats.op3_suffix_trees,
        "op4_masked_window": lm_score.op4_masked_window,
        "op5_forced_boundary_bpe": bpe.op5_forced_boundary_bpe,
        "op6_bag_minhash": near_dedup.op6_bag_minhash,
        "op7_content_sort": exact_dedup.op7_content_sort,
        "op8_blob_ledger": secrets.op8_blob_ledger,
        "op9_island_packing": packing.op9_island_packing,
        "op10_random_indexing": quality.op10_random_indexing,
        "op11_chebyshev_whitening": whitening.op11_chebyshev_whitening,
        "op12_multikey_phrases": phrases.op12_multikey_phrases,
        "op13_bit_sliced_topk": topk.op13_bit_sliced_topk,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    found = {"op3_suffix_trees": repeats.OP3_SQL, "op7_content_sort": exact_dedup.OP7_SQL, "op8_blob_ledger": secrets.OP8_SQL, "op12_multikey_phrases": phrases.OP12_SQL, "op13_bit_sliced_topk": topk.OP13_SQL}
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
