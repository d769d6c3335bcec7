"""Queries of the subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from txnrules.llm import alignment, bpe, decontaminate, html_text, jaccard_join, language_id, line_dedup, packing, quality_classifier, quality_rules, secrets_scan, sharding, whitening


def queries():
    return {
        "op1_ngram_decontamination": decontaminate.op1_ngram_decontamination,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_text_density": html_text.op3_text_density,
        "op4_grammar_inference": secrets_scan.op4_grammar_inference,
        "op5_bayesian_jaccard": jaccard_join.op5_bayesian_jaccard,
        "op6_virtual_slots": sharding.op6_virtual_slots,
        "op7_transducer_bpe": bpe.op7_transducer_bpe,
        "op8_random_indexing": quality_classifier.op8_random_indexing,
        "op9_kneser_ney": language_id.op9_kneser_ney,
        "op10_host_rules": quality_rules.op10_host_rules,
        "op11_merge_path_alignment": alignment.op11_merge_path_alignment,
        "op12_bit_sliced_whitening": whitening.op12_bit_sliced_whitening,
        "op13_vector_packing": packing.op13_vector_packing,
    }


def oracle_sql():
    return {"op1_ngram_decontamination": decontaminate.OP1_SQL, "op10_host_rules": quality_rules.OP10_SQL}
