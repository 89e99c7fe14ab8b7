"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import alignment, decontamination, jaccard, knn, language, line_rules, mixing, packing, quality, repeats, resampling, toxicity, warc


def queries() -> dict:
    own = (
        toxicity.op1_counterfactual_toxicity, line_rules.op2_line_frequency_rules, jaccard.op3_trie_jaccard, quality.op4_fourier_quality,
        repeats.op5_bwt_repeats, language.op6_viterbi_language, mixing.op7_source_mixing, knn.op8_voronoi_knn, packing.op9_min_bin_slack_packing, warc.op10_warc_writer,
        resampling.op11_importance_resampling, decontamination.op12_suffix_automaton, alignment.op13_byte_owner_alignment,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_frequency_rules": line_rules.OP2_SQL, "op7_source_mixing": mixing.OP7_SQL, "op8_voronoi_knn": knn.OP8_SQL, "op10_warc_writer": warc.OP10_SQL, "op12_suffix_automaton": decontamination.OP12_SQL}
