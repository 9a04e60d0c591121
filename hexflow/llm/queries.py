"""The queries of the corpus operators and their SQL, by name."""

from __future__ import annotations

from hexflow.llm import ann, context_tree, decontaminate, html_extract, jaccard_join, line_dedup, pii, sentencepiece_dropout, sharding, spelling, toxicity, urls, whitening

QUERIES = {
    "op1_wu_manber": decontaminate.op1_wu_manber,
    "op2_style_tree": html_extract.op2_style_tree,
    "op3_adaptive_scan": ann.op3_adaptive_scan,
    "op4_bilstm_crf": pii.op4_bilstm_crf,
    "op5_markov_ratio": urls.op5_markov_ratio,
    "op6_pattern_grammar": toxicity.op6_pattern_grammar,
    "op7_heavy_light": jaccard_join.op7_heavy_light,
    "op8_merge_dropout": sentencepiece_dropout.op8_merge_dropout,
    "op9_prefix_filter": line_dedup.op9_prefix_filter,
    "op10_context_tree": context_tree.op10_context_tree,
    "op11_row_matrix": whitening.op11_row_matrix,
    "op12_histogram_sort": sharding.op12_histogram_sort,
    "op13_two_automata": spelling.op13_two_automata,
}

ORACLE_SQL = {
    "op1_wu_manber": decontaminate.OP1_SQL,
    "op7_heavy_light": jaccard_join.OP7_SQL,
    "op9_prefix_filter": line_dedup.OP9_SQL,
    "op13_two_automata": spelling.OP13_SQL,
}
