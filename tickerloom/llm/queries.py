"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from tickerloom.llm import (
    chat,
    count_tree,
    host_rules,
    kneser_ney,
    language,
    packing,
    phrases,
    pieces,
    pii,
    prefix_trie,
    simhash,
    weak_labels,
    weighted_prints,
)

QUERIES = {
    "op1_chat_perspectives": chat.op1_chat_perspectives,
    "op2_bestfit_packing": packing.op2_bestfit_packing,
    "op3_host_quality_rules": host_rules.op3_host_quality_rules,
    "op4_simhash_covering": simhash.op4_simhash_covering,
    "op5_sentencepiece_viterbi": pieces.op5_sentencepiece_viterbi,
    "op6_pii_spans": pii.op6_pii_spans,
    "op7_weak_label_quality": weak_labels.op7_weak_label_quality,
    "op8_centroid_language": language.op8_centroid_language,
    "op9_kneser_ney": kneser_ney.op9_kneser_ney,
    "op10_cws_fingerprints": weighted_prints.op10_cws_fingerprints,
    "op11_prefix_free_phrases": phrases.op11_prefix_free_phrases,
    "op12_count_vector_rtree": count_tree.op12_count_vector_rtree,
    "op13_time_forward_trie": prefix_trie.op13_time_forward_trie,
}
ORACLES = {
    "op1_chat_perspectives": chat.ORACLE_OP1,
    "op3_host_quality_rules": host_rules.ORACLE_OP3,
    "op11_prefix_free_phrases": phrases.ORACLE_OP11,
    "op13_time_forward_trie": prefix_trie.ORACLE_OP13,
}
