"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from cuewright.llm.fertility import op2_tokeniser_fertility
from cuewright.llm.hard_negatives import ORACLE_SQL as NEGATIVES_SQL
from cuewright.llm.hard_negatives import op13_cover_tree
from cuewright.llm.kneser_ney import op8_kneser_ney
from cuewright.llm.language_id import op12_language_bitmask
from cuewright.llm.licences import op1_licence_classifier
from cuewright.llm.line_runs import ORACLE_SQL as LINE_SQL
from cuewright.llm.line_runs import op4_line_suffix_array
from cuewright.llm.near_text import op7_bbit_minhash
from cuewright.llm.near_vectors import op10_collision_counting
from cuewright.llm.private_spans import op3_candidate_boosting
from cuewright.llm.ranked_search import ORACLE_SQL as SEARCH_SQL
from cuewright.llm.ranked_search import op11_shared_term_sets
from cuewright.llm.records import op5_length_delimited_records
from cuewright.llm.soft_mixing import op6_soft_membership
from cuewright.llm.trie_bpe import op9_trie_bpe

QUERIES = {
    "op1_licence_classifier": op1_licence_classifier,
    "op2_tokeniser_fertility": op2_tokeniser_fertility,
    "op3_candidate_boosting": op3_candidate_boosting,
    "op4_line_suffix_array": op4_line_suffix_array,
    "op5_length_delimited_records": op5_length_delimited_records,
    "op6_soft_membership": op6_soft_membership,
    "op7_bbit_minhash": op7_bbit_minhash,
    "op8_kneser_ney": op8_kneser_ney,
    "op9_trie_bpe": op9_trie_bpe,
    "op10_collision_counting": op10_collision_counting,
    "op11_shared_term_sets": op11_shared_term_sets,
    "op12_language_bitmask": op12_language_bitmask,
    "op13_cover_tree": op13_cover_tree,
}

ORACLE_SQL: dict[str, str] = {"op4_line_suffix_array": LINE_SQL, "op11_shared_term_sets": SEARCH_SQL, "op13_cover_tree": NEGATIVES_SQL}
