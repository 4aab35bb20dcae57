"""The registered queries of this subpackage, and their DuckDB statements."""

from __future__ import annotations

from parley.llm.language_id import op9_language_id
from parley.llm.licences import op7_licences
from parley.llm.mixing import op5_mixing
from parley.llm.prefix_trie import op12_prefix_trie
from parley.llm.pseudonyms import op3_pseudonyms
from parley.llm.quality_classifier import op1_quality_classifier
from parley.llm.quality_rules import op10_quality_rules
from parley.llm.role_repair import op6_role_repair
from parley.llm.sentence_pieces import op8_sentence_pieces
from parley.llm.simhash import op2_simhash
from parley.llm.suffix_dedup import op11_suffix_dedup
from parley.llm.weighted_sampling import op4_weighted_sampling
from parley.llm.whitening import op13_embedding_whitening

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_simhash": op2_simhash,
    "op3_pseudonyms": op3_pseudonyms,
    "op4_weighted_sampling": op4_weighted_sampling,
    "op5_mixing": op5_mixing,
    "op6_role_repair": op6_role_repair,
    "op7_licences": op7_licences,
    "op8_sentence_pieces": op8_sentence_pieces,
    "op9_language_id": op9_language_id,
    "op10_quality_rules": op10_quality_rules,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLE: dict[str, str] = {}
