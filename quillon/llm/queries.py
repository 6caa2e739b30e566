"""The registered queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from .clustering import OP11_SQL, op11_clustering
from .context_tree import op4_lm_scoring
from .decontamination import OP8_SQL, op8_decontamination
from .language import op9_language
from .mixing import op13_mixing
from .packing import op3_packing
from .phrases import OP12_SQL, op12_phrases
from .quality import OP10_SQL, op10_quality_rules
from .sharding import op6_sharding
from .simhash import op2_simhash
from .substrings import OP5_SQL, op5_substring_dedup
from .tokens import op7_token_counts
from .toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash": op2_simhash,
    "op3_packing": op3_packing,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_sharding": op6_sharding,
    "op7_token_counts": op7_token_counts,
    "op8_decontamination": op8_decontamination,
    "op9_language": op9_language,
    "op10_quality_rules": op10_quality_rules,
    "op11_clustering": op11_clustering,
    "op12_phrases": op12_phrases,
    "op13_mixing": op13_mixing,
}
#: The other operators hash, learn or pack in ways that SQL has no words for; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op5_substring_dedup": OP5_SQL,
    "op8_decontamination": OP8_SQL,
    "op10_quality_rules": OP10_SQL,
    "op11_clustering": OP11_SQL,
    "op12_phrases": OP12_SQL,
}
