"""The queries of this subpackage, and the SQL of those that SQL can express on whole tables."""

from .bpe import op9_bpe
from .decontaminate import OP10_SQL, op10_decontaminate
from .langid import op8_language
from .lm_score import op5_lm_score
from .merkle import OP11_SQL, op11_merkle
from .perplexity import op13_rules
from .pii import op7_pii
from .prefix_hash import op3_fingerprints
from .quality import op1_quality
from .repair import op12_repair
from .simhash import op2_simhash
from .token_counts import op6_token_counts
from .toxicity import op4_toxicity

QUERIES = {
    "op1_quality": op1_quality,
    "op2_simhash": op2_simhash,
    "op3_fingerprints": op3_fingerprints,
    "op4_toxicity": op4_toxicity,
    "op5_lm_score": op5_lm_score,
    "op6_token_counts": op6_token_counts,
    "op7_pii": op7_pii,
    "op8_language": op8_language,
    "op9_bpe": op9_bpe,
    "op10_decontaminate": op10_decontaminate,
    "op11_merkle": op11_merkle,
    "op12_repair": op12_repair,
    "op13_rules": op13_rules,
}

ORACLE_SQL = {
    "op10_decontaminate": OP10_SQL,
    "op11_merkle": OP11_SQL,
}
