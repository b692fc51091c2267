"""The operators as queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from adcorpus.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from adcorpus.llm.fingerprints import op7_spotsigs
from adcorpus.llm.lexical import OP13_SQL, op13_ranked_search
from adcorpus.llm.licenses import OP10_SQL, op10_licenses
from adcorpus.llm.line_dedup import OP4_SQL, op4_line_dedup
from adcorpus.llm.mixing import OP2_SQL, op2_mixing
from adcorpus.llm.near_dup import OP5_SQL, op5_minhash_near_dedup
from adcorpus.llm.packing import op8_best_fit_packing
from adcorpus.llm.pii import op1_pii
from adcorpus.llm.quality import OP11_SQL, op11_quality_rules
from adcorpus.llm.secrets import op9_secrets
from adcorpus.llm.toxicity import op3_toxicity
from adcorpus.llm.tries import OP12_SQL, op12_prefix_trie

QUERIES = {
    "op1_pii": op1_pii,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_spotsigs": op7_spotsigs,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_secrets": op9_secrets,
    "op10_licenses": op10_licenses,
    "op11_quality_rules": op11_quality_rules,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_ranked_search": op13_ranked_search,
}

ORACLE = {
    "op2_mixing": OP2_SQL,
    "op4_line_dedup": OP4_SQL,
    "op5_minhash_near_dedup": OP5_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op10_licenses": OP10_SQL,
    "op11_quality_rules": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_ranked_search": OP13_SQL,
}
