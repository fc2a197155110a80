"""Queries and oracle SQL of the corpus operators."""

from .conversations import op11_conversation_repair
from .decontaminate import op1_decontamination
from .fingerprints import op6_fingerprints
from .jaccard_join import op5_ngram_jaccard
from .maxent_lm import op4_lm_scoring
from .merkle import op12_merkle_manifest
from .oracle import ORACLE_SQL
from .packing import op9_packing
from .quality import op7_quality
from .rlz_dedup import op2_substring_dedup
from .sharding import op10_sharding
from .suffix_dedup import op8_suffix_dedup
from .token_counts import op3_token_counts
from .warc import op13_warc

QUERIES = {f.__name__: f for f in (op1_decontamination, op2_substring_dedup, op3_token_counts, op4_lm_scoring, op5_ngram_jaccard, op6_fingerprints, op7_quality, op8_suffix_dedup, op9_packing, op10_sharding, op11_conversation_repair, op12_merkle_manifest, op13_warc)}

__all__ = ["ORACLE_SQL", "QUERIES"]
