"""Queries of the training-data operators and their DuckDB SQL."""

from .archives import OP11_SQL, op11_warc_histories
from .centroids import OP13_SQL, op13_centroid_clusters
from .decontaminate import OP4_SQL, op4_decontamination
from .language import op2_language_id
from .minhash import op9_minhash_dedup
from .packing import op7_best_fit_packing
from .prefixes import OP12_SQL, op12_conversation_trie
from .private import op10_surrogates
from .quality import OP5_SQL, op5_quality_rules
from .repeats import op8_repeated_bytes
from .scoring import op1_lm_scores
from .tokens import op6_token_counts
from .urls import OP3_SQL, op3_url_filter

QUERIES = {
    "op1_lm_scores": op1_lm_scores,
    "op2_language_id": op2_language_id,
    "op3_url_filter": op3_url_filter,
    "op4_decontamination": op4_decontamination,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_counts": op6_token_counts,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_repeated_bytes": op8_repeated_bytes,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_surrogates": op10_surrogates,
    "op11_warc_histories": op11_warc_histories,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_centroid_clusters": op13_centroid_clusters,
}
ORACLE_SQL = {
    "op3_url_filter": OP3_SQL,
    "op4_decontamination": OP4_SQL,
    "op5_quality_rules": OP5_SQL,
    "op11_warc_histories": OP11_SQL,
    "op12_conversation_trie": OP12_SQL,
    "op13_centroid_clusters": OP13_SQL,
}
