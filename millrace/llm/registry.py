"""The queries of this subpackage, and SQL where it can express them."""

from . import bpe, counts, media, ngram_join, packing, pii, pii_sql, sharding, suffix_dedup, topk, toxicity

QUERIES = {
    "op1_exact_top_k": topk.query,
    "op2_media_columns": media.query,
    "op3_packing": packing.query,
    "op4_bpe_automaton": bpe.query,
    "op5_ngram_join": ngram_join.query,
    "op6_toxicity": toxicity.query,
    "op7_pii_disclosure": pii.query,
    "op8_sharding": sharding.query,
    "op9_token_counts": counts.query,
    "op10_suffix_dedup": suffix_dedup.query,
}
ORACLE_SQL = {"op1_exact_top_k": topk.SQL, "op7_pii_disclosure": pii_sql.SQL}
