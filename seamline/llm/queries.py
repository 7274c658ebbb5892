"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import bpe, chat, dedup, jaccard, lexical, mixing, phrases, pii, planes, quality, secrets, sharding, topk

QUERIES = {
    "op1_pfair_mix": mixing.op1_pfair_mix,
    "op2_surrogate_pii": pii.op2_surrogate_pii,
    "op3_differencing_shards": sharding.op3_differencing_shards,
    "op4_run_length_dedup": dedup.op4_run_length_dedup,
    "op5_divergence_quality": quality.op5_divergence_quality,
    "op6_merge_replay_bpe": bpe.op6_merge_replay_bpe,
    "op7_sparse_product_jaccard": jaccard.op7_sparse_product_jaccard,
    "op8_snapshot_chat": chat.op8_snapshot_chat,
    "op9_taat_topk": topk.op9_taat_topk,
    "op10_markov_secrets": secrets.op10_markov_secrets,
    "op11_pair_naming_phrases": phrases.op11_pair_naming_phrases,
    "op12_bit_plane_ids": planes.op12_bit_plane_ids,
    "op13_threshold_seeded_search": lexical.op13_threshold_seeded_search,
}
SQL = {"op8_snapshot_chat": chat.OP8_SQL, "op9_taat_topk": topk.OP9_SQL, "op11_pair_naming_phrases": phrases.OP11_SQL, "op13_threshold_seeded_search": lexical.OP13_SQL}
