"""Queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from . import byte_cnn, license_index, minhash_join, pfor_store, pii, piece_codec, pivot_index, poisson_mix, quality_rules, rank_routing, suffix_dedup, tiered_search, two_pass_shuffle

QUERIES = {
    "op1_license_scan": license_index.op1_license_scan,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_byte_cnn": byte_cnn.op3_byte_cnn,
    "op4_pii": pii.op4_pii,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_pivot_index": pivot_index.op6_pivot_index,
    "op7_poisson_mix": poisson_mix.op7_poisson_mix,
    "op8_minhash_join": minhash_join.op8_minhash_join,
    "op9_piece_codec": piece_codec.op9_piece_codec,
    "op10_pfor_store": pfor_store.op10_pfor_store,
    "op11_two_pass_shuffle": two_pass_shuffle.op11_two_pass_shuffle,
    "op12_tiered_search": tiered_search.op12_tiered_search,
    "op13_rank_routing": rank_routing.op13_rank_routing,
}
SQL = {
    "op1_license_scan": license_index.sql(),
    "op4_pii": pii.sql(),
    "op5_quality_rules": quality_rules.sql(),
    "op6_pivot_index": pivot_index.SQL,
    "op7_poisson_mix": poisson_mix.SQL,
    "op8_minhash_join": minhash_join.SQL,
    "op11_two_pass_shuffle": two_pass_shuffle.SQL,
    "op12_tiered_search": tiered_search.SQL,
    "op13_rank_routing": rank_routing.SQL,
}
