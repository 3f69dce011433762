"""Queries of this subpackage by name, and the DuckDB SQL of those that SQL expresses in reasonable time."""

from __future__ import annotations

from . import mixing, neighbours, pieces, quality, sharding, simhash, substrings, token_shards, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_toxicity_factors": toxicity.op2_toxicity_factors,
    "op3_rendezvous_sharding": sharding.op3_rendezvous_sharding,
    "op4_token_shards": token_shards.op4_token_shards,
    "op5_super_kmers": substrings.op5_super_kmers,
    "op6_gumbel_pieces": pieces.op6_gumbel_pieces,
    "op7_quality_cascade": quality.op7_quality_cascade,
    "op8_simhash": simhash.op8_simhash,
    "op9_mixing": mixing.op9_mixing,
    "op10_block_neighbours": neighbours.op10_block_neighbours,
}

ORACLE_SQL = {
    "op1_warc": warc.SQL,
    "op3_rendezvous_sharding": sharding.SQL,
    "op5_super_kmers": substrings.SQL,
    "op7_quality_cascade": quality.SQL,
    "op9_mixing": mixing.SQL,
    "op10_block_neighbours": neighbours.SQL,
}
