"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from tabulon.llm import decontaminate, language, lm, neighbors, packing, quality, repeats, sharding, simhash, warc

QUERIES = {
    "op1_sharding": sharding.query,
    "op2_quality": quality.query,
    "op3_packing": packing.query,
    "op4_neighbors": neighbors.query,
    "op5_simhash": simhash.query,
    "op6_decontaminate": decontaminate.query,
    "op7_suffix_dedup": repeats.query,
    "op8_language": language.query,
    "op9_lm": lm.query,
    "op10_warc": warc.query,
    # What SQL can check of op1 and op9.
    "shard_totals": sharding.totals,
    "lm_base_scores": lm.base_scores,
}

ORACLES = {
    "op6_decontaminate": decontaminate.ORACLE_SQL,
    "op7_suffix_dedup": repeats.ORACLE_SQL,
    "op10_warc": warc.ORACLE_SQL,
    "shard_totals": sharding.TOTALS_SQL,
    "lm_base_scores": lm.BASE_SQL,
}
