"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from ribolens.llm.bpe import op12_byte_bpe
from ribolens.llm.context_tree import op4_context_tree
from ribolens.llm.decontamination import OP1_SQL, op1_decontamination
from ribolens.llm.filter_audit import OP13_SQL, op13_filter_audit
from ribolens.llm.line_dedup import OP2_SQL, op2_line_dedup
from ribolens.llm.merkle import OP11_SQL, op11_merkle_manifest
from ribolens.llm.near_dedup import op9_near_dedup
from ribolens.llm.neighbours import OP5_SQL, op5_neighbours
from ribolens.llm.packing import op10_best_fit_packing
from ribolens.llm.quality import op3_quality
from ribolens.llm.sharding import OP7_SQL, op7_sharding
from ribolens.llm.token_counts import op6_token_counts
from ribolens.llm.warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality": op3_quality,
    "op4_context_tree": op4_context_tree,
    "op5_neighbours": op5_neighbours,
    "op6_token_counts": op6_token_counts,
    "op7_sharding": op7_sharding,
    "op8_warc": op8_warc,
    "op9_near_dedup": op9_near_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": OP1_SQL,
    "op2_line_dedup": OP2_SQL,
    "op5_neighbours": OP5_SQL,
    "op7_sharding": OP7_SQL,
    "op8_warc": OP8_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op13_filter_audit": OP13_SQL,
}
