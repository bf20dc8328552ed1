"""Queries and SQL of the training-data operators, as ``__spark_entry__`` adds them.

Operators that SQL cannot express have no SQL; their tests hold them against brute force.
"""

from __future__ import annotations

from ondula.llm import op1_pareto_mix as o1
from ondula.llm import op2_bin_completion as o2
from ondula.llm import op3_host_rules as o3
from ondula.llm import op4_cross_entropy as o4
from ondula.llm import op5_line_runs as o5
from ondula.llm import op6_trie_counts as o6
from ondula.llm import op7_count_rtree as o7
from ondula.llm import op8_secret_scan as o8
from ondula.llm import op9_exact_dedup as o9
from ondula.llm import op10_chat_format as o10
from ondula.llm import op11_turn_repair as o11
from ondula.llm import op12_lyndon_runs as o12
from ondula.llm import op13_rank_queue_bpe as o13

QUERIES = {
    "op1_pareto_mix": o1.op1_pareto_mix,
    "op2_bin_completion": o2.op2_bin_completion,
    "op3_host_rules": o3.op3_host_rules,
    "op4_cross_entropy": o4.op4_cross_entropy,
    "op5_line_runs": o5.op5_line_runs,
    "op6_trie_counts": o6.op6_trie_counts,
    "op7_count_rtree": o7.op7_count_rtree,
    "op8_secret_scan": o8.op8_secret_scan,
    "op9_exact_dedup": o9.op9_exact_dedup,
    "op10_chat_format": o10.op10_chat_format,
    "op11_turn_repair": o11.op11_turn_repair,
    "op12_lyndon_runs": o12.op12_lyndon_runs,
    "op13_rank_queue_bpe": o13.op13_rank_queue_bpe,
}
SQL = {"op3_host_rules": o3.SQL, "op5_line_runs": o5.SQL, "op7_count_rtree": o7.SQL, "op9_exact_dedup": o9.SQL, "op10_chat_format": o10.SQL}
