"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from kvloom.llm import bpe, filter_audit, fim, jaccard_join, language, line_dedup, mixing, mtree, quantized_search, repeats, sstable, toxicity, warc

QUERIES = {
    "op1_mtree_topk": mtree.op1,
    "op2_sstable_output": sstable.op2,
    "op3_quantized_ann": quantized_search.op3,
    "op4_bpe": bpe.op4,
    "op5_mixing": mixing.op5,
    "op6_language_id": language.op6,
    "op7_toxicity": toxicity.op7,
    "op8_jaccard_join": jaccard_join.op8,
    "op9_repeat_removal": repeats.op9,
    "op10_line_dedup": line_dedup.op10,
    "op11_warc": warc.op11,
    "op12_filter_audit": filter_audit.op12,
    "op13_fill_in_middle": fim.op13,
}
SQL = {"op1_mtree_topk": mtree.SQL, "op8_jaccard_join": jaccard_join.SQL, "op5_mixing": mixing.SQL, "op10_line_dedup": line_dedup.SQL,
       "op11_warc": warc.SQL, "op12_filter_audit": filter_audit.SQL, "op13_fill_in_middle": fim.SQL}
