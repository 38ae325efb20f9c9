"""Queries and SQL of this subpackage, by registered name."""

from __future__ import annotations

from . import ann, convrepair, kdtopk, langid, lm, mixing, phrases, simhash, spm, tokenfiles, toolcalls, urlfilter, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_mixing": mixing.op2_mixing,
    "op3_one_bit_ann": ann.op3_one_bit_ann,
    "op4_kd_topk": kdtopk.op4_kd_topk,
    "op5_simhash": simhash.op5_simhash,
    "op6_lm_scoring": lm.op6_lm_scoring,
    "op7_tool_calls": toolcalls.op7_tool_calls,
    "op8_sentencepiece": spm.op8_sentencepiece,
    "op9_language_id": langid.op9_language_id,
    "op10_url_filters": urlfilter.op10_url_filters,
    "op11_token_files": tokenfiles.op11_token_files,
    "op12_conversation_repair": convrepair.op12_conversation_repair,
    "op13_phrase_collocations": phrases.op13_phrase_collocations,
}

ORACLES = {
    "op1_warc": warc.OP1_SQL,
    "op2_mixing": mixing.OP2_SQL,
    "op4_kd_topk": kdtopk.OP4_SQL,
    "op7_tool_calls": toolcalls.OP7_SQL,
    "op10_url_filters": urlfilter.OP10_SQL,
    "op12_conversation_repair": convrepair.OP12_SQL,
    "op13_phrase_collocations": phrases.OP13_SQL,
}
