"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from promptledger.llm import (
    bytebpe, chat, decontam, langid, lexical, mix, quality, shards, simhash, spelling, suffixes, topk, urlrules,
)

QUERIES = {
    "op1_decontamination": decontam.op1_decontamination,
    "op2_suffix_dedup": suffixes.op2_suffix_dedup,
    "op3_topk": topk.op3_topk,
    "op4_quality": quality.op4_quality,
    "op5_language": langid.op5_language,
    "op6_hilbert_shards": shards.op6_hilbert_shards,
    "op7_chat_trees": chat.op7_chat_trees,
    "op8_url_rules": urlrules.op8_url_rules,
    "op9_simhash": simhash.op9_simhash,
    "op10_mixing": mix.op10_mixing,
    "op11_byte_bpe": bytebpe.op11_byte_bpe,
    "op12_spelling": spelling.op12_spelling,
    "op13_lexical_search": lexical.op13_lexical_search,
}

CHECKS = {
    "op3_topk": topk.OP3_SQL,
    "op7_chat_trees": chat.OP7_SQL,
    "op8_url_rules": urlrules.OP8_SQL,
    "op10_mixing": mix.OP10_SQL,
    "op12_spelling": spelling.OP12_SQL,
    "op13_lexical_search": lexical.OP13_SQL,
}
