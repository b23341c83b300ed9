"""Queries of this subpackage, with their SQL where SQL can say the same."""

from __future__ import annotations

from . import bpe, chat, decontaminate, language, middle, mixing, negatives, neighbours, quality, simhash, substrings, tokens, urls

QUERIES = {
    "op1_urls": urls.op1_urls,
    "op2_language": language.op2_language,
    "op3_chat": chat.op3_chat,
    "op4_tokens": tokens.op4_tokens,
    "op5_substrings": substrings.op5_substrings,
    "op6_quality": quality.op6_quality,
    "op7_neighbours": neighbours.op7_neighbours,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_simhash": simhash.op9_simhash,
    "op10_mixing": mixing.op10_mixing,
    "op11_middle": middle.op11_middle,
    "op12_bpe": bpe.op12_bpe,
    "op13_negatives": negatives.op13_negatives,
}
SQL = {"op1_urls": urls.op1_sql(), "op5_substrings": substrings.op5_sql(), "op8_decontaminate": decontaminate.op8_sql(),
    "op11_middle": middle.op11_sql(), "op13_negatives": negatives.op13_sql()}
