"""The registered queries of this package, with SQL where SQL can express them."""

from __future__ import annotations

from corpusframe.llm import collocations, decontaminate, importance, jaccard, language, lines, matroska, mixing, quality, repair, separators, substrings, urls

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_substrings": substrings.op2_substrings,
    "op3_matroska": matroska.op3_matroska,
    "op4_repair": repair.op4_repair,
    "op5_lines": lines.op5_lines,
    "op6_token_counts": separators.op6_token_counts,
    "op7_mix": mixing.op7_mix,
    "op8_quality": quality.op8_quality,
    "op9_jaccard": jaccard.op9_jaccard,
    "op10_urls": urls.op10_urls,
    "op11_importance": importance.op11_importance,
    "op12_collocations": collocations.op12_collocations,
    "op13_language": language.op13_language,
}
ORACLE_SQL = {"op2_substrings": substrings.ORACLE_SQL, "op9_jaccard": jaccard.ORACLE_SQL, "op11_importance": importance.ORACLE_SQL, "op12_collocations": collocations.ORACLE_SQL}
