"""Queries of the corpus operators and, where SQL can express them, their DuckDB SQL."""

from . import alignment, decontaminate, jaccard, language, lexical, lm, neardup, packing, quality, repeats, token_files, topk, url_filter

QUERIES = {
    "op1_near_duplicates": neardup.op1_near_duplicates,
    "op2_language": language.op2_language,
    "op3_packing": packing.op3_packing,
    "op4_token_files": token_files.op4_token_files,
    "op5_quality": quality.op5_quality,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_topk": topk.op7_topk,
    "op8_repeats": repeats.op8_repeats,
    "op9_lm": lm.op9_lm,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_search": lexical.op11_search,
    "op12_align": alignment.op12_align,
    "op13_join": jaccard.op13_join,
}
SQL = {**neardup.SQL, **topk.SQL, **decontaminate.SQL, **repeats.SQL, **lexical.SQL, **jaccard.SQL}
