"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from sentrine.llm import line_dedup, mixing, ngram_join, phrases, pieces, quality, repeats, search, tokens, url_filter, vectors

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op1_ngram_links": ngram_join.op1_ngram_links,
    "op2_multi_index": vectors.op2_multi_index,
    "op3_packing": tokens.op3_packing,
    "op4_exact_top_k": vectors.op4_exact_top_k,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_mixing": mixing.op6_mixing,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_token_files": tokens.op8_token_files,
    "op9_quality_votes": quality.op9_quality_votes,
    "op10_repeats": repeats.op10_repeats,
    "op11_ranked_search": search.op11_ranked_search,
    "op12_collocations": phrases.op12_collocations,
    "op13_sentencepiece": pieces.op13_sentencepiece,
}
ORACLES = {
    "op1_ngram_join": ngram_join.OP1_SQL,
    "op4_exact_top_k": vectors.OP4_SQL,
    "op5_url_filter": url_filter.OP5_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
    "op11_ranked_search": search.OP11_SQL,
    "op12_collocations": phrases.OP12_SQL,
}
