"""Queries of this subpackage and, where SQL can express them, their SQL."""

from . import (
    op10_html_main_text,
    op11_circulant_minhash,
    op12_shallot_kmeans,
    op13_hard_negatives,
    op1_jaccard_join,
    op2_decontamination,
    op3_token_counts,
    op4_media,
    op5_packing,
    op6_quality,
    op7_line_dedup,
    op8_language_id,
    op9_url_filter,
)

QUERIES = {
    "op1_jaccard_join": op1_jaccard_join.op1_jaccard_join,
    "op2_decontamination": op2_decontamination.op2_decontamination,
    "op3_token_counts": op3_token_counts.op3_token_counts,
    "op4_media": op4_media.op4_media,
    "op5_packing": op5_packing.op5_packing,
    "op6_quality": op6_quality.op6_quality,
    "op7_line_dedup": op7_line_dedup.op7_line_dedup,
    "op8_language_id": op8_language_id.op8_language_id,
    "op9_url_filter": op9_url_filter.op9_url_filter,
    "op10_html_main_text": op10_html_main_text.op10_html_main_text,
    "op11_circulant_minhash": op11_circulant_minhash.op11_circulant_minhash,
    "op12_shallot_kmeans": op12_shallot_kmeans.op12_shallot_kmeans,
    "op13_hard_negatives": op13_hard_negatives.op13_hard_negatives,
}
SQL = {
    "op1_jaccard_join": op1_jaccard_join.SQL,
    "op7_line_dedup": op7_line_dedup.SQL,
    "op9_url_filter": op9_url_filter.SQL,
    "op11_circulant_minhash": op11_circulant_minhash.SQL,
    "op12_shallot_kmeans": op12_shallot_kmeans.SQL,
    "op13_hard_negatives": op13_hard_negatives.SQL,
}
