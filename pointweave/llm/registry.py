"""Queries of this subpackage and their SQL."""

from . import brown, decontaminate, html, language, licenses, neighbours, packing, simhash, tokens, urls

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_nearest_neighbours": neighbours.op2_nearest_neighbours,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_lm_scoring": brown.op5_lm_scoring,
    "op6_html_extraction": html.op6_html_extraction,
    "op7_language_id": language.op7_language_id,
    "op8_packing": packing.op8_packing,
    "op9_token_counts": tokens.op9_token_counts,
    "op10_url_filter": urls.op10_url_filter,
}
SQL = {"op10_url_filter": urls.OP10_SQL}
