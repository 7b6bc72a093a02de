"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat_format, decontaminate, jaccard_join, mixing, nearest, pii, quality, ranked_search, resampling, secret_scan, url_filter, warc, webp

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_quality": quality.op2_quality,
    "op3_chat_format": chat_format.op3_chat_format,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op6_webp_media": webp.op6_webp_media,
    "op7_mixing": mixing.op7_mixing,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_pii": pii.op9_pii,
    "op10_warc": warc.op10_warc,
    "op11_nearest": nearest.op11_nearest,
    "op12_resampling": resampling.op12_resampling,
    "op13_ranked_search": ranked_search.op13_ranked_search,
    "mixing_passes": mixing.mixing_passes,
    "secret_redaction": secret_scan.secret_redaction,
}
SQL = {
    "op1_url_filter": url_filter.OP1_SQL,
    "op3_chat_format": chat_format.OP3_SQL,
    "op4_jaccard_join": jaccard_join.OP4_SQL,
    "op5_secret_scan": secret_scan.OP5_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op8_decontaminate": decontaminate.OP8_SQL,
    "op9_pii": pii.OP9_SQL,
    "op10_warc": warc.OP10_SQL,
    "op12_resampling": resampling.OP12_SQL,
    "op13_ranked_search": ranked_search.OP13_SQL,
    "mixing_passes": mixing.PASSES_SQL,
    "secret_redaction": secret_scan.REDACTION_SQL,
}
