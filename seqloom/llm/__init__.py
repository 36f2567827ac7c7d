"""Operations of a training-data pipeline, each a DataFrame-to-DataFrame function."""

from __future__ import annotations

from . import bpe, chat, exact_dedup, fill_in_middle, language_id, line_dedup, mixing, near_dedup, pii, topk, url_filter, warc_revisit, whitening


def queries() -> dict:
    return {
        "op1_bpe": bpe.op1,
        "op2_top_k": topk.op2,
        "op3_pii": pii.op3,
        "op4_chat": chat.op4,
        "op5_language_id": language_id.op5,
        "op6_url_filters": url_filter.op6,
        "op7_near_dedup": near_dedup.op7,
        "op8_warc_revisits": warc_revisit.op8,
        "op9_mixing": mixing.op9,
        "op10_exact_dedup": exact_dedup.op10,
        "op11_fill_in_middle": fill_in_middle.op11,
        "op12_whitening": whitening.op12,
        "op13_line_dedup": line_dedup.op13,
    }


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express."""
    return {
        "op2_top_k": topk.OP2_SQL,
        "op4_chat": chat.OP4_SQL,
        "op6_url_filters": url_filter.OP6_SQL,
        "op8_warc_revisits": warc_revisit.OP8_SQL,
        "op9_mixing": mixing.OP9_SQL,
        "op10_exact_dedup": exact_dedup.OP10_SQL,
        "op11_fill_in_middle": fill_in_middle.OP11_SQL,
        "op13_line_dedup": line_dedup.OP13_SQL,
    }
