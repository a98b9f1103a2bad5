"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from quillstone.llm import decontaminate, exact_dedup, html_extract, language_id, mixing, quality, simhash, substring_dedup, suffix_dedup, warc


def queries() -> dict:
    return {
        "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
        "op2_quality_classifier": quality.op2_quality_classifier,
        "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
        "op4_language_id": language_id.op4_language_id,
        "op5_html_extraction": html_extract.op5_html_extraction,
        "op6_substring_dedup": substring_dedup.op6_substring_dedup,
        "op7_mixing": mixing.op7_mixing,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_warc": warc.op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_suffix_dedup": suffix_dedup.OP3_SQL,
        "op6_substring_dedup": substring_dedup.OP6_SQL,
        "op8_exact_dedup": exact_dedup.OP8_SQL,
        "op9_decontaminate": decontaminate.OP9_SQL,
        "op10_warc": warc.OP10_SQL,
    }
