"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from marginalia.llm import ann, chat, exact, linedup, mixture, packing, planes, quality, simhash, toxicity


def queries() -> dict:
    return {
        "op1_simhash": simhash.query,
        "op2_posting_lists": ann.query,
        "op3_bit_planes": planes.query,
        "op4_line_dedup": linedup.query,
        "op5_chat_format": chat.query,
        "op6_mixture": mixture.query,
        "op7_quality": quality.query,
        "op8_packing": packing.query,
        "op9_toxicity": toxicity.query,
        "op10_exact_dedup": exact.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_format": chat.SQL, "op10_exact_dedup": exact.SQL}
