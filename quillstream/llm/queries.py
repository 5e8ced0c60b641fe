"""The registered queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstream.llm import ann, bpe, chat, langid, licenses, mixing, pii, quality, simhash, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [mixing.op1_mixing, ann.op2_nearest, chat.op3_chat_format, langid.op4_language_id, pii.op5_pii, licenses.op6_license_scan, quality.op7_quality_rules, simhash.op8_simhash, bpe.op9_byte_bpe, toxicity.op10_toxicity]
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.OP1_SQL, "op3_chat_format": chat.OP3_SQL, "op6_license_scan": licenses.OP6_SQL}
