"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import agenda, bpe, chat, compression, decontaminate, exact_dedup, fill_middle, merkle, order_minhash, pii, sharding, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": compression.op1_quality,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_near_dedup": order_minhash.op3_near_dedup,
        "op4_bpe": bpe.op4_bpe,
        "op5_chat_format": chat.op5_chat_format,
        "op6_language_id": compression.op6_language_id,
        "op7_personal_data": pii.op7_personal_data,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_hilbert_sharding": sharding.op9_hilbert_sharding,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "op11_fill_middle": fill_middle.op11_fill_middle,
        "op12_merkle": merkle.op12_merkle,
        "op13_sentencepiece": agenda.op13_sentencepiece,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": exact_dedup.ORACLE_SQL, "op10_decontaminate": decontaminate.ORACLE_SQL, "op11_fill_middle": fill_middle.ORACLE_SQL, "op12_merkle": merkle.ORACLE_SQL}
