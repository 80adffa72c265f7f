"""The queries of the text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import chat_format, decontaminate, fill_in_middle, importance, language_id, lm_score, ngram_join, packing, private_data, quality_mil, quality_rules, token_store, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_score": lm_score.op1,
        "op2_quality_classifier": quality_mil.op2,
        "op3_toxicity": toxicity.op3,
        "op4_token_store": token_store.op4,
        "op5_ngram_join": ngram_join.op5,
        "op6_decontaminate": decontaminate.op6,
        "op7_chat_format": chat_format.op7,
        "op8_best_fit_packing": packing.op8,
        "op9_language_id": language_id.op9,
        "op10_quality_rules": quality_rules.op10,
        "op11_fill_in_middle": fill_in_middle.op11,
        "op12_importance_resampling": importance.op12,
        "op13_private_data": private_data.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_ngram_join": ngram_join.SQL,
        "op6_decontaminate": decontaminate.SQL,
        "op7_chat_format": chat_format.SQL,
        "op11_fill_in_middle": fill_in_middle.SQL,
        "op12_importance_resampling": importance.SQL,
    }
