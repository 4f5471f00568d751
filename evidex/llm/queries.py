"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidex.llm import ann, bytebpe, decontaminate, langid, lexical, packing, quality_model, rules, secrets, simhash, tokenfile, urlfilter, whitening

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_secret_scan": secrets.op1,
        "op2_simhash_near_dups": simhash.op2,
        "op3_multi_index_hashing": ann.op3,
        "op4_quality_classifier": quality_model.op4,
        "op5_simple8b_files": tokenfile.op5,
        "op6_url_filter": urlfilter.op6,
        "op7_byte_bpe": bytebpe.op7,
        "op8_packing": packing.op8,
        "op9_language_id": langid.op9,
        "op10_quality_rules": rules.op10,
        "op11_lexical_search": lexical.op11,
        "op12_decontamination": decontaminate.op12,
        "op13_whitening": whitening.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filter": urlfilter.OP6_SQL, "op11_lexical_search": lexical.OP11_SQL, "op12_decontamination": decontaminate.OP12_SQL}
