"""The corpus queries, one for each operator, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import collocations, fingerprints, jaccard, language, licenses, merkle, mixing, packing, pieces, quality, topk, toxicity, urls
from tracewell.session import share_code

Query = Callable[[SparkSession, str], DataFrame]


def _shared(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        share_code(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    found = [
        language.op1_language_id,
        jaccard.op2_jaccard_join,
        toxicity.op3_toxicity,
        fingerprints.op4_fingerprints,
        pieces.op5_sentencepiece,
        licenses.op6_license_scan,
        urls.op7_url_filter,
        quality.op8_quality,
        mixing.op9_mixing,
        topk.op10_topk,
        packing.op11_packing,
        merkle.op12_merkle,
        collocations.op13_collocations,
    ]
    return {f.__name__: _shared(f) for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_jaccard_join": jaccard.JACCARD_SQL,
        "op9_mixing": mixing.MIXING_SQL,
        "op10_topk": topk.TOPK_SQL,
        "op12_merkle": merkle.MERKLE_SQL,
        "op13_collocations": collocations.COLLOCATIONS_SQL,
    }
