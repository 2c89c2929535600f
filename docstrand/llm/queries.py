"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docstrand.llm.op3_bpe import op3_bpe
from docstrand.llm import op4_urls
from docstrand.llm.op1_ann import op1_cross_polytope
from docstrand.llm.op2_vector_dedup import op2_sorted_passes
from docstrand.llm.op10_quality import op10_quality
from docstrand.llm.op5_minhash import op5_minhash
from docstrand.llm.op6_token_counts import op6_token_counts
from docstrand.llm.op7_bestfit import op7_best_fit
from docstrand.llm.op8_language import op8_language
from docstrand.llm.op9_packing import op9_power_of_two


def _on(table: str, f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_cross_polytope": _on("embeddings", op1_cross_polytope),
        "op2_sorted_passes": _on("embeddings", op2_sorted_passes),
        "op3_bpe": _on("documents", op3_bpe),
        "op4_host_reputation": lambda spark, d: op4_urls.op4_host_reputation(spark.read.parquet(f"{d}/pages.parquet"), spark.read.parquet(f"{d}/labels.parquet")),
        "op5_minhash": _on("documents", op5_minhash),
        "op6_token_counts": _on("documents", op6_token_counts),
        "op7_best_fit": _on("documents", op7_best_fit),
        "op8_language": _on("documents", op8_language),
        "op9_power_of_two": _on("documents", op9_power_of_two),
        "op10_quality": lambda spark, d: op10_quality(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_host_reputation": op4_urls.oracle()}
