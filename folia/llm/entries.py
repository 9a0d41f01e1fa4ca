"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontaminate import op4_decontamination
from .html_text import op8_html_text
from .inner_product import OP9_SQL, op9_inner_product
from .katz import op2_katz
from .mixing import OP3_SQL, op3_mixing
from .near_dup import op7_near_dup
from .sharding import op1_sharding
from .tokens import op6_tokens
from .toxicity import op10_toxicity
from .warc import OP5_SQL, op5_warc


def _over(f, *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(*(table(spark, sf_dir, t) for t in tables))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": _over(op1_sharding, "documents"),
        "op2_katz": _over(op2_katz, "documents"),
        "op3_mixing": _over(op3_mixing, "documents"),
        "op4_decontamination": _over(op4_decontamination, "documents", "benchmark"),
        "op5_warc": _over(op5_warc, "pages"),
        "op6_tokens": _over(op6_tokens, "documents"),
        "op7_near_dup": _over(op7_near_dup, "documents"),
        "op8_html_text": _over(op8_html_text, "pages"),
        "op9_inner_product": _over(op9_inner_product, "embeddings"),
        "op10_toxicity": _over(op10_toxicity, "documents", "labels"),
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": OP3_SQL, "op5_warc": OP5_SQL, "op9_inner_product": OP9_SQL}
