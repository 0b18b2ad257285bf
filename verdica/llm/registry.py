"""The queries of this subpackage, by name, with production parameters on whole tables."""

from __future__ import annotations

import importlib.util
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    op1_chat_layouts,
    op2_raking,
    op3_string_tiling,
    op4_order_minhash,
    op5_license_scan,
    op6_importance,
    op7_one_permutation,
    op8_token_files,
    op9_host_reputation,
    op10_html_blocks,
)


def _pipeline():
    """The module corpus_pipeline at the top of the repository."""
    if "corpus_pipeline" not in sys.modules:
        spec = importlib.util.spec_from_file_location("corpus_pipeline", Path(__file__).resolve().parents[2] / "corpus_pipeline.py")
        module = importlib.util.module_from_spec(spec)
        sys.modules["corpus_pipeline"] = module
        spec.loader.exec_module(module)
    return sys.modules["corpus_pipeline"]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, written in seven layouts, as canonical turns."""
    return op1_chat_layouts.canonical(op1_chat_layouts.as_records(_read(spark, sf_dir, "conversations")), "conv_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn to the target mix, with weights and probabilities."""
    drawn = op2_raking.sample(_read(spark, sf_dir, "documents"))
    return drawn.withColumns({c: F.round(c, 6) for c in ("weight", "probability")})


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents with the items they cover."""
    return op3_string_tiling.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_order_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each near copy with the document of its group that stays."""
    return op4_order_minhash.duplicates(_read(spark, sf_dir, "documents"))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, its own or its directory's."""
    return op5_license_scan.scan(op5_license_scan.as_files(_read(spark, sf_dir, "documents")))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that importance resampling draws."""
    return op6_importance.sample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document."""
    return op7_one_permutation.fingerprints(_read(spark, sf_dir, "documents"))


def fingerprint_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose fingerprints begin alike, with the estimated similarity to the first of them."""
    return op7_one_permutation.to_leaders(op7_one_permutation.fingerprints(_read(spark, sf_dir, "documents")))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's token ids lie in the written files."""
    return op8_token_files.write(_read(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its host's posterior and whether it stays."""
    pages = op9_host_reputation.outcomes(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels"))
    return op9_host_reputation.judge(pages).withColumns({c: F.round(c, 9) for c in ("mean", "low", "high")})


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return op10_html_blocks.texts(_read(spark, sf_dir, "pages"))


def queries() -> dict:
    found = (
        op1_chat_formatting,
        op2_mixing,
        op3_decontamination,
        op4_order_minhash_dedup,
        op5_license_scans,
        op6_quality_classifier,
        op7_fingerprints,
        op8_token_output,
        op9_url_filter,
        op10_html_extraction,
        fingerprint_similarity,
    )
    return {f.__name__: f for f in found} | {"pipeline": _pipeline().run}


def oracle_sql() -> dict:
    out = {"op1_chat_formatting": op1_chat_layouts.oracle(), "op2_mixing": op2_raking.oracle(), "op9_url_filter": op9_host_reputation.oracle()}
    return out | ({"pipeline": sql} if (sql := _pipeline().ORACLE_SQL) else {})
