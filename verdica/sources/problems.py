"""Problem sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import number


def from_table(rows: DataFrame, key: str, problem: str, answer, subject=None, level=None) -> DataFrame:
    """Rows as problems, ``index`` counted from 0 by the key."""
    column = lambda c, t: F.lit(None).cast(t) if c is None else (F.col(c) if isinstance(c, str) else c).cast(t)
    return number(rows, key, "_n").select(
        F.col("_n").cast("int").alias("index"), column(problem, "string").alias("problem"), column(answer, "string").alias("answer"),
        column(subject, "string").alias("subject"), column(level, "int").alias("level"),
    )


def first(rows: DataFrame, n: int) -> DataFrame:
    """The first n problems by index, which may have gaps."""
    last = rows.select("index").orderBy("index").limit(n).agg(F.max("index")).first()[0]
    return rows.where(F.col("index") <= last) if last is not None else rows.where("false")


def load(spark: SparkSession, path: str, limit: int | None = None, question: int | None = None) -> DataFrame:
    """A stored problem set (Parquet, or JSON lines): the first ``limit`` by index, or the one question (from 1).

    Rows without an index are counted in the order of their ids.
    """
    rows = spark.read.schema("index int, unique_id string, problem string, answer string, subject string, level int").json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)
    if "index" not in rows.columns or ("unique_id" in rows.columns and rows.where("index is not null").isEmpty()):
        key = "unique_id" if "unique_id" in rows.columns else "problem"
        rows = from_table(rows, key, "problem", "answer", "subject", "level")
    if question is not None:
        return rows.where(F.col("index") == question - 1)
    return rows if limit is None else first(rows, limit)
