"""Which answers does a normal form take for the same, and rightly so?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def collisions(golds: DataFrame, form: Column, answer: str = "answer") -> DataFrame:
    """(form, variants, answers): forms that several distinct answers share."""
    known = golds.where(F.col(answer).isNotNull()).select(F.col(answer).alias("answer")).distinct().withColumn("form", form)
    return known.groupBy("form").agg(F.count("*").alias("variants"), F.array_sort(F.collect_list("answer")).alias("answers")).where("variants > 1")


def classify(found: DataFrame) -> DataFrame:
    """Collisions with ``genuine``: is every variant equal in value to the first?"""
    each = found.select("form", F.col("answers")[0].alias("head"), F.explode(F.slice("answers", 2, F.size("answers"))).alias("other"))
    verdict = each.groupBy("form").agg(F.bool_and(C.equivalent("head", "other")).alias("genuine"))
    return found.join(verdict, "form")


def core_pairs(golds: DataFrame, answer: str = "answer") -> DataFrame:
    """(a, b, graded_equal, equal): pairs a < b of distinct answers with the same core."""
    known = golds.where(F.col(answer).isNotNull()).select(F.col(answer).alias("answer")).distinct()
    cored = known.withColumn("core", C.core("answer"))
    x, y = cored.alias("x"), cored.alias("y")
    pairs = x.join(y, (F.col("x.core") == F.col("y.core")) & (F.col("x.answer") < F.col("y.answer"))).select(F.col("x.answer").alias("a"), F.col("y.answer").alias("b"))
    return pairs.select("a", "b", C.correct("a", "b").alias("graded_equal"), C.equivalent("a", "b").alias("equal"))


def spurious(pairs: DataFrame) -> DataFrame:
    """Pairs that grading takes for equal though their values differ."""
    return pairs.where("graded_equal and not equal")
