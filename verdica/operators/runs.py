"""A run's rows over time: resuming, splicing, regrading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_blank
from .grading import grade
from .stats import truth


def pending(problems: DataFrame, done: DataFrame, key: str = "index") -> DataFrame:
    """The problems without a stored row."""
    return problems.join(done.select(key), key, "left_anti")


def cached(problems: DataFrame, done: DataFrame, key: str = "index") -> DataFrame:
    """The stored rows of the problems asked for."""
    return done.join(problems.select(key).distinct(), key, "left_semi")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r")).select(key, "r.*")


def splice(rows: DataFrame, new: DataFrame, key: str = "pos") -> DataFrame:
    """``rows`` with those of ``new`` put in their places; no padding for places between."""
    fields = [c for c in rows.columns if c != key]
    old = rows.select(key, F.struct(*fields).alias("_old"))
    put = new.select(key, F.struct(*fields).alias("_new"))
    both = old.join(put, key, "full_outer").select(key, F.coalesce("_new", "_old").alias("r"))
    return both.select(key, "r.*")


def regrade(rows: DataFrame, expected: str = "expected", predicted: str = "predicted", ok: str = "ok") -> DataFrame:
    """``rows`` with ``was`` (the stored verdict) and the verdict anew; nothing is generated again."""
    kept = rows.withColumnRenamed(ok, "was")
    return grade(kept, expected, predicted, ok)


def regrade_report(rows: DataFrame, predicted: str = "predicted", ok: str = "ok") -> DataFrame:
    """Counts of what changed, in one row."""
    now, was = truth(ok), truth("was")
    return rows.agg(
        F.count("*").alias("questions"), F.count_if(was).alias("correct_before"), F.count_if(now).alias("correct_after"),
        F.count_if(now & ~was).alias("now_right"), F.count_if(was & ~now).alias("now_wrong"), F.count_if(~now).alias("still_wrong"),
        F.count_if(~now & is_blank(F.col(predicted))).alias("empty_failures"),
    )


def strategy_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(strategy, before, after) of the strategies whose accuracy moved."""
    a, b = before.select("strategy", F.col("accuracy").alias("before")), after.select("strategy", F.col("accuracy").alias("after"))
    return a.join(b, "strategy").where(F.abs(F.col("before") - F.col("after")) > 1e-12)
