"""Runs against each other, aligned by position.

Rows are (backend, ord, pos, ok, ...), ``ord`` the order in which backends were named.
Positions that not every backend has are left out, as a zip would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import RANGE_ROWS, number
from .stats import truth


def positions(rows: DataFrame, key: str, backend: str = "backend", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows with ``pos``, counted from 0 within each backend by the key."""
    return number(rows, key, "pos", backend, range_rows)


def _at(runs: DataFrame, *more: str) -> DataFrame:
    """(pos, them): the rows of each position that all backends have, by their order.

    Positions count from 0 within each backend, so those that all have are those as wide as the
    widest, and one shuffle by position serves both questions.
    """
    fields = F.struct("ord", "backend", truth("ok").alias("ok"), *more)
    at = runs.groupBy("pos").agg(F.array_sort(F.collect_list(fields)).alias("them"))
    widest = at.agg(F.max(F.size("them")).alias("_most"))
    return at.join(F.broadcast(widest), F.size("them") == F.col("_most")).drop("_most")


def accuracy(runs: DataFrame) -> DataFrame:
    right = F.count_if("x.ok")
    each = _at(runs).select(F.explode("them").alias("x"))
    return each.groupBy(F.col("x.backend").alias("backend")).agg(right.alias("correct"), F.count("*").alias("total"), (right / F.count("*")).alias("accuracy"))


def agreement(runs: DataFrame) -> DataFrame:
    """(a, b, agree, total, agreement) of each pair of backends, in the order they were named.

    The outcomes of a position are gathered once and paired within the row, so the number
    of shuffles doesn't grow with the number of backends.
    """
    x = _at(runs).select(F.explode("them").alias("x"), "them").select("x", F.explode("them").alias("y")).where("x.ord < y.ord")
    same = F.count_if(F.col("x.ok") == F.col("y.ok"))
    return x.groupBy(F.col("x.backend").alias("a"), F.col("y.backend").alias("b")).agg(same.alias("agree"), F.count("*").alias("total"), (same / F.count("*")).alias("agreement"))


def _differ(at: DataFrame) -> DataFrame:
    return at.where(F.exists("them", lambda t: t["ok"]) & F.exists("them", lambda t: ~t["ok"]))


def divergences(runs: DataFrame) -> DataFrame:
    """(pos, index, right, wrong): positions where outcomes differ, and who had which, by backend order."""
    names = lambda want: F.array_join(F.transform(F.filter("them", lambda t: t["ok"] == want), lambda t: t["backend"]), ",")
    return _differ(_at(runs, "index")).select("pos", F.col("them")[0]["index"].alias("index"), names(True).alias("right"), names(False).alias("wrong"))


def divergence_details(runs: DataFrame) -> DataFrame:
    """(pos, index, problem, expected, subject, difficulty, outcomes, predicted, milli): the same with what each backend said, in maps by backend; the problem as the first one has it."""
    by = lambda c: F.map_from_entries(F.transform("them", lambda t: F.struct(t["backend"], t[c])))
    about = ("index", "problem", "expected", "subject", "difficulty")
    found = _differ(_at(runs, *about, "predicted", "milli"))
    return found.select("pos", *[F.col("them")[0][c].alias(c) for c in about], by("ok").alias("outcomes"), by("predicted").alias("predicted"), by("milli").alias("milli"))


def top_divergences(runs: DataFrame, n: int = 40) -> DataFrame:
    return divergences(runs).orderBy("pos").limit(n)
