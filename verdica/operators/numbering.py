"""Consecutive numbers over any count of rows.

A window over all rows would sort them in one task.  Instead rows fall into ranges of the
key, bounded by quantiles of a sample; each range is numbered by itself and starts at
the sum of the ranges before it.  The bounds are taken once and are literals of the plan,
so that both uses of the ranges agree whatever is recomputed or coalesced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGE_ROWS = 1_000_000
_SAMPLE = 20_000


def bounds(rows: DataFrame, key: str, range_rows: int = RANGE_ROWS) -> list:
    """Keys that cut the rows into ranges of about that size; none for a table of one range."""
    n = rows.count()
    ranges = min(-(-n // range_rows), 2000)
    if ranges <= 1:
        return []
    known = rows.where(F.col(key).isNotNull()).select(key)
    drawn = sorted(r[0] for r in known.sample(min(1.0, _SAMPLE / n), seed=1).collect())
    return sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)}) if drawn else []


def number(rows: DataFrame, key: str, into: str, within: str | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with their place by the key (nulls first), from 0, among all or among those of equal ``within``."""
    cuts = bounds(rows, key, range_rows)
    if not cuts:  # one range: nothing comes before it
        whole = Window.partitionBy(*([within] if within else [F.lit(0)])).orderBy(F.asc_nulls_first(key))
        return rows.select("*", (F.row_number().over(whole) - 1).cast("bigint").alias(into))
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda b: b <= F.col(key))) if cuts else F.lit(0)
    ranged = rows.withColumn("_range", F.when(F.col(key).isNull(), F.lit(0)).otherwise(place))
    group = [within] if within else []
    sizes = ranged.groupBy(*group, "_range").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*group, "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    numbered = ranged.withColumn("_n", F.row_number().over(Window.partitionBy(*group, "_range").orderBy(F.asc_nulls_first(key))) - 1)
    joined = numbered.join(F.broadcast(bases), [*group, "_range"]) if len(cuts) < 10_000 else numbered.join(bases, [*group, "_range"])
    return joined.select(*rows.columns, (F.col("_n") + F.col("_base")).alias(into))
