"""Grouped, binned and ranked statistics.

Scores are counted in thousandths (``milli``, an integer): sums are then exact and
independent of the order of rows, and there are at most a thousand and one of them, so
ranks come from one aggregation by score and a window over its few rows, whatever the
number of input rows.  Each statistic is null, not zero, where it isn't defined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_CLASS = 10
Z95 = 1.96


def truth(c: str | Column) -> Column:
    """A missing outcome counts as wrong."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))


def _tally(ok: str) -> list[Column]:
    right = F.count_if(truth(ok))
    return [(right / F.count("*")).alias("accuracy"), right.alias("correct"), F.count("*").alias("total")]


def group_accuracy(rows: DataFrame, key: str, ok: str = "ok") -> DataFrame:
    """(key as text, accuracy, correct, total); rows without the key are left out."""
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(*_tally(ok))


def cross_tab(rows: DataFrame, row: str, col: str, ok: str = "ok") -> DataFrame:
    """The non-empty cells of two keys."""
    some = rows.where(F.col(row).isNotNull() & F.col(col).isNotNull())
    return some.groupBy(F.col(row).cast("string").alias("row"), F.col(col).cast("string").alias("col")).agg(*_tally(ok))


def dense_cross_tab(rows: DataFrame, row: str, col: str, ok: str = "ok") -> DataFrame:
    """All cells, empty ones with zero counts and no accuracy; the grid is built from the cells, not the rows."""
    cells = cross_tab(rows, row, col, ok)
    grid = cells.select("row").distinct().crossJoin(cells.select("col").distinct())
    full = grid.join(cells, ["row", "col"], "left")
    return full.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("correct", "total")})


def grouping_sets(rows: DataFrame, a: str, b: str, ok: str = "ok") -> DataFrame:
    """Totals of both keys, of each and of neither in one pass over the rows.

    ``level`` is 0 for both, 1 for the first key, 2 for the second, 3 for the whole; groups of a
    null key are left out.
    """
    named = rows.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"), F.col(ok).alias("ok"))
    sets = named.groupingSets([["a", "b"], ["a"], ["b"], []], "a", "b").agg(F.grouping_id().cast("int").alias("level"), *_tally("ok"))
    has_a, has_b = F.col("a").isNotNull() | F.col("level").isin(2, 3), F.col("b").isNotNull() | F.col("level").isin(1, 3)
    return sets.where(has_a & has_b)


def summary(rows: DataFrame, ok: str = "ok", predicted: str = "predicted", matched: str = "matched", milli: str = "milli", tokens: str = "tokens") -> DataFrame:
    """The figures of a run in one row, from one pass."""
    from ..functions.columns import is_blank

    empty = is_blank(F.col(predicted))
    unread = ~F.coalesce(F.col(matched), F.lit(False)) | (F.coalesce(F.col(predicted), F.lit("")) == "")
    n = F.count("*")
    return rows.agg(
        n.alias("questions"),
        F.count_if(truth(ok)).alias("correct"),
        (F.count_if(truth(ok)) / F.nullif(n, F.lit(0))).alias("accuracy"),
        (F.sum(milli) / F.nullif(F.count(milli), F.lit(0)) / 1000).alias("mean_score"),
        F.count_if(unread).alias("parse_failures"),
        (F.count_if(unread) / F.nullif(n, F.lit(0))).alias("parse_failure_rate"),
        F.count_if(empty).alias("empty_responses"),
        F.coalesce(F.sum(F.coalesce(F.col(tokens), F.lit(0)).cast("bigint")), F.lit(0)).alias("total_tokens"),
    )


def scored(rows: DataFrame, milli: str = "milli", ok: str = "ok") -> DataFrame:
    """(milli, ok) of the rows with a score."""
    return rows.where(F.col(milli).isNotNull()).select(F.col(milli).cast("bigint").alias("milli"), truth(ok).alias("ok"))


def by_score(rows: DataFrame, milli: str = "milli", ok: str = "ok") -> DataFrame:
    """(milli, right, wrong): the distribution that all rank statistics start from."""
    return scored(rows, milli, ok).groupBy("milli").agg(F.count_if("ok").alias("right"), F.count_if(~F.col("ok")).alias("wrong"))


def _one_partition(*order: str):
    """For windows over the few rows of a distribution."""
    return Window.partitionBy(F.lit(0)).orderBy(*order)


def average_ranks(rows: DataFrame, milli: str = "milli", ok: str = "ok") -> DataFrame:
    """(milli, right, wrong, average rank of the ties at that score), ranks from 1."""
    d = by_score(rows, milli, ok).withColumn("n", F.col("right") + F.col("wrong"))
    before = F.coalesce(F.sum("n").over(_one_partition("milli").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.select("milli", "right", "wrong", (before + (F.col("n") + 1) / 2).alias("average_rank"))


def roc_auc(rows: DataFrame, milli: str = "milli", ok: str = "ok") -> DataFrame:
    """(auc, n_right, n_wrong): the chance that a right row scores above a wrong one, ties half.

    Null without both classes.  Products are decimals, which hold for any count of rows.
    """
    d = by_score(rows, milli, ok)
    below = F.coalesce(F.sum("wrong").over(_one_partition("milli").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wide = lambda c: c.cast("decimal(19,0)")
    d = d.select("right", "wrong", (wide(F.col("right")) * wide(2 * below + F.col("wrong"))).alias("wins"))
    sums = d.agg(F.sum("wins").cast("double").alias("w"), F.coalesce(F.sum("right"), F.lit(0)).alias("n_right"), F.coalesce(F.sum("wrong"), F.lit(0)).alias("n_wrong"))
    pairs = F.nullif(2.0 * F.col("n_right") * F.col("n_wrong"), F.lit(0.0))
    return sums.select((F.col("w") / pairs).alias("auc"), "n_right", "n_wrong")


def auc_interval(auc: Column, n_right: Column, n_wrong: Column, z: float = Z95) -> tuple[Column, Column]:
    """The Hanley-McNeil interval around the AUC, its variance taken half a pair inside the ends."""
    pairs = n_right.cast("double") * n_wrong
    margin = 0.5 / pairs
    a = F.least(1 - margin, F.greatest(margin, auc))
    q1, q2 = a / (2 - a), 2 * a * a / (1 + a)
    v = (a * (1 - a) + (n_right - 1) * (q1 - a * a) + (n_wrong - 1) * (q2 - a * a)) / pairs
    half = z * F.sqrt(F.greatest(v, F.lit(0.0)))
    known = auc.isNotNull() & (n_right > 0) & (n_wrong > 0)
    return F.when(known, F.greatest(F.lit(0.0), auc - half)), F.when(known, F.least(F.lit(1.0), auc + half))


def auc_with_interval(rows: DataFrame, milli: str = "milli", ok: str = "ok") -> DataFrame:
    one = roc_auc(rows, milli, ok)
    low, high = auc_interval(F.col("auc"), F.col("n_right"), F.col("n_wrong"))
    return one.select("auc", low.alias("ci_low"), high.alias("ci_high"), "n_right", "n_wrong")


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r of integers, as an aggregate of exact sums; null for a constant or under two rows."""
    wide = lambda c: c.cast("decimal(19,0)")
    s = lambda c: F.sum(c).cast("double")
    n = F.count_if(x.isNotNull() & y.isNotNull()).cast("double")
    vx, vy = n * s(wide(x * x)) - s(wide(x)) * s(wide(x)), n * s(wide(y * y)) - s(wide(y)) * s(wide(y))
    return F.when(n >= 2, (n * s(wide(x * y)) - s(wide(x)) * s(wide(y))) / F.nullif(F.sqrt(vx) * F.sqrt(vy), F.lit(0.0)))


def pearson(rows: DataFrame, milli: str = "milli", ok: str = "ok") -> DataFrame:
    return scored(rows, milli, ok).agg(correlation(F.col("milli"), F.col("ok").cast("bigint")).alias("r"))


def bin_of(milli: Column, bins: int = 10) -> Column:
    """Equal bins over 0 to 1; what lies outside counts at the end, and 1 belongs to the last bin."""
    inside = F.least(F.greatest(milli, F.lit(0)), F.lit(1000))
    return F.least(F.floor(inside * bins / 1000), F.lit(bins - 1)).cast("int")


def calibration_bins(rows: DataFrame, milli: str = "milli", ok: str = "ok", bins: int = 10) -> DataFrame:
    """(bin, lo, hi, count, correct, accuracy, mean_score) of every bin, empty ones too."""
    d = by_score(rows, milli, ok)
    inside = F.least(F.greatest(F.col("milli"), F.lit(0)), F.lit(1000))
    n = F.col("right") + F.col("wrong")
    full = d.groupBy(bin_of(F.col("milli"), bins).alias("bin")).agg(F.sum(n).alias("count"), F.sum("right").alias("correct"), F.sum(inside * n).alias("total"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    k = F.col("bin")
    return every.join(F.broadcast(full), "bin", "left").select(
        "bin", (k / bins).alias("lo"), ((k + 1) / bins).alias("hi"), F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("correct", F.lit(0)).alias("correct"),
        (F.col("correct") / F.col("count")).alias("accuracy"), (F.col("total") / F.col("count") / 1000).alias("mean_score"),
    )


def expected_calibration_error(rows: DataFrame, milli: str = "milli", ok: str = "ok", bins: int = 10) -> DataFrame:
    b = calibration_bins(rows, milli, ok, bins).where("count > 0")
    return b.agg((F.sum(F.col("count") * F.abs(F.col("accuracy") - F.col("mean_score"))) / F.sum("count")).alias("ece"))


def class_means(rows: DataFrame, milli: str = "milli", ok: str = "ok") -> DataFrame:
    """Mean scores of right and wrong rows and their distance."""
    s = scored(rows, milli, ok)
    mean = lambda c: F.avg(F.when(c, F.col("milli"))) / 1000
    return s.agg(mean(F.col("ok")).alias("mean_correct"), mean(~F.col("ok")).alias("mean_incorrect")).withColumn("separation", F.col("mean_correct") - F.col("mean_incorrect"))


def verdict(low: Column, high: Column, n_right: Column, n_wrong: Column) -> Column:
    """Does the score beat chance?  Null where it can't be told, false where the interval holds one half."""
    return F.when(low.isNull(), F.lit(None)).when((low <= 0.5) & (high >= 0.5), False).when(F.least(n_right, n_wrong) < LEAST_CLASS, F.lit(None)).otherwise(True).cast("boolean")


def calibration(rows: DataFrame, milli: str = "milli", ok: str = "ok", bins: int = 10) -> DataFrame:
    """All calibration figures in one row, from one pass: the rows by score, these by bin, and the bins' sums."""
    wide = lambda c: c.cast("decimal(19,0)")
    x, p, n = F.col("milli"), F.col("right"), F.col("wrong")
    below = F.coalesce(F.sum("wrong").over(_one_partition("milli").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.least(F.greatest(x, F.lit(0)), F.lit(1000))
    each = by_score(rows, milli, ok).withColumn("wins", wide(p) * wide(2 * below + n))
    sums = {"right": p, "wrong": n, "wins": F.col("wins"), "sx": x * (p + n), "sxx": wide(x * x) * wide(p + n), "sxy": x * p, "sxn": x * n, "clipped": inside * (p + n)}
    per_bin = each.groupBy(bin_of(x, bins).alias("bin")).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    size = p + n
    far = size * F.abs(p / size - F.col("clipped") / size / 1000)
    one = per_bin.agg(*[F.sum(c).cast("double").alias(c) for c in ("wins", "sx", "sxx", "sxy", "sxn")], F.coalesce(F.sum("right"), F.lit(0)).alias("n_right"), F.coalesce(F.sum("wrong"), F.lit(0)).alias("n_wrong"), (F.sum(far) / F.sum(size)).alias("ece"))
    right, wrong, count = F.col("n_right"), F.col("n_wrong"), (F.col("n_right") + F.col("n_wrong")).cast("double")
    spread = F.sqrt(count * F.col("sxx") - F.col("sx") * F.col("sx")) * F.sqrt(count * right - right.cast("double") * right)
    one = one.withColumns({
        "auc": F.col("wins") / F.nullif(2.0 * right * wrong, F.lit(0.0)),
        "r": F.when(count >= 2, (count * F.col("sxy") - F.col("sx") * right) / F.nullif(spread, F.lit(0.0))),
        "mean_correct": F.col("sxy") / F.nullif(right, F.lit(0)) / 1000, "mean_incorrect": F.col("sxn") / F.nullif(wrong, F.lit(0)) / 1000,
    })
    low, high = auc_interval(F.col("auc"), right, wrong)
    one = one.withColumns({"ci_low": low, "ci_high": high})
    low, high = F.col("ci_low"), F.col("ci_high")
    return one.select(
        (right + wrong).alias("n"), "n_right", "n_wrong", "auc", "ci_low", "ci_high", verdict(low, high, right, wrong).alias("beats_chance"),
        F.when(low > 0.5, "above").when(high < 0.5, "below").when(low.isNotNull(), "unclear").alias("direction"), "r", "mean_correct", "mean_incorrect",
        (F.col("mean_correct") - F.col("mean_incorrect")).alias("separation"), "ece",
    )


def score_histogram(rows: DataFrame, milli: str = "milli", ok: str = "ok", bins: int = 10) -> DataFrame:
    """(ok, bin, count) of the bins that have any."""
    return scored(rows, milli, ok).groupBy("ok", bin_of(F.col("milli"), bins).alias("bin")).agg(F.count("*").alias("count"))


def populated(bins: DataFrame) -> DataFrame:
    return bins.where("count > 0")
