"""Choosing one of k samples.

Rows are samples: (index, sample_index, answer class, milli).  The class is the answer
text, or a number of the equivalence classes.  A missing score counts as zero here, ties
go to the earlier sample, and a vote is won by a class but answered by its best sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRATEGIES = ("first", "majority", "best", "weighted")


def _earliest(value):
    return F.struct(value.alias("v"), (-F.col("sample_index")).alias("i"))


def select(samples: DataFrame, strategy: str, key: str = "predicted") -> DataFrame:
    """One sample of each question: all columns of ``samples``."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    score = F.coalesce(F.col("milli"), F.lit(0))
    row = F.struct(*samples.columns).alias("row")
    if strategy == "first":
        picked = samples.groupBy("index").agg(F.min_by(row, "sample_index").alias("row"))
    elif strategy == "best":
        picked = samples.groupBy("index").agg(F.max_by(row, _earliest(score)).alias("row"))
    else:
        vote = F.count("*") if strategy == "majority" else F.sum(score)
        classes = samples.groupBy("index", F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_class")).agg(
            vote.alias("votes"), F.min("sample_index").alias("first"), F.max_by(row, _earliest(score)).alias("row")
        )
        picked = classes.groupBy("index").agg(F.max_by("row", F.struct("votes", (-F.col("first")).alias("f"))).alias("row"))
    return picked.select("row.*")


def selections(samples: DataFrame, key: str = "predicted") -> DataFrame:
    """The chosen samples of all strategies, with the strategy's name, from one pass over the samples."""
    score, row = F.coalesce(F.col("milli"), F.lit(0)), F.struct(*samples.columns)
    rank = lambda c: F.struct(c.alias("v"), (-F.col("first")).alias("i"))
    classes = samples.groupBy("index", F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_class")).agg(
        F.count("*").alias("votes"), F.sum(score).alias("weight"), F.min("sample_index").alias("first"), F.min_by(row, "sample_index").alias("head"),
        F.max_by(row, _earliest(score)).alias("row"), F.max(_earliest(score)).alias("top"),
    )
    picked = classes.groupBy("index").agg(
        F.min_by("head", "first").alias("first"), F.max_by("row", rank(F.col("votes"))).alias("majority"), F.max_by("row", "top").alias("best"), F.max_by("row", rank(F.col("weight"))).alias("weighted"),
    )
    each = F.array(*[F.struct(F.lit(s).alias("strategy"), F.col(s).alias("row")) for s in STRATEGIES])
    return picked.select(F.explode(each).alias("s")).select("s.row.*", "s.strategy")


def selection_accuracy(samples: DataFrame, key: str = "predicted") -> DataFrame:
    """(strategy, accuracy, correct, total, delta): points gained on taking the first sample."""
    chosen = selections(samples, key).groupBy("strategy").agg(F.count_if(F.coalesce("ok", F.lit(False))).alias("correct"), F.count("*").alias("total"))
    rated = chosen.withColumn("accuracy", F.col("correct") / F.col("total"))
    base = rated.where("strategy = 'first'").select(F.col("correct").alias("_c"), F.col("total").alias("_t"))
    points = (F.col("correct") * F.col("_t") - F.col("_c") * F.col("total")) * 100 / (F.col("total") * F.col("_t"))
    return rated.crossJoin(base).select("strategy", "accuracy", "correct", "total", points.alias("delta"))


def equivalence_classes(samples: DataFrame) -> DataFrame:
    """Samples with ``class``: the number of the first answer of the question that theirs equals.

    Equality isn't transitive, so answers are folded in the order of samples, each
    compared with the representatives so far; a question's answers are few.
    """
    from ..functions.columns import equivalence_classes as classes

    g = samples.groupBy("index").agg(F.array_sort(F.collect_list(F.struct("sample_index", "predicted"))).alias("them"))
    g = g.select("index", "them", classes(F.transform("them", lambda x: x["predicted"])).alias("numbers"))
    pairs = g.select("index", F.explode(F.arrays_zip(F.transform("them", lambda x: x["sample_index"]).alias("sample_index"), F.col("numbers").alias("class"))).alias("p"))
    return samples.join(pairs.select("index", F.col("p.sample_index"), F.col("p.class")), ["index", "sample_index"])


def class_heads(classed: DataFrame) -> DataFrame:
    """(index, class, answer, members): the representative and the size of each class."""
    return classed.groupBy("index", "class").agg(F.min_by("predicted", "sample_index").alias("answer"), F.count("*").alias("members"))
