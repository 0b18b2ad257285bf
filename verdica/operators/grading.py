"""Grading tables of answers.

Python is asked only about what built-ins can't decide, and once for each distinct pair.
Filters, not CASE, keep decided rows away from it: a UDF inside CASE still sees every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

#: Texts of which the normal form is themselves: signless numbers and plain small words.
_FLAT = r"^(?:0|[1-9][0-9]{0,14})$"


def grade(rows: DataFrame, expected: str = "expected", predicted: str = "predicted", into: str = "ok") -> DataFrame:
    """``rows`` with the verdict; a null or empty answer is wrong.

    What built-ins can decide is decided in place.  The verdicts on all other pairs are joined
    by 128 bits of hash, so their table is narrow and is broadcast up to the usual limit.
    """
    e, p = F.coalesce(F.col(expected), F.lit("")), F.col(predicted)
    said = p.isNotNull() & (p != "")
    flat = F.regexp_like(e, F.lit(_FLAT)) & F.regexp_like(p, F.lit(_FLAT))
    easy = ~said | (e == p) | flat
    key = lambda salt: F.xxhash64(F.lit(salt), e, p)
    # small in bytes but dear in time: adaptive execution would put them all into one task
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = rows.where(~F.coalesce(easy, F.lit(True))).select(e.alias("_e"), p.alias("_p"), key(1).alias("_h1"), key(2).alias("_h2")).distinct()
    verdicts = pairs.repartition(tasks, "_h1").select("_h1", "_h2", C.correct("_e", "_p").alias("_right"))
    joined = rows.join(verdicts, (key(1) == F.col("_h1")) & (key(2) == F.col("_h2")), "left")
    verdict = F.when(F.coalesce(easy, F.lit(True)), F.coalesce(said & (e == p), F.lit(False))).otherwise(F.coalesce(F.col("_right"), F.lit(False)))
    return joined.select(*[rows[c] for c in rows.columns if c != into], verdict.alias(into))


def read_answers(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with predicted and matched, from the response's text."""
    return rows.withColumn("_a", C.final_answer(F.col(text))).withColumns({"predicted": F.col("_a.answer"), "matched": F.col("_a.matched")}).drop("_a")


def read_steps(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with steps and num_steps."""
    return rows.withColumn("steps", C.steps(F.col(text))).withColumn("num_steps", F.size("steps"))


def step_prefixes(rows: DataFrame, problem: str = "problem", steps: str = "steps", between: str = "\n\n") -> DataFrame:
    """A row for each step with the text a process scorer sees: the problem and all steps up to it."""
    grown = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat_ws(between, F.col(problem), F.array_join(F.slice(F.col(steps), 1, i), between)))
    kept = [c for c in rows.columns if c != "step"]
    return rows.where(F.size(steps) > 0).select(*kept, F.posexplode(grown).alias("step", "prefix"))


def zip_scores(rows: DataFrame, steps: str = "steps", scores: str = "scores") -> DataFrame:
    """A row for each step with its score, null where there are fewer scores than steps."""
    zipped = F.slice(F.arrays_zip(F.col(steps).alias("text"), F.col(scores).alias("score")), F.lit(1), F.greatest(F.size(steps), F.lit(1)))
    kept = [c for c in rows.columns if c not in (steps, scores)]
    return rows.where(F.size(steps) > 0).select(*kept, F.posexplode(zipped).alias("step", "z")).select(*kept, "step", "z.text", "z.score")
