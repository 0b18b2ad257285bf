"""Statistics against their definitions in plain Python."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verdica.operators import compare, selection, stats

ROWS = st.lists(st.tuples(st.one_of(st.none(), st.integers(-50, 1050)), st.one_of(st.none(), st.booleans())), max_size=30)
QUICK = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, rows):
    return spark.createDataFrame(rows, "milli int, ok boolean")


def auc(rows):
    right, wrong = [m for m, o in rows if m is not None and o], [m for m, o in rows if m is not None and not o]
    if not right or not wrong:
        return None
    return sum((a > b) + 0.5 * (a == b) for a in right for b in wrong) / len(right) / len(wrong)


@QUICK
@given(ROWS)
def test_auc(spark, rows):
    one = stats.auc_with_interval(frame(spark, rows)).first()
    assert one["auc"] == (pytest.approx(auc(rows)) if auc(rows) is not None else None)
    assert (one["ci_low"] is None) == (auc(rows) is None)
    if auc(rows) is not None:
        flipped = stats.roc_auc(frame(spark, [(None if m is None else -m, o) for m, o in rows])).first()["auc"]
        assert flipped + one["auc"] == pytest.approx(1) and 0 <= one["ci_low"] <= one["auc"] <= one["ci_high"] <= 1


def test_auc_by_hand(spark):
    for rows, value in (
        ([(900, True), (800, True), (200, False)], 1.0), ([(100, True), (900, False)], 0.0), ([(500, True), (500, False)], 0.5),
        ([(800, True), (400, True), (600, False), (200, False)], 0.75), ([(1, True)], None), ([], None),
    ):
        assert stats.roc_auc(frame(spark, rows)).first()["auc"] == value


def test_interval_by_hand(spark):
    row = spark.range(1).select(F.lit(0.826).alias("a"), F.lit(495).alias("p"), F.lit(1).alias("n"))
    low, high = row.select(*stats.auc_interval(F.col("a"), F.col("p"), F.col("n"))).first()
    assert low == pytest.approx(0.5383, abs=1e-4) and high == 1.0


@QUICK
@given(ROWS)
def test_correlation(spark, rows):
    some = [(m, bool(o)) for m, o in rows if m is not None]
    r = stats.pearson(frame(spark, rows)).first()["r"]
    n = len(some)
    if n < 2 or len({m for m, _ in some}) == 1 or len({o for _, o in some}) == 1:
        assert r is None
        return
    mx, my = sum(m for m, _ in some) / n, sum(o for _, o in some) / n
    cov = sum((m - mx) * (o - my) for m, o in some)
    assert r == pytest.approx(cov / math.sqrt(sum((m - mx) ** 2 for m, _ in some) * sum((o - my) ** 2 for _, o in some)))


@QUICK
@given(ROWS)
def test_bins_partition_the_rows(spark, rows):
    got = {r["bin"]: r for r in stats.calibration_bins(frame(spark, rows)).collect()}
    assert sorted(got) == list(range(10))
    for b, r in got.items():
        mine = [(min(max(m, 0), 1000), bool(o)) for m, o in rows if m is not None and min(int(min(max(m, 0), 1000) * 10 // 1000), 9) == b]
        assert r["count"] == len(mine) and r["correct"] == sum(o for _, o in mine)
        assert r["accuracy"] == (pytest.approx(sum(o for _, o in mine) / len(mine)) if mine else None)
        assert r["mean_score"] == (pytest.approx(sum(m for m, _ in mine) / len(mine) / 1000) if mine else None)


def test_verdicts(spark):
    rng = random.Random(1)
    strong = [(rng.randrange(500, 1000), True) for _ in range(60)] + [(rng.randrange(0, 500), False) for _ in range(60)]
    cases = [(strong, True, "above"), ([(m, not o) for m, o in strong], True, "below"), ([(999, True)] * 99 + [(1, False)], None, "above"), ([(500, i % 2 == 0) for i in range(60)], False, "unclear"), ([(1, True)], None, None)]
    for rows, beats, direction in cases:
        one = stats.calibration(frame(spark, rows)).first()
        assert (one["beats_chance"], one["direction"]) == (beats, direction)
    assert stats.calibration(frame(spark, [])).first()["n"] == 0


def test_group_keys_are_texts_and_nulls_are_left_out(spark):
    rows = spark.createDataFrame([("10", 1, True), ("2", 1, None), (None, 2, True), ("2", None, True)], "a string, b int, ok boolean")
    assert {(r["key"], r["correct"], r["total"]) for r in stats.group_accuracy(rows, "a").collect()} == {("10", 1, 1), ("2", 1, 2)}
    assert {(r["row"], r["col"]) for r in stats.cross_tab(rows, "a", "b").collect()} == {("10", "1"), ("2", "1")}
    dense = stats.dense_cross_tab(rows.unionByName(spark.createDataFrame([("3", 7, True)], rows.schema)), "a", "b").collect()
    assert len(dense) == 6 and sum(r["total"] == 0 and r["accuracy"] is None for r in dense) == 3
    sets = {(r["a"], r["b"], r["level"]): r["total"] for r in stats.grouping_sets(rows, "a", "b").collect()}
    assert sets == {("10", "1", 0): 1, ("2", "1", 0): 1, ("10", None, 1): 1, ("2", None, 1): 2, (None, "1", 2): 2, (None, "2", 2): 1, (None, None, 3): 4}


def test_summary_of_nulls(spark):
    rows = spark.createDataFrame([(True, "5", True, 500, None), (None, "", True, None, 7), (False, "   ", None, 100, 1)], "ok boolean, predicted string, matched boolean, milli int, tokens int")
    one = stats.summary(rows).first()
    assert (one["questions"], one["correct"], one["parse_failures"], one["empty_responses"], one["total_tokens"]) == (3, 1, 2, 2, 8)
    assert one["mean_score"] == pytest.approx(0.3)
    assert stats.summary(rows.where("false")).first()["accuracy"] is None


SAMPLES = [
    (1, 0, "7", 900, False), (1, 1, "4", 300, True), (1, 2, "\\frac{8}{2}", 200, True), (2, 0, "a", None, False), (2, 1, "b", -5, True), (2, 2, "c", 0, True), (3, 0, None, None, None),
]


def test_selection(spark):
    df = selection.equivalence_classes(spark.createDataFrame(SAMPLES, "index int, sample_index int, predicted string, milli int, ok boolean"))
    heads = {(r["index"], r["class"]): (r["answer"], r["members"]) for r in selection.class_heads(df).collect()}
    assert heads[1, 0] == ("7", 1) and heads[1, 1] == ("4", 2)
    pick = lambda s: {r["index"]: r["sample_index"] for r in selection.select(df, s, "class").collect()}
    assert pick("first") == {1: 0, 2: 0, 3: 0} and pick("majority") == {1: 1, 2: 0, 3: 0}
    assert pick("best") == {1: 0, 2: 0, 3: 0} and pick("weighted") == {1: 0, 2: 0, 3: 0}
    rates = {r["strategy"]: (r["accuracy"], r["delta"]) for r in selection.selection_accuracy(df, "class").collect()}
    assert rates["majority"][0] == pytest.approx(1 / 3) and rates["majority"][1] == pytest.approx(100 / 3)
    with pytest.raises(ValueError):
        selection.select(df, "luck")


def test_comparison_stops_with_the_shortest_run(spark):
    rows = [("a", 0, 0, True), ("a", 0, 1, False), ("a", 0, 2, True), ("b", 1, 0, False), ("b", 1, 1, None)]
    df = spark.createDataFrame([(b, o, p, p * 10, k) for b, o, p, k in rows], "backend string, ord int, pos int, index int, ok boolean")
    assert {r["backend"]: r["accuracy"] for r in compare.accuracy(df).collect()} == {"a": 0.5, "b": 0.0}
    assert [(r["a"], r["b"], r["agreement"]) for r in compare.agreement(df).collect()] == [("a", "b", 0.5)]
    assert [tuple(r) for r in compare.top_divergences(df).collect()] == [(0, 0, "a", "b")]
    assert compare.accuracy(df.where("false")).count() == 0
