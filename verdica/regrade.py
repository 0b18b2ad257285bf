"""Command line: python -m verdica.regrade --results FILE [--write [--report]].

Grades stored answers anew, without generating any.  Without --write it only tells what would change.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import session
from .operators import grading, runs
from .plans import evaluate, report
from .sources import results


def regraded(rows: DataFrame) -> DataFrame:
    """Result rows with ``was`` and the verdicts anew: the headline's, each sample's and each strategy's."""
    out = runs.regrade(rows)
    for name, verdict in (("samples", "ok"), ("selection", "correct")):
        if name not in rows.columns:
            continue
        pairs = F.col(name) if name == "samples" else F.map_entries(name)
        each = out.select("index", "expected", F.posexplode(pairs).alias("n", "x"))
        said = F.col("x.predicted") if name == "samples" else F.col("x.value.predicted")
        fresh = grading.grade(each.select("index", "expected", "n", "x", said.alias("predicted")), into="now")
        value = F.col("x").withField(verdict, F.col("now")) if name == "samples" else F.struct(F.col("x.key").alias("key"), F.col("x.value").withField(verdict, F.col("now")).alias("value"))
        again = fresh.groupBy("index").agg(F.array_sort(F.collect_list(F.struct("n", value.alias("x")))).alias("them"))
        listed = F.transform("them", lambda t: t["x"])
        again = again.select("index", (listed if name == "samples" else F.map_from_entries(listed)).alias(name))
        out = out.drop(name).join(again, "index", "left")
    return out


def _accuracies(rows: DataFrame) -> DataFrame:
    each = rows.select(F.explode("selection").alias("strategy", "x"))
    return each.groupBy("strategy").agg((F.count_if(F.coalesce("x.correct", F.lit(False))) / F.count("*")).alias("accuracy"))


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="verdica.regrade", description=__doc__.split("\n\n")[1])
    p.add_argument("--results", default="eval_results.json")
    p.add_argument("--write", action="store_true", help="replace the file; the former one is kept as .bak")
    p.add_argument("--report", action="store_true", help="make the report anew")
    p.add_argument("--master", default="local[*]")
    a = p.parse_args(args)
    if not Path(a.results).exists():
        print(f"no results at {a.results}", file=sys.stderr)
        return 2
    spark = session.build(a.master)
    before = results.read_any(spark, a.results).cache()
    after = regraded(before).cache()
    told = runs.regrade_report(after).first()
    print(f"{told['questions']} questions, correct {told['correct_before']} -> {told['correct_after']}, now right {told['now_right']}, now wrong {told['now_wrong']}")
    for r in after.where("coalesce(was, false) <> ok").orderBy("index").toLocalIterator():
        print(f"  {'+' if r['ok'] else '-'} [{r['index']}] {r['expected']!r} <- {r['predicted']!r}")
    if "selection" in before.columns:
        for r in runs.strategy_changes(_accuracies(before), _accuracies(after)).orderBy("strategy").collect():
            print(f"  {r['strategy']}: {report.pct(r['before'])} -> {report.pct(r['after'])}")
    print(f"still wrong: {told['still_wrong']}, {told['empty_failures']} of them empty")
    if not a.write:
        print("nothing written; --write replaces the file")
        return 0
    stored = results.read_summary(a.results)
    about = {k: v for k, v in (stored.get("summary") or stored).items() if not isinstance(v, (dict, list))}
    payload = report.collect_payload(after, about) | {"regraded": True}
    results.rewrite(a.results, lambda path: results.write_json({k: v for k, v in payload.items() if k != "questions"}, after.drop("was"), path))
    if a.report:
        folder = Path(a.results).resolve().parent
        for t in report.targets("report.html", about.get("backend") or "model", payload["summary"]["questions"]):
            evaluate.emit(payload, str(folder / t))
    return 0


if __name__ == "__main__":
    sys.exit(main())
