"""Command line: python -m verdica.audit --problems FILE.

Which answers of a problem set does each normal form take for the same, and which of them wrongly?
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import session
from .functions import columns as C
from .operators import audit
from .sources import problems

SHOWN = 12


def first_collisions(found: DataFrame, n: int = SHOWN) -> DataFrame:
    """The first n by form."""
    return found.orderBy("form").limit(n)


def first_pairs(pairs: DataFrame, n: int = SHOWN) -> DataFrame:
    """The first n pairs that are graded equal, in order."""
    return pairs.where("graded_equal").orderBy("a", "b").limit(n)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="verdica.audit", description=__doc__.split("\n\n")[1])
    p.add_argument("--problems", required=True)
    p.add_argument("--master", default="local[*]")
    a = p.parse_args(args)
    spark = session.build(a.master)
    golds = problems.load(spark, a.problems).select("answer")
    for name, form in (("old", C.old_normal(F.col("answer"))), ("new", C.normal("answer"))):
        found = audit.classify(audit.collisions(golds, form)).cache()
        n = {r["genuine"]: r["count"] for r in found.groupBy("genuine").count().collect()}
        print(f"{name} form: {sum(n.values())} collisions, {n.get(True, 0)} of equal answers, {n.get(False, 0)} FALSE")
        for r in first_collisions(found.where("not genuine")).collect():
            print(f"  {r['form']!r} <- {r['answers']}")
    pairs = audit.core_pairs(golds).cache()
    n, equal, wrong = pairs.agg(F.count("*"), F.count_if("graded_equal"), F.count_if(F.col("graded_equal") & ~F.col("equal"))).first()
    print(f"presentation: {n} pairs with one core, {equal} graded equal, {wrong} of them not equal in value")
    for r in first_pairs(pairs).collect():
        print(f"  {r['a']!r} = {r['b']!r} ({'equal in value' if r['equal'] else 'by presentation alone'})")
    return 0


if __name__ == "__main__":
    sys.exit(main())
