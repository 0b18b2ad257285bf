"""Command line: python -m verdica.cli --problems PATH ..."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace
from pathlib import Path

from . import session
from .plans import evaluate, report
from .sources import generators, problems, results


_FLAG = {"action": "store_true"}
_OPTIONS = {
    "--problems": {"help": "Parquet of index, problem, answer, subject, level"},
    "--questions -n": {"default": 3, "type": int},
    "--question -q": {"help": "only this one, from 1", "type": int},
    "--backend -b": {"choices": sorted(generators.GENERATORS), "default": "mock"},
    "--model": {},
    "-k": {"default": 1, "help": "samples of each question", "type": int},
    "--temperature -t": {"type": float},
    "--max-tokens": {"default": 16384, "type": int},
    "--four-bits": _FLAG,
    "--no-resume": _FLAG,
    "--think": {"choices": ("merge", "off"), "default": "merge"},
    "--out": {"default": "."},
    "--report": {"default": "report.html"},
    "--compare": {"help": "backends, separated by commas"},
    "--no-report": _FLAG,
    "--quiet": {"help": "no transcript, no progress", **_FLAG},
    "--report-only": {"help": "make the report anew from stored results: of this file, else of all in the folder", "metavar": "JSON", "nargs": "?", "const": ""},
    "--master": {"default": "local[*]"},
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="verdica", description="Evaluate model answers on Spark.")
    for names, options in _OPTIONS.items():
        p.add_argument(*names.split(), **options)
    kind = p.add_mutually_exclusive_group()
    for name, text in (("--no-scores", "no reward model"), ("--orm", "score outcomes instead of steps")):
        kind.add_argument(name, help=text, action="store_true")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    fail = lambda text: print(text, file=sys.stderr) or 2
    if a.k < 1:
        return fail("-k must be at least 1")
    names = [x.strip() for x in a.compare.split(",") if x.strip()] if a.compare else [a.backend]
    if unknown := [n for n in names if n not in generators.GENERATORS]:
        return fail(f"unknown backends: {', '.join(unknown)}")
    if a.compare and len(names) < 2:
        return fail("--compare needs two backends")
    if not a.problems and a.report_only is None:
        return fail("--problems is missing")
    if a.k > 1 and a.temperature == 0:
        print("at temperature 0 all samples are the same", file=sys.stderr)
    spark = session.build(a.master)
    config = evaluate.Config(a.questions, a.question, names[0], a.model, a.k, a.max_tokens, a.temperature, not a.no_scores, "orm" if a.orm else "prm", a.four_bits, not a.no_resume, a.think, a.out, report=a.report, reports=not a.no_report)
    if a.report_only is not None:
        return _report_only(spark, a, fail)
    table = problems.load(spark, a.problems)
    say = (lambda text: None) if a.quiet else print
    if a.compare:
        found = evaluate.compare_backends(spark, table, [replace(config, backend=n, canonical=False) for n in names], say=say)
        print("\n".join(f"{r['a']} / {r['b']}: {report.pct(r['agreement'])}" for r in found["agreement"]))
        print(f"{found['num_divergences']} questions on which they differ")
        return 0
    rows, about = evaluate.run(spark, table, config, say=say)
    if not a.quiet:
        evaluate.transcript(evaluate._all_samples(spark, config, config.fingerprint()), f"{a.out}/eval_debug_{config.backend}")
    evaluate.finish(rows, about, config)
    return 0


def _report_only(spark, a, fail) -> int:
    """Reports from the named document, or from eval_results.json, or from those of all backends with their comparison."""
    folder = Path(a.out)
    usual = folder / "eval_results.json"
    found = [Path(a.report_only)] if a.report_only else [usual] if usual.exists() else sorted(folder.glob("eval_results_*.json"))
    if not found:
        return fail(f"no results in {a.out}")
    compared = results.read_comparison(str(folder / "eval_comparison.json")) if len(found) > 1 else None
    for path in found:
        rows = results.read_any(spark, str(path))
        if rows.isEmpty():
            return fail("no results")
        stored = results.read_summary(str(path))
        about = {k: v for k, v in (stored.get("summary") or stored).items() if k in _ABOUT}
        payload = report.collect_payload(rows, about) | ({"comparison": report.shown_comparison(compared)} if compared else {})
        backend = path.stem.removeprefix("eval_results_") if path.stem.startswith("eval_results_") else about.get("backend") or a.backend
        for t in report.targets(a.report, backend, payload["summary"]["questions"], len(found) == 1):
            evaluate.emit(payload, f"{a.out}/{t}")
    return 0


#: What a report takes from a stored summary; all figures are made anew.
_ABOUT = ("model", "backend", "k", "synthetic", "scorer_kind", "scorer_model", "duration_s", "timestamp")


if __name__ == "__main__":
    sys.exit(main())
