"""A whole run: problems, responses, answers, scores, verdicts, choice, storage, report.

The stages are one lazy plan for each chunk of problems; a chunk is written to the log
before the next is asked, so that a crash loses at most one chunk and no response is
paid for twice.  Responses are written before they are graded, for the same reason.
"""

from __future__ import annotations

import hashlib
import json
import sys
import time
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, grading, runs, selection
from ..sources import generators, results, scorers
from ..sources.problems import first
from . import report


@dataclass(frozen=True)
class Config:
    questions: int = 3
    question: int | None = None
    backend: str = "mock"
    model: str | None = None
    k: int = 1
    max_tokens: int = 16384
    temperature: float | None = None
    scoring: bool = True
    scorer: str = "prm"
    four_bits: bool | None = False
    resume: bool = True
    think: str = "merge"
    out: str = "."
    chunk: int = 1000
    report: str = "report.html"
    canonical: bool = True
    reports: bool = True

    def heat(self) -> float:
        """Several samples of temperature 0 would be the same one."""
        usual = 0.7 if self.k > 1 else 0.0
        return usual if self.temperature is None else self.temperature

    def fingerprint(self) -> str:
        """Names what results depend on; the number of questions isn't part of it, so a run can be extended."""
        parts = {n: getattr(self, n) for n in ("backend", "k", "max_tokens", "model", "scoring")} | {"heat": self.heat(), "prompt": "solve-briefly-boxed-1"}
        if self.scoring:
            parts |= {"four_bits": self.four_bits, "scorer": self.scorer}
        if self.backend == "qwen":
            parts["think"] = self.think
        return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()[:16]

    def log_root(self) -> str:
        return f"{self.out}/checkpoint"


def solve(problems: DataFrame, config: Config, generator, scorer, scratch: str) -> DataFrame:
    """Samples of the problems, graded: one row for each (index, sample_index)."""
    asked = problems.withColumn("sample_index", F.explode(F.sequence(F.lit(0), F.lit(config.k - 1)))).withColumn("prompt", generators.prompt(F.col("problem")))
    made = generator.generate(asked.withColumn("started", F.lit(time.time())), config.heat(), config.max_tokens)
    made.drop("started").write.mode("overwrite").parquet(scratch)
    stored = problems.sparkSession.read.parquet(scratch)
    read = grading.read_steps(grading.read_answers(stored))
    scored = scorer.score(read).withColumn("milli", F.round(F.col("score") * 1000).cast("int"))
    graded = grading.grade(scored.withColumnRenamed("answer", "expected"))
    return graded.withColumnRenamed("total_tokens", "tokens").drop("prompt", "score")


def headline(samples: DataFrame) -> DataFrame:
    """A result row for each question: the first sample's fields and the choice of every strategy."""
    chosen = selection.selections(selection.equivalence_classes(samples), "class")
    picks = chosen.groupBy("index").agg(F.map_from_entries(F.collect_list(F.struct("strategy", F.struct("predicted", F.col("ok").alias("correct"), "milli")))).alias("selection"))
    told = [c for c in samples.columns if c not in ("index", "problem", "expected", "subject", "level", "text", "prompt", "started")]
    counted = samples.groupBy("index").agg(F.count("*").cast("int").alias("k"), F.array_sort(F.collect_list(F.struct("sample_index", *[c for c in told if c != "sample_index"]))).alias("samples"))
    first = samples.where("sample_index = 0").withColumn("difficulty", F.col("level").cast("string")).drop("sample_index", "level", "text")
    return first.join(picks, "index").join(counted, "index")


def run(spark: SparkSession, problems: DataFrame, config: Config, generator=None, scorer=None, say: Callable[[str], None] = print) -> tuple[DataFrame, dict]:
    """(result rows, summary).  Problems are (index, problem, answer, subject, level)."""
    generator = generator or generators.build(config.backend, **({"think": config.think} if config.backend == "qwen" else {}))
    scorer = scorer or scorers.build(config.scoring and config.backend != "mock", config.scorer)
    began, fp, log = time.monotonic(), config.fingerprint(), results.Log(spark, config.log_root())
    if not config.resume:
        log.clear(fp)
    wanted = problems.where(F.col("index") == config.question - 1) if config.question is not None else first(problems, config.questions)
    done = log.rows(fp)
    todo = wanted if done is None or config.question is not None else runs.pending(wanted, done.select("index").distinct())
    chunks = [r[0] for r in todo.select(F.floor(F.col("index") / config.chunk).alias("c")).distinct().orderBy("c").collect()]
    number = log.next_chunk(fp)
    for n, c in enumerate(chunks):
        part = todo.where(F.floor(F.col("index") / config.chunk) == c)
        say(f"[{n + 1}/{len(chunks)}] questions from {c * config.chunk}")
        log.append(solve(part, config, generator, scorer, f"{config.log_root()}/responses={fp}/chunk={number + n}"), fp, number + n)
    stored = log.rows(fp)
    if stored is None:
        raise ValueError("no questions")
    # written once: every figure of the report reads these rows
    table = f"{config.log_root()}/rows={fp}"
    headline(_all_samples(spark, config, fp).join(wanted.select("index"), "index", "left_semi")).write.mode("overwrite").parquet(table)
    rows = spark.read.parquet(table)
    about = {
        "model": config.model or generators.MODELS.get(config.backend, config.backend), "backend": config.backend, "k": config.k, "synthetic": bool(getattr(generator, "synthetic", False)),
        "scorer_kind": scorer.kind, "scorer_model": scorer.model, "duration_s": round(time.monotonic() - began, 1), "timestamp": datetime.now().isoformat(timespec="seconds"),
    }
    return rows, about


def _all_samples(spark: SparkSession, config: Config, fp: str) -> DataFrame:
    """The last row of each question and sample in the log."""
    df = spark.read.parquet(f"{config.log_root()}/fingerprint={fp}")
    row = F.struct(*[c for c in df.columns if c not in ("index", "sample_index")])
    return df.groupBy("index", "sample_index").agg(F.max_by(row, "_chunk").alias("r")).select("index", "sample_index", "r.*").drop("_chunk")


def transcript(samples: DataFrame, path: str) -> None:
    """What was asked and said, as text files of one line a field; written by the tasks, so of any length."""
    shown = [c for c in ("prompt", "text", "expected", "predicted", "ok", "milli", "tokens") if c in samples.columns]
    parts = [F.concat(F.lit(f"  {c}: "), F.coalesce(F.regexp_replace(F.col(c).cast("string"), "\n", "\n    | "), F.lit("(none)"))) for c in shown]
    head = F.format_string("question %d, sample %d", F.col("index") + 1, F.col("sample_index") + 1)
    samples.select(F.concat_ws("\n", head, *parts).alias("value")).write.mode("overwrite").text(path)


def merged(rows: DataFrame, config: Config) -> DataFrame:
    """A single question's row put into the stored results of the run it belongs to, if there are any; written down, because these are replaced."""
    stored = Path(config.out) / f"eval_results_{config.backend}.json"
    if config.question is None or not stored.exists():
        return rows
    spark, table = rows.sparkSession, f"{config.log_root()}/merged={config.fingerprint()}"
    runs.splice(results.read_own(spark, str(stored), rows.schema), rows, "index").write.mode("overwrite").parquet(table)
    return spark.read.parquet(table)


def finish(rows: DataFrame, about: dict, config: Config, samples: DataFrame | None = None, comparison: DataFrame | None = None, say: Callable[[str], None] = print) -> dict:
    """Stores rows and summary, archives what was there, writes the reports that the size earns.

    A single question goes into the stored results.  The log of a run that is stored has served and
    goes, so that the same run asks anew.
    """
    out = Path(config.out)
    out.mkdir(parents=True, exist_ok=True)
    rows = merged(rows, config)
    payload = report.collect_payload(rows, about, samples, comparison)
    name = f"eval_results_{config.backend}.json"
    n = payload["summary"]["questions"]
    pages = [str(out / t) for t in report.targets(config.report, config.backend, n, config.canonical)]
    results.archive(str(out / "logs"), datetime.now().strftime("%Y%m%d_%H%M%S"), str(out / name), *pages)
    results.write_json({k: v for k, v in payload.items() if k != "questions"}, rows, str(out / name))
    for page in pages if config.reports else []:
        emit(payload, page)
    say(summary_text(payload))
    if config.question is None:
        results.Log(rows.sparkSession, config.log_root()).clear(config.fingerprint())
    return payload


def emit(payload: dict, path: str) -> str | None:
    """Writes a report; a failure to is told, and no failure of the run."""
    try:
        return report.write(payload, path)
    except Exception as error:  # noqa: BLE001
        print(f"no report at {path}: {error}", file=sys.stderr)
        return None


def summary_text(payload: dict) -> str:
    s = payload["summary"]
    lines = [f"accuracy {report.pct(s['accuracy'])} ({s['correct']} of {s['questions']})", f"unread answers {s['parse_failures']}, empty {s['empty_responses']}, tokens {s['total_tokens']}"]
    if payload["calibration"]["n"]:
        lines.append(report.verdict_words(payload["calibration"]))
    lines += [f"{x['strategy']}: {report.pct(x['accuracy'])} ({x['delta']:+.1f})" for x in payload.get("selection", [])]
    return "\n".join(lines)


def compare_backends(spark: SparkSession, problems: DataFrame, configs: list[Config], made: dict | None = None, say: Callable[[str], None] = print) -> dict:
    """Runs each configuration on the same problems and compares them by position; ``made`` has generators by backend.

    Writes each one's results, eval_comparison.json over all, and a report for each with the comparison in it.
    """
    if len(configs) < 2:
        raise ValueError("a comparison needs two backends")
    long, finished = None, []
    for n, config in enumerate(configs):
        rows, about = run(spark, problems, config, (made or {}).get(config.backend), say=say)
        payload = finish(rows, about, replace(config, reports=False), say=say)
        finished.append((config, rows, about, payload["summary"]))
        one = rows.select(F.lit(config.backend).alias("backend"), F.lit(n).alias("ord"), "index", "ok", "predicted", "milli", "problem", "expected", "subject", "difficulty")
        long = one if long is None else long.unionByName(one)
    table = f"{configs[0].log_root()}/compared"
    compare.positions(long, "index").write.mode("overwrite").parquet(table)
    aligned = spark.read.parquet(table)
    details = compare.divergence_details(aligned)
    found = {
        "backends": [c.backend for c in configs], "accuracy": report._dicts(compare.accuracy(aligned)), "agreement": report._dicts(compare.agreement(aligned)), "num_divergences": details.count(),
        "summaries": {c.backend: s for c, _, _, s in finished}, "results_files": {c.backend: f"eval_results_{c.backend}.json" for c in configs},
        "report_files": {c.backend: report.targets(c.report, c.backend, s["questions"], False) for c, _, _, s in finished}, "timestamp": datetime.now().isoformat(timespec="seconds"),
    }
    results.write_json(found, details.orderBy("pos"), str(Path(configs[0].out) / "eval_comparison.json"), "divergences")
    found["divergences"] = report._dicts(compare.top_divergences(aligned))
    for config, rows, about, _ in finished if configs[0].reports else []:
        payload = report.collect_payload(rows, about) | {"comparison": found}
        for page in found["report_files"][config.backend]:
            emit(payload, str(Path(config.out) / page))
    return found
