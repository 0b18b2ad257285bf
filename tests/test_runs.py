"""Sources, storage, whole runs, reports, the command line and streams."""

import json

import pytest
from pyspark.sql import functions as F

from verdica import cli
from verdica.operators import grading, numbering, runs
from verdica.plans import evaluate, report
from verdica.sources import generators, problems, results, scorers
from verdica.streaming import ingest


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([(i, f"What is {i} times 3?", str(3 * i), ["Algebra", "Geometry", None][i % 3], i % 5 + 1) for i in range(24)], "index int, problem string, answer string, subject string, level int").cache()


class Counting(generators.Mock):
    asked = 0

    def generate(self, rows, temperature=0.0, max_tokens=0):
        Counting.asked += rows.count()
        return super().generate(rows, temperature, max_tokens)


def test_a_run_resumes_extends_and_is_invalidated(spark, questions, tmp_path):
    Counting.asked = 0
    config = evaluate.Config(questions=8, out=str(tmp_path), chunk=4)
    quiet = {"say": lambda _: None}
    rows, about = evaluate.run(spark, questions, config, Counting(), **quiet)
    assert rows.count() == 8 and Counting.asked == 8 and about["synthetic"]
    evaluate.run(spark, questions, config, Counting(), **quiet)
    assert Counting.asked == 8
    rows, _ = evaluate.run(spark, questions, evaluate.Config(questions=12, out=str(tmp_path), chunk=4), Counting(), **quiet)
    assert Counting.asked == 12 and rows.count() == 12
    evaluate.run(spark, questions, evaluate.Config(questions=4, out=str(tmp_path), max_tokens=9, chunk=4), Counting(), **quiet)
    assert Counting.asked == 16
    evaluate.run(spark, questions, evaluate.Config(question=3, out=str(tmp_path), chunk=4), Counting(), **quiet)
    assert Counting.asked == 17
    evaluate.run(spark, questions, evaluate.Config(questions=8, out=str(tmp_path), resume=False, chunk=4), Counting(), **quiet)
    assert Counting.asked == 25


def test_a_crash_loses_one_chunk(spark, questions, tmp_path):
    class Crashing(Counting):
        def generate(self, rows, temperature=0.0, max_tokens=0):
            if rows.where("index >= 8").count():
                raise RuntimeError("crash")
            return super().generate(rows, temperature, max_tokens)

    Counting.asked = 0
    config = evaluate.Config(questions=12, out=str(tmp_path), chunk=4)
    with pytest.raises(RuntimeError):
        evaluate.run(spark, questions, config, Crashing(), say=lambda _: None)
    rows, _ = evaluate.run(spark, questions, config, Counting(), say=lambda _: None)
    assert Counting.asked == 12 and rows.count() == 12


def test_samples_and_choice(spark, questions, tmp_path):
    config = evaluate.Config(questions=6, k=3, out=str(tmp_path))
    rows, about = evaluate.run(spark, questions, config, say=lambda _: None)
    assert about["k"] == 3 and config.heat() == 0.7
    for r in rows.collect():
        assert set(r["selection"]) == {"first", "majority", "best", "weighted"} and r["k"] == 3
        assert r["selection"]["first"]["predicted"] == r["predicted"] and r["selection"]["first"]["correct"] == r["ok"]


def test_finish_writes_what_the_size_earns(spark, questions, tmp_path):
    config = evaluate.Config(questions=10, out=str(tmp_path))
    rows, about = evaluate.run(spark, questions, config, say=lambda _: None)
    said = []
    payload = evaluate.finish(rows, about, config, say=said.append)
    assert (tmp_path / "report_mock_partial.html").exists() and not (tmp_path / "report.html").exists()
    page = (tmp_path / "report_mock_partial.html").read_text()
    assert "<script" not in page and "http" not in page and "Synthetic" in page
    stored = json.loads((tmp_path / "eval_results_mock.json").read_text())
    assert len(stored["results"]) == 10 and stored["summary"]["questions"] == 10 == payload["summary"]["questions"] and "accuracy" in said[0]
    evaluate.finish(rows, about, config, say=said.append)
    assert len(list((tmp_path / "logs").iterdir())) == 2
    assert results.read_own(spark, str(tmp_path / "eval_results_mock.json")).count() == 10


def test_targets():
    assert report.targets("a/report.html", "x", 499) == ["a/report_x_partial.html"]
    assert report.targets("report.html", "x", 500) == ["report.html", "report_x.html"] and report.targets("report.html", "x", 500, False) == ["report_x.html"]


def test_comparison(spark, questions, tmp_path):
    configs = [evaluate.Config(questions=12, backend=b, scoring=False, canonical=False, out=str(tmp_path)) for b in ("mock", "qwen")]
    found = evaluate.compare_backends(spark, questions, configs, {"qwen": generators.Mock(0.2, seed=1)}, say=lambda _: None)
    share = {a["backend"]: a["correct"] for a in found["accuracy"]}
    assert set(share) == {"mock", "qwen"} and share["qwen"] < share["mock"] and found["agreement"][0]["total"] == 12
    assert len(found["divergences"]) == 12 - found["agreement"][0]["agree"]
    with pytest.raises(ValueError):
        evaluate.compare_backends(spark, questions, configs[:1])


def test_fingerprints():
    base = evaluate.Config()
    assert base.fingerprint() == evaluate.Config(questions=99, out="x").fingerprint()
    others = [evaluate.Config(k=2), evaluate.Config(max_tokens=1), evaluate.Config(scorer="orm"), evaluate.Config(four_bits=None), evaluate.Config(scoring=False), evaluate.Config(backend="qwen")]
    assert len({c.fingerprint() for c in [base, *others]}) == 7
    assert evaluate.Config(think="off").fingerprint() == base.fingerprint()
    assert evaluate.Config(scoring=False, scorer="orm").fingerprint() == evaluate.Config(scoring=False).fingerprint()


def test_checkpoint_logs(spark, tmp_path):
    row = lambda i, p: json.dumps({"index": i, "problem": p})
    log = tmp_path / "log.jsonl"
    log.write_text("\n".join(['{"fingerprint": "f"}', row(1, "a"), "", row(2, "b"), row(1, "c"), '{"index": 3, "prob', row(4, "d")]))
    read = lambda fp: {r["index"]: r["problem"] for r in results.checkpoint_rows(results.checkpoint_lines(spark, str(log)), fp).collect()}
    assert read("f") == {1: "c", 2: "b"} and read("g") == {}
    log.write_text("not json\n" + row(1, "a"))
    assert read("f") == {}
    log.write_text("")
    assert read("f") == {}


def test_result_documents_of_older_runs(spark, tmp_path):
    for name, rows in (("eval_results_qwen.json", [{"problem": "p", "prm_score": 0.5, "answer_accuracy": True}, None, {"index": 9}]), ("eval_results_gemini.json", [{"index": 4}])):
        (tmp_path / name).write_text(json.dumps({"accuracy": 1, "results": rows}, indent=1))
    got = {(r["backend"], r["index"]): r["prm_score"] for r in results.read_json(spark, f"{tmp_path}/eval_results_*.json").collect()}
    assert got == {("qwen", 0): 0.5, ("qwen", 9): None, ("gemini", 4): None}


def test_splice_and_regrade(spark):
    rows = spark.createDataFrame([(0, "1", "1", True), (1, "2", "2.0", False), (2, "3", "4", True), (3, "5", None, False)], "pos int, expected string, predicted string, ok boolean")
    put = runs.splice(rows, spark.createDataFrame([(1, "9", "9", True), (7, "x", "x", True)], rows.schema))
    assert {(r["pos"], r["expected"]) for r in put.collect()} == {(0, "1"), (1, "9"), (2, "3"), (3, "5"), (7, "x")}
    again = runs.regrade(rows)
    one = runs.regrade_report(again).first()
    assert tuple(one) == (4, 2, 2, 1, 1, 2, 1)
    assert again.columns == ["pos", "expected", "predicted", "was", "ok"]
    a, b = (spark.createDataFrame([("first", x), ("best", 0.5)], "strategy string, accuracy double") for x in (0.1, 0.2))
    assert [r["strategy"] for r in runs.strategy_changes(a, b).collect()] == ["first"]


def test_grading_splits_off_what_needs_no_scanner(spark):
    rows = spark.createDataFrame([("1/2", "0.5"), ("7", "7"), ("7", "8"), (None, "x"), ("5", None), ("5", ""), ("07", "7")], "expected string, predicted string")
    got = {(r["expected"], r["predicted"]): r["ok"] for r in grading.grade(rows).collect()}
    assert got == {("1/2", "0.5"): True, ("7", "7"): True, ("7", "8"): False, (None, "x"): False, ("5", None): False, ("5", ""): False, ("07", "7"): True}


def test_problems(spark, tmp_path):
    rows = spark.range(0, 500).select((F.col("id") * 7 % 500).alias("k"))
    made = problems.from_table(rows, "k", F.col("k").cast("string").alias("p"), "k")
    assert {(r["index"], r["answer"]) for r in made.collect()} == {(i, str(i)) for i in range(500)}
    for text in (False, True):
        ranged = rows.withColumn("g", F.col("k") % 3).withColumn("t", F.format_string("%05d", "k") if text else F.col("k"))
        got = numbering.number(ranged, "t", "n", "g", 40).collect()
        assert {(r["k"], r["n"]) for r in got} == {(i, i // 3) for i in range(500)} and len(numbering.bounds(ranged, "t", 40)) > 5
    made.write.parquet(str(tmp_path / "p"))
    assert problems.load(spark, str(tmp_path / "p"), limit=5).count() == 5 and [r["answer"] for r in problems.load(spark, str(tmp_path / "p"), question=3).collect()] == ["2"]


def test_mock_is_repeatable_and_draws_only_when_warm(spark):
    rows = spark.createDataFrame([(i % 40, f"q{i % 40}", str(i % 40), i // 40) for i in range(120)], "index int, prompt string, answer string, sample_index int")
    texts = lambda t: {(r["index"], r["sample_index"]): r["text"] for r in generators.Mock().generate(rows, t).collect()}
    cold, warm = texts(0.0), texts(0.7)
    assert all(cold[i, 0] == cold[i, 1] == cold[i, 2] for i in range(40)) and cold == texts(0.0)
    assert any(warm[i, 0] != warm[i, 1] for i in range(40))
    right = sum(f"boxed{{{i}}}" in cold[i, 0] for i in range(40))
    assert 14 <= right <= 34


def test_generators():
    waits = []
    calls = iter([OSError("a"), OSError("b"), 5])

    def call():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert generators.retrying(call, (OSError,), sleep=waits.append) == 5 and 1.5 <= waits[0] <= 2.5 <= waits[1]
    with pytest.raises(RuntimeError):
        generators.retrying(lambda: (_ for _ in ()).throw(OSError("x")), (OSError,), 3, waits.append)
    with pytest.raises(KeyError):
        generators.retrying(lambda: {}["x"], (OSError,))
    with pytest.raises(ValueError):
        generators.build("nobody")
    o = generators.build("qwen", think="off")
    assert o.body("p", 0.1, 5)["think"] is False and "think" not in generators.Ollama().body("p", 0.1, 5)
    assert generators.Ollama.read({"thinking": "t", "response": "r", "eval_count": 2, "prompt_eval_count": None}) == {"text": "t\n\nr", "prompt_tokens": 0, "eval_tokens": 2, "total_tokens": 2, "warning": None}
    assert generators.Ollama.read({"done_reason": "length"})["warning"] == "no text: length"
    with pytest.raises(ValueError):
        generators.Ollama(think="loud")


def test_scorers(spark):
    rows = spark.createDataFrame([("p", ["s1", "s2"], "text"), ("p", [], ""), ("p", ["s1"], None)], "problem string, steps array<string>, text string")
    step = scorers.StepScorer(lambda: lambda text: [{"entity": "LABEL_0", "score": 0.1 * text.count("s")}] if "s2" not in text else [])
    got = [(r["step_scores"], r["score"]) for r in step.score(rows).collect()]
    assert got == [([0.9, 0.0], 0.45), ([], None), ([0.9], 0.9)]
    outcome = scorers.OutcomeScorer(lambda: lambda problem, solution: 0.25 if solution == "text" else 0.75)
    assert [(r["step_scores"], r["score"]) for r in outcome.score(rows).collect()] == [([], 0.25), ([], None), ([], 0.75)]
    assert scorers.positive_share(1000, -1000) == 1.0 and scorers.positive_share(-1000, 1000) == 0.0 and scorers.positive_share(2, 2) == 0.5
    cuda = frozenset({"cuda"})
    assert scorers.quantise(None, "cuda", cuda) and not scorers.quantise(None, "cpu", cuda | {"cpu"}) and not scorers.quantise(False, "cuda", cuda)
    with pytest.raises(RuntimeError):
        scorers.quantise(True, "mps", cuda)
    scorers.check_verdict([1, 7, 9], 7)
    with pytest.raises(RuntimeError):
        scorers.check_verdict([1, 7, 9], 9)
    assert isinstance(scorers.build(False, "orm"), scorers.NoScorer)
    with pytest.raises(ValueError):
        scorers.build(True, "what")


def test_archives_never_overwrite(tmp_path):
    for n in range(3):
        (tmp_path / "r.html").write_text(str(n))
        results.archive(str(tmp_path / "logs"), "s", str(tmp_path / "r.html"), str(tmp_path / "absent"))
    assert sorted((p.name, p.read_text()) for p in (tmp_path / "logs").iterdir()) == [("r_s.html", "0"), ("r_s_2.html", "1"), ("r_s_3.html", "2")]
    (tmp_path / "x").write_text("old")
    results.rewrite(str(tmp_path / "x"), lambda p: (tmp_path / "x").write_text("new"))
    assert (tmp_path / "x.bak").read_text() == "old" and (tmp_path / "x").read_text() == "new"


def test_reports_escape_and_bear_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(0, "<b>&", "<script>", None)], "index int, problem string, predicted string, ok boolean")
    page = report.render(report.collect_payload(rows, {"model": "<m>"}))
    assert "<script>" not in page and "&lt;b&gt;&amp;" in page and "can&#x27;t be said" not in page
    assert report.bars([], "t") == report.heatmap([], "t") == report.calibration_chart([]) == report.histogram([]) == ""
    assert evaluate.emit({"summary": {}}, str(tmp_path / "x" / "r.html")) and evaluate.emit({}, str(tmp_path / "y.html")) is None


def test_command_line(spark, questions, tmp_path, capsys, monkeypatch):
    questions.write.mode("overwrite").parquet(str(tmp_path / "problems"))
    monkeypatch.setattr(cli.session, "build", lambda master: spark)
    for bad in (["-k", "0"], ["--compare", "mock"], ["--compare", "mock,nobody"], []):
        assert cli.main(bad) == 2
    with pytest.raises(SystemExit):
        cli.main(["--no-scores", "--orm"])
    out = ["--problems", str(tmp_path / "problems"), "--out", str(tmp_path / "out"), "-n", "5"]
    assert cli.main(out) == 0 and "accuracy" in capsys.readouterr().out
    assert cli.main([*out, "--report-only", str(tmp_path / "out" / "eval_results_mock.json")]) == 0


def test_streams(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "table")
    source.mkdir()
    schema = "index int, subject string, ok boolean"

    def drop(name, rows):
        (source / name).write_text("\n".join(json.dumps(r) for r in rows))
        ingest.into_table(ingest.rows(spark, str(source), schema), target, str(tmp_path / "cp")).awaitTermination()
        return {r["index"]: r["ok"] for r in ingest.latest_rows(spark, target).collect()}

    assert drop("a.json", [{"index": 1, "subject": "x", "ok": True}, {"index": 2, "subject": "x", "ok": False}, {"subject": "x"}]) == {1: True, 2: False}
    assert drop("b.json", [{"index": 2, "subject": "x", "ok": True}]) == {1: True, 2: True}
    q = ingest.running_accuracy(ingest.rows(spark, str(source), schema)).writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select correct, total from running").collect()[0][:] == (2, 4)


def test_the_scanner_needs_no_model_libraries():
    import subprocess
    import sys

    code = "import sys; import verdica.functions.latex, verdica.functions.extract, verdica.sources.scorers; assert not {'torch', 'transformers', 'sympy', 'datasets'} & set(sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=str(__import__("pathlib").Path(__file__).resolve().parents[1])).returncode == 0


def test_reports_show_every_question(spark):
    rows = spark.range(1200).selectExpr("id as index", "'p' as problem", "'1' as expected", "id % 2 = 0 as ok")
    page = report.render(report.collect_payload(rows))
    assert page.count("<details") == 1200 and "The first" not in page
    page = report.render(report.collect_payload(rows, questions=10))
    assert page.count("<details") == 10 and "The first 10 of 1200." in page


def test_a_stored_run_asks_anew_and_keeps_its_samples(spark, questions, tmp_path):
    Counting.asked = 0
    config = evaluate.Config(questions=4, k=2, out=str(tmp_path))
    for n in (1, 2):
        rows, about = evaluate.run(spark, questions, config, Counting(), say=lambda _: None)
        evaluate.finish(rows, about, config, say=lambda _: None)
        assert Counting.asked == 8 * n
    stored = json.loads((tmp_path / "eval_results_mock.json").read_text())["results"]
    assert all([s["sample_index"] for s in r["samples"]] == [0, 1] and "text" not in r["samples"][0] and r["samples"][0]["predicted"] == r["predicted"] for r in stored)
    one = evaluate.Config(question=2, k=2, out=str(tmp_path))
    rows, about = evaluate.run(spark, questions, one, generators.Mock(1.0), say=lambda _: None)
    evaluate.finish(rows, about, one, say=lambda _: None)
    again = {r["index"]: r for r in json.loads((tmp_path / "eval_results_mock.json").read_text())["results"]}
    assert sorted(again) == [0, 1, 2, 3] and again[1]["ok"] and again[0]["predicted"] == next(r for r in stored if r["index"] == 0)["predicted"]


def test_comparison_is_stored_and_reported(spark, questions, tmp_path, monkeypatch):
    configs = [evaluate.Config(questions=12, backend=b, scoring=False, canonical=False, out=str(tmp_path)) for b in ("mock", "qwen")]
    found = evaluate.compare_backends(spark, questions, configs, {"qwen": generators.Mock(0.2, seed=1)}, say=lambda _: None)
    stored = results.read_comparison(str(tmp_path / "eval_comparison.json"))
    assert stored["backends"] == ["mock", "qwen"] and len(stored["divergences"]) == stored["num_divergences"] == found["num_divergences"] > 0
    d = stored["divergences"][0]
    assert set(d["outcomes"]) == set(d["predicted"]) == {"mock", "qwen"} and d["problem"].startswith("What is") and d["outcomes"]["mock"] != d["outcomes"]["qwen"]
    for b in ("mock", "qwen"):
        assert "Where they differ" in (tmp_path / f"report_{b}_partial.html").read_text()
        (tmp_path / f"report_{b}_partial.html").unlink()
    monkeypatch.setattr(cli.session, "build", lambda master: spark)
    assert cli.main(["--out", str(tmp_path), "--report-only"]) == 0
    assert all("Where they differ" in (tmp_path / f"report_{b}_partial.html").read_text() for b in ("mock", "qwen"))
    assert cli.main(["--out", str(tmp_path / "nothing"), "--report-only"]) == 2
    assert results.read_comparison(str(tmp_path / "none.json")) is None


def test_quiet_and_without_reports(spark, questions, tmp_path, monkeypatch, capsys):
    questions.write.parquet(str(tmp_path / "p"))
    monkeypatch.setattr(cli.session, "build", lambda master: spark)
    out = ["--problems", str(tmp_path / "p"), "-n", "2"]
    assert cli.main([*out, "--out", str(tmp_path / "a"), "--quiet", "--no-report"]) == 0
    assert not list((tmp_path / "a").glob("*.html")) and not (tmp_path / "a" / "eval_debug_mock").exists()
    assert cli.main([*out, "--out", str(tmp_path / "b")]) == 0
    told = "\n".join(p.read_text() for p in (tmp_path / "b" / "eval_debug_mock").glob("part-*"))
    assert "question 1, sample 1" in told and "boxed" in told and list((tmp_path / "b").glob("*.html"))


def test_regrade_command(spark, tmp_path, monkeypatch, capsys):
    from verdica import regrade

    monkeypatch.setattr(regrade.session, "build", lambda master: spark)
    path = tmp_path / "eval_results_mock.json"
    rows = [(0, "1/2", "0.5", False), (1, "3", "4", True), (2, "5", None, False)]
    made = spark.createDataFrame(rows, "index int, expected string, predicted string, ok boolean").selectExpr(
        "*", "array(named_struct('sample_index', 0, 'predicted', predicted, 'ok', ok)) as samples", "map('first', named_struct('predicted', predicted, 'correct', ok)) as selection"
    )
    results.write_json({"summary": {"backend": "mock", "model": "m"}}, made, str(path))
    was = path.read_text()
    assert regrade.main(["--results", str(path)]) == 0 and path.read_text() == was and not (tmp_path / "eval_results_mock.json.bak").exists()
    said = capsys.readouterr().out
    assert "+ [0] '1/2' <- '0.5'" in said and "- [1] '3' <- '4'" in said and "nothing written" in said
    assert regrade.main(["--results", str(path), "--write", "--report"]) == 0
    assert (tmp_path / "eval_results_mock.json.bak").read_text() == was and (tmp_path / "report_mock_partial.html").exists()
    again = {r["index"]: r for r in json.loads(path.read_text())["results"]}
    assert [again[i]["ok"] for i in range(3)] == [True, False, False] and again[0]["samples"][0]["ok"] and again[0]["selection"]["first"]["correct"]
    assert json.loads(path.read_text())["regraded"] and regrade.main(["--results", str(tmp_path / "none")]) == 2


def test_audit_command(spark, tmp_path, monkeypatch, capsys):
    from verdica import audit

    answers = ["\\frac{1}{2}", "12", "90", "90^\\circ", "5", "x=5", "7"]
    spark.createDataFrame([(i, "p", a, None, None) for i, a in enumerate(answers)], "index int, problem string, answer string, subject string, level int").write.parquet(str(tmp_path / "p"))
    monkeypatch.setattr(audit.session, "build", lambda master: spark)
    assert audit.main(["--problems", str(tmp_path / "p")]) == 0
    said = capsys.readouterr().out
    assert "old form: 2 collisions, 1 of equal answers, 1 FALSE" in said and "new form: 1 collisions, 1 of equal answers, 0 FALSE" in said and "by presentation alone" in said
    found = spark.createDataFrame([(f"{i:03d}", 2) for i in range(30)], "form string, variants int")
    assert [r["form"] for r in audit.first_collisions(found).collect()] == [f"{i:03d}" for i in range(12)]


def test_problem_sets_with_gaps_and_without_an_index(spark, tmp_path):
    gaps = spark.createDataFrame([(i * 7, "p", "a", "s", 1) for i in range(20)], "index int, problem string, answer string, subject string, level int")
    gaps.write.parquet(str(tmp_path / "p"))
    assert sorted(r["index"] for r in problems.load(spark, str(tmp_path / "p"), limit=3).collect()) == [0, 7, 14]
    (tmp_path / "q.jsonl").write_text("\n".join(json.dumps({"unique_id": f"u{i}", "problem": f"p{i}", "answer": str(i), "subject": "s", "level": 2}) for i in range(5)))
    assert [(r["index"], r["answer"]) for r in problems.load(spark, str(tmp_path / "q.jsonl"), question=4).collect()] == [(3, "3")]
