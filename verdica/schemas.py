"""Declared schemas; no reader infers one."""

PROBLEM = "index int, problem string, answer string, subject string, level int"
SAMPLE = (
    "predicted string, parse_matched boolean, answer_accuracy boolean, prm_score double, step_prm_scores array<double>, steps array<string>, "
    "num_steps int, prompt_tokens int, eval_tokens int, total_tokens int, latency_s double"
)
CHOICE = "predicted string, correct boolean, prm_score double"


def _nested(fields: str) -> str:
    return "struct<" + ",".join(f.replace(" ", ":", 1) for f in fields.split(", ")) + ">"


RESULT = (
    "index int, problem string, expected string, subject string, difficulty int, k int, "
    f"selection map<string,{_nested(CHOICE)}>, samples array<{_nested(SAMPLE)}>, {SAMPLE}"
)
GENERATION = "text string, prompt_tokens int, eval_tokens int, total_tokens int, warning string"
OWN = (
    "index int, problem string, expected string, subject string, difficulty string, predicted string, matched boolean, ok boolean, milli bigint, tokens bigint, "
    "steps array<string>, step_scores array<double>, k int, selection map<string,struct<predicted:string,correct:boolean,milli:bigint>>, "
    "samples array<struct<sample_index:int,predicted:string,matched:boolean,ok:boolean,milli:bigint,tokens:bigint,steps:array<string>,step_scores:array<double>>>"
)
