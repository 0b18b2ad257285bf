"""A self-contained page from small aggregates: no script, no address outside.

Everything here is collected already; only ``collect_payload`` touches tables, and what it
takes from them are aggregates, and all rows for the questions: the page grows with the run.
A caller may bound them to the first ``questions`` rows, which the page then says.
"""

from __future__ import annotations

import html
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compare, selection, stats

FULL_RUN = 500


def suffixed(path: str, name: str) -> str:
    p = Path(path)
    return str(p.with_name(f"{p.stem}_{name}{p.suffix or '.html'}"))


def targets(path: str, backend: str, questions: int, canonical=True) -> list[str]:
    """The files that a run of this size may write: only a full one owns the headline."""
    if questions < FULL_RUN:
        return [suffixed(path, f"{backend}_partial")]
    return ([path] if canonical else []) + [suffixed(path, backend)]


# formats


def esc(x) -> str:
    return html.escape("" if x is None else str(x), quote=True)


def pct(x) -> str:
    return format(100 * x, ".1f") + "%" if x is not None else "–"


def num(x) -> str:
    return format(x, ".3f") if x is not None else "–"


def hue(score) -> str:
    """Red to green."""
    return "#ccc" if score is None else f"hsl({120 * min(max(score, 0), 1):.0f} 60% 45%)"


# charts

_W, _H, _PAD = 520, 240, 36


def _svg(body: str, title: str, width: int = _W, height: int = _H) -> str:
    return f'<figure><figcaption>{esc(title)}</figcaption><svg role="img" aria-label="{esc(title)}" viewBox="0 0 {width} {height}">{body}</svg></figure>'


def _axes() -> str:
    return f'<path d="M{_PAD} {_PAD / 2}V{_H - _PAD}H{_W - _PAD / 2}" class="axis"/>'


def _x(v: float) -> float:
    return _PAD + v * (_W - 1.5 * _PAD)


def _y(v: float) -> float:
    return _H - _PAD - v * (_H - 1.5 * _PAD)


def _place(**at: float) -> str:
    return " ".join(f'{k}="{round(v, 1)}"' for k, v in at.items())


def _bar(x: float, top: float, width: float, look: str, hint) -> str:
    """A bar from the axis up to ``top``."""
    return f"<rect {look} {_place(height=_H - _PAD - top, width=width, x=x, y=top)}><title>{esc(hint)}</title></rect>"


def _text(x: float, y: float, text: str) -> str:
    return f"<text {_place(x=x, y=y)}>{esc(text)}</text>"


def bars(items: list[dict], title: str) -> str:
    """Accuracy by group."""
    if not items:
        return ""
    step, out = 1 / len(items), [_axes()]
    for n, i in enumerate(items):
        x, y = _x(n * step), _y(i["accuracy"])
        out.append(_bar(x + 3, y, max(_x(step) - _PAD - 6, 2), f'fill="{hue(i["accuracy"])}"', f"{i['key']}: {i['correct']}/{i['total']}"))
        out += [_text(x + 4, y - 4, pct(i["accuracy"])), _text(x + 4, _H - _PAD + 14, str(i["key"])[:12])]
    return _svg("".join(out), title)


def heatmap(cells: list[dict], title: str) -> str:
    """Accuracy by two keys; a cell without rows is drawn empty."""
    if not cells:
        return ""
    rows, cols = sorted({c["row"] for c in cells}), sorted({c["col"] for c in cells})
    at = {(c["row"], c["col"]): c for c in cells}
    body = "".join(f"<tr><th>{esc(r)}</th>" + "".join((f'<td style="background:{hue(c["accuracy"])}">{pct(c["accuracy"])}<small>{c["total"]}</small></td>' if (c := at.get((r, k))) else "<td></td>") for k in cols) + "</tr>" for r in rows)
    return f"<figure><figcaption>{esc(title)}</figcaption><table class=heat><tr><th></th>{''.join(f'<th>{esc(k)}</th>' for k in cols)}</tr>{body}</table></figure>"


def calibration_chart(bins: list[dict]) -> str:
    """Accuracy against mean score, points sized by count; nothing with under two filled bins."""
    full = list(filter(lambda b: b["count"], bins))
    if len(full) < 2:
        return ""
    most = max(b["count"] for b in full)
    dots = "".join(f'<circle cx="{_x(b["mean_score"]):.1f}" cy="{_y(b["accuracy"]):.1f}" r="{3 + 5 * b["count"] / most:.1f}"><title>{b["count"]} rows</title></circle>' for b in full)
    return _svg(f'{_axes()}<path class="ideal" d="M{_x(0)} {_y(0)}L{_x(1)} {_y(1)}"/>{dots}', "Calibration: accuracy by mean score")


def histogram(counts: list[dict], bins: int = 10) -> str:
    """How many right and wrong rows have which score."""
    if not counts:
        return ""
    most, out = max(c["count"] for c in counts), [_axes()]
    for c in counts:
        x, y = _x((c["bin"] + (0.0 if c["ok"] else 0.45)) / bins), _y(c["count"] / most)
        out.append(_bar(x, y, 0.42 * (_x(1 / bins) - _PAD), f'class="{"right" if c["ok"] else "wrong"}"', c["count"]))
    return _svg("".join(out), "Scores of right and wrong answers")


# sections


def _section(title: str, body: str) -> str:
    return f"<section><h2>{esc(title)}</h2>{body}</section>" if body else ""


def _rows(table) -> str:
    """Table rows, the first cell of each its head."""
    return "".join("<tr>" + "".join(f"<{t}>{esc(x)}</{t}>" for t, x in zip(("th", *["td"] * len(r)), r)) + "</tr>" for r in table)


def cards(s: dict) -> str:
    shown = [
        ("Accuracy", pct(s.get("accuracy"))), ("Correct", f"{s.get('correct', 0)} of {s.get('questions', 0)}"), ("Mean score", num(s.get("mean_score"))),
        ("Unread answers", f"{s.get('parse_failures', 0)} ({pct(s.get('parse_failure_rate'))})"), ("Empty responses", s.get("empty_responses", 0)), ("Tokens", f"{s.get('total_tokens') or 0:,}"),
    ]
    return '<div class="cards">' + "".join(f"<div><b>{esc(v)}</b>{esc(k)}</div>" for k, v in shown) + "</div>"


def scorer_words(kind: str | None) -> tuple[str, str]:
    """(the score's name, what it judges)."""
    return ("Outcome reward", "a response as a whole") if kind == "orm" else ("Process reward", "each step, averaged")


def verdict_words(c: dict) -> str:
    auc, low, high = c.get("auc"), c.get("ci_low"), c.get("ci_high")
    if auc is None:
        return "Whether the score tells right from wrong can't be said: one of the classes is missing."
    said = f"AUC {num(auc)} [{num(low)}, {num(high)}]"
    if c.get("beats_chance") is None:
        return f"{said}: too few answers of one class to call it validated."
    if c["beats_chance"] is False:
        return f"{said}: not distinguishable from chance."
    if auc >= 0.7:
        return f"{said}: the score separates right from wrong."
    return f"{said}: better than chance, but weakly." if auc > 0.5 else f"{said}: worse than chance."


def calibration_section(p: dict) -> str:
    c = p.get("calibration")
    if not c or not c.get("n"):
        return ""
    name, judged = scorer_words(p["summary"].get("scorer_kind"))
    facts = [("Correlation", num(c["r"])), ("Mean, right", num(c["mean_correct"])), ("Mean, wrong", num(c["mean_incorrect"])), ("Separation", num(c["separation"])), ("Calibration error", num(c["ece"]))]
    rows = _rows(facts)
    return _section(f"{name} (judges {judged})", f"<p>{esc(verdict_words(c))}</p><table>{rows}</table>{calibration_chart(p.get('bins', []))}{histogram(p.get('histogram', []))}")


def selection_section(p: dict) -> str:
    if (p["summary"].get("k") or 1) <= 1 or not p.get("selection"):
        return ""
    rows = _rows((s["strategy"], pct(s["accuracy"]), format(s["delta"], "+.1f")) for s in p["selection"])
    return _section("Choosing one of the samples", f"<table><tr><th></th><th>accuracy</th><th>points on first</th></tr>{rows}</table>")


def comparison_section(c: dict | None) -> str:
    if not c:
        return ""
    a = _rows((r["backend"], pct(r["accuracy"])) for r in c["accuracy"])
    g = _rows((f"{r['a']} / {r['b']}", pct(r["agreement"])) for r in c["agreement"])
    d = _rows((r["pos"], r["right"], r["wrong"]) for r in c["divergences"])
    return _section("Comparison", f"<table>{a}</table><h3>Agreement</h3><table>{g}</table><h3>Where they differ</h3><table><tr><th>position</th><th>right</th><th>wrong</th></tr>{d}</table>")


def shown_comparison(stored: dict, most: int = 40) -> dict:
    """A stored comparison as the section wants it: the first divergences, with who was right."""
    named = lambda d, want: ",".join(b for b, ok in d["outcomes"].items() if ok == want)
    first = stored.get("divergences", [])[:most]
    return stored | {"divergences": [{"pos": d["pos"], "right": named(d, True), "wrong": named(d, False)} for d in first]}


def questions_section(rows: list[dict], of: int | None = None) -> str:
    out = [f"<p>The first {len(rows)} of {of}.</p>"] if of is not None and of > len(rows) else []
    for r in rows:
        steps = "".join(f'<li style="border-color:{hue(s)}">{esc(t)}</li>' for t, s in zip(r.get("steps") or [], [*(r.get("step_scores") or []), *[None] * len(r.get("steps") or [])]))
        out.append(
            f'<details class="{"right" if r.get("ok") else "wrong"}"><summary>{esc(r.get("index"))}: {esc(str(r.get("predicted") or "")[:60])}</summary>'
            f'<p>{esc(r.get("problem"))}</p><p>Expected {esc(r.get("expected"))}, score {num(r.get("score"))}</p><ol>{steps}</ol></details>'
        )
    return _section("Questions", "".join(out))


STYLE = "body{font:15px/1.5 system-ui,sans-serif;max-width:60rem;margin:2rem auto;padding:0 1rem;color:#222}h2{border-bottom:1px solid #ddd}table{border-collapse:collapse}td,th{padding:.2rem .6rem;text-align:left}.heat td{color:#fff}.heat small{opacity:.7;margin-left:.4em}.cards{display:flex;flex-wrap:wrap;gap:1rem}.cards div{background:#f4f4f6;border-radius:.5rem;padding:.6rem 1rem}.cards b{display:block;font-size:1.3rem}svg{width:100%;max-width:34rem}svg text{font-size:10px}.axis,.ideal{fill:none;stroke:#999}.ideal{stroke-dasharray:4}rect.right,circle{fill:#287c3c}rect.wrong{fill:#b3372f}details.wrong summary{color:#b3372f}.synthetic{background:#fff3cd;padding:.6rem 1rem}li{border-left:4px solid;padding-left:.5rem;list-style-position:inside}"


def render(payload: dict) -> str:
    s = payload["summary"]
    banner = '<p class="synthetic">Synthetic responses: these figures measure no model.</p>' if s.get("synthetic") else ""
    body = "".join(
        [
            banner, cards(s), _section("By subject", bars(payload.get("by_subject", []), "Accuracy by subject")), _section("By difficulty", bars(payload.get("by_difficulty", []), "Accuracy by difficulty")),
            _section("Subject by difficulty", heatmap(payload.get("cross_tab", []), "Accuracy")), calibration_section(payload), selection_section(payload), comparison_section(payload.get("comparison")),
            questions_section(payload.get("questions", []), s.get("questions")),
        ]
    )
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Evaluation of {esc(s.get("model") or "a model")}</title><style>{STYLE}</style></head><body><h1>Evaluation of {esc(s.get("model") or "a model")}</h1>{body}</body></html>'


def write(payload: dict, path: str) -> str:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(render(payload))
    return path


# payload


def _dicts(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def collect_payload(rows: DataFrame, about: dict | None = None, samples: DataFrame | None = None, runs: DataFrame | None = None, questions: int | None = None) -> dict:
    """Aggregates of result rows: (index, problem, expected, subject, difficulty, predicted, matched, ok, milli, tokens).

    Whatever an older table lacks is null: the aggregates are always made anew from the rows.
    """
    wanted = {"subject": "string", "difficulty": "string", "predicted": "string", "matched": "boolean", "ok": "boolean", "milli": "bigint", "tokens": "bigint", "problem": "string", "expected": "string", "steps": "array<string>", "step_scores": "array<double>"}
    rows = rows.where("index is not null").withColumns({c: F.lit(None).cast(t) for c, t in wanted.items() if c not in rows.columns})
    out = {"summary": (about or {}) | _dicts(stats.summary(rows))[0]}
    for key in ("subject", "difficulty"):
        out[f"by_{key}"] = sorted(_dicts(stats.group_accuracy(rows, key)), key=lambda r: r["key"])
    out["cross_tab"] = _dicts(stats.cross_tab(rows, "subject", "difficulty"))
    out["calibration"] = _dicts(stats.calibration(rows))[0]
    out["bins"] = sorted(_dicts(stats.calibration_bins(rows)), key=lambda r: r["bin"])
    out["histogram"] = _dicts(stats.score_histogram(rows))
    out["selection"] = _dicts(selection.selection_accuracy(samples)) if samples is not None else []
    ordered = rows.orderBy("index") if questions is None else rows.orderBy("index").limit(questions)
    shown = ordered.select("index", "problem", "expected", "predicted", "ok", (F.col("milli") / 1000).alias("score"), "steps", "step_scores")
    out["questions"] = [r.asDict(recursive=True) for r in shown.toLocalIterator()]
    if runs is not None:
        out["comparison"] = {"accuracy": _dicts(compare.accuracy(runs)), "agreement": _dicts(compare.agreement(runs)), "divergences": _dicts(compare.top_divergences(runs))}
    return out
