"""Final answers and reasoning steps out of a response's text."""

from __future__ import annotations

import re

from .latex import boxed

_CUES = "|".join(("equals", "result", r"(?:final\s+)?answer"))
_PHRASE = re.compile(rf"(?:{_CUES})\s*(?:is|=|:)?\s*(.+?)$", re.I | re.M)
_DISPLAYS = [re.compile(f"{re.escape(a)}(.*?){re.escape(b)}", re.S) for a, b in (("\\[", "\\]"), ("$$", "$$"), ("\\(", "\\)"))]
_FENCES = {"\\[": "\\]", "$$": "$$"}
LEAST_STEP = 6


def final_answer(text: str | None) -> tuple[str, bool]:
    """The answer, and whether a structure gave it away (False: it is just the last line)."""
    text = text or ""
    if not text.strip():
        return "", False
    if boxes := boxed(text):
        return boxes[-1], True
    if said := _PHRASE.findall(text):
        answer = re.sub(r"\\[\[(]$", "", said[-1].strip().rstrip(".")).strip()
        answer = re.sub(r"^[:=]\s*", "", answer)
        if answer:
            return answer, True
    for display in _DISPLAYS:
        if found := display.findall(text):
            return found[-1].strip(), True
    return text.strip().rsplit("\n", 1)[-1].strip(), False


def _display(lines: list[str], at: int, fence: str) -> tuple[str, int]:
    """The text of the display that starts in line ``at``, and the line after it."""
    close, parts, rest = _FENCES[fence], [], lines[at][len(fence) :]
    while True:
        at += 1
        inside, closed, _ = rest.partition(close)
        parts.append(inside.strip())
        if closed or at >= len(lines):
            return " ".join(p for p in parts if p), at
        rest = lines[at]


def steps(text: str | None) -> list[str]:
    """Lines of reasoning; a display belongs to the step before it."""
    lines = [x for x in map(str.strip, (text or "").split("\n")) if x]
    found: list[str] = []
    at = 0
    while at < len(lines):
        line = lines[at]
        fence = next((f for f in _FENCES if line.startswith(f)), None)
        if fence and not line.startswith("\\boxed"):
            body, at = _display(lines, at, fence)
            if body and not body.startswith("\\boxed"):
                found[-1:] = [f"{found[-1]} {body}"] if found else [body]
            continue
        at += 1
        if len(line) >= LEAST_STEP and not line.startswith(("\\boxed", "\\]")):
            found.append(line)
    return found
