"""Functions as Column expressions where built-ins can say it, as Arrow UDFs where they can't.

The UDFs wrap the scanners of ``latex`` and ``extract``; nulls are handled as there.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import extract, latex

WHITE = r"(?U)\s"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end (trim takes only spaces)."""
    return F.regexp_replace(c, rf"^{WHITE}+|{WHITE}+$", "")


def is_blank(c: Column) -> Column:
    return F.regexp_like(F.coalesce(c, F.lit("")), F.lit(rf"^{WHITE}*$"))


# plain-form steps that need no scanner


def unify_dashes(c: Column) -> Column:
    return F.translate(c, "−–—", "---")


def drop_degrees(c: Column) -> Column:
    return F.regexp_replace(c, r"\^?(?U)\s*(?:°|\\degree|\\circ)", "")


def flatten_subscripts(c: Column) -> Column:
    return F.regexp_replace(c, r"_\s*\{([^{}]*)\}", "_$1")


def drop_ordinals(c: Column) -> Column:
    return F.regexp_replace(c, r"\^\s*+\{?\s*+(?:[rn]d|th|st)\s*\}?", "")


def explicit_products(c: Column) -> Column:
    c = F.regexp_replace(c, r"(\d)(?=[A-Za-z(])(?![eE][-+]?\d)", "$1*")
    return F.regexp_replace(c, r"\)(?=[A-Za-z0-9(])", ")*")


def drop_final_dots(c: Column) -> Column:
    return F.regexp_replace(c, r"\.+$", "")


def old_normal(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?s)\\boxed\{(.*?)\}", "$1")
    c = F.regexp_replace(c, r"°|\^?\\degree|\^?\\circ", "")
    for name, text in latex._OLD.items():
        c = F.replace(c, F.lit("\\" + name), F.lit(text))
    return F.lower(F.regexp_replace(c, r"\\[a-zA-Z]+|[{}]|(?U)\s|/", ""))


def lone_grouping(c: Column) -> Column:
    """A lone number without the commas between its groups."""
    whole = F.regexp_like(strip(c), F.lit(r"^\$*-?\d{1,3}(,\s*\d{3})+(\.\d+)?$"))
    return F.when(whole, F.regexp_replace(F.regexp_replace(strip(c), r"^\$+", ""), r",\s*(?=\d)", "")).otherwise(c)


def base_of(c: Column) -> Column:
    """The subscript of a numeral, null without one."""
    return F.nullif(F.regexp_extract(c, r"^.+?_(\d+)$", 1), F.lit(""))


def strip_base(c: Column) -> Column:
    return F.regexp_replace(c, r"^(.+?)_(\d+)$", "$1")


def strip_prefix(c: Column) -> Column:
    return F.regexp_replace(c, f"^{latex.PREFIX}", "")


_COMPARE, _VARIABLE = "(<=|>=|<|>)", "([a-z][a-z0-9_]*)"
_BETWEEN, _BEYOND = f"^(.+?){_COMPARE}{_VARIABLE}{_COMPARE}(.+)$", f"^{_VARIABLE}{_COMPARE}(.+)$"


def interval(c: Column) -> Column:
    """The interval that an inequality denotes, null for any other text."""
    part = lambda p, i: F.regexp_extract(c, p, i)
    lo, first, second, hi = (part(_BETWEEN, i) for i in (1, 2, 4, 5))
    sign, bound = part(_BEYOND, 2), part(_BEYOND, 3)
    opening = lambda s: F.when(F.contains(s, F.lit("=")), "[").otherwise("(")
    closing = lambda s: F.when(F.contains(s, F.lit("=")), "]").otherwise(")")
    up, down = F.startswith(first, F.lit("<")) & F.startswith(second, F.lit("<")), F.startswith(first, F.lit(">")) & F.startswith(second, F.lit(">"))
    comma = F.lit(",")
    return (
        F.when(F.regexp_like(c, F.lit(_BETWEEN)), F.when(up, F.concat(opening(first), lo, comma, hi, closing(second))).when(down, F.concat(opening(second), hi, comma, lo, closing(first))))
        .when(F.regexp_like(c, F.lit(_BEYOND)), F.when(F.startswith(sign, F.lit("<")), F.concat(F.lit("(-oo,"), bound, closing(sign))).otherwise(F.concat(opening(sign), bound, F.lit(",oo)"))))
    )


def both_signs(c: Column) -> Column:
    """The two readings of a plus-minus as an array, or the text alone."""
    mark = F.lit("\x03")
    plus = F.replace(F.replace(F.replace(c, F.lit("+-"), mark), F.lit("-+"), F.lit("-")), mark, F.lit("+"))
    minus = F.replace(F.replace(F.replace(c, F.lit("+-"), mark), F.lit("-+"), F.lit("+")), mark, F.lit("-"))
    return F.when(F.contains(c, F.lit("+-")) | F.contains(c, F.lit("-+")), F.array(plus, minus)).otherwise(F.array(c))


def last_flat_box(c: Column) -> Column:
    """The last boxed argument with at most one level of braces inside, null without one."""
    found = F.regexp_extract_all(c, F.lit(r"\\(?:boxed|fbox)\s*\{((?:[^{}]|\{[^{}]*\})*)\}"), 1)
    return strip(F.try_element_at(found, F.lit(-1)))


# mathematics


def positive_share(plus: Column, minus: Column) -> Column:
    """The softmax of two logits, without overflow."""
    d = plus - minus
    return F.when(d >= 0, 1 / (1 + F.exp(-d))).otherwise(F.exp(d) / (1 + F.exp(d)))


def label_probability(label: Column, score: Column) -> Column:
    return F.when(label == "LABEL_1", score).otherwise(1 - score)


def close(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(tolerance) * F.greatest(F.abs(a), F.abs(b)), F.lit(tolerance))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, rf"{WHITE}+"), lambda w: w != ""))


# scanners


def _texts(function, to):
    def run(c: pa.Array) -> pa.Array:
        known: dict = {}
        return pa.array([known[x] if x in known else known.setdefault(x, function(x)) for x in c.to_pylist()], to)

    return run


def _pairs(function):
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        known: dict = {}
        out = []
        for p in zip(a.to_pylist(), b.to_pylist()):
            if p not in known:
                known[p] = function(*p)
            out.append(known[p])
        return pa.array(out, pa.bool_())

    return run


_ANSWER = pa.struct([("answer", pa.string()), ("matched", pa.bool_())])
_null = lambda f: lambda x: None if x is None else f(x)


def _answer(x):
    answer, matched = extract.final_answer(x)
    return {"answer": answer, "matched": matched}


class _Udf:
    """An Arrow UDF that is made when it is first applied, so that importing needs no session."""

    def __init__(self, function, kind: str):
        self.function, self.kind = function, kind

    def __call__(self, *columns) -> Column:
        return F.arrow_udf(self.function, self.kind)(*columns)


plain = _Udf(_texts(_null(latex.plain), pa.string()), "string")
normal = _Udf(_texts(_null(latex.normal), pa.string()), "string")
core = _Udf(_texts(_null(lambda x: latex.core(latex.normal(x))), pa.string()), "string")
boxes = _Udf(_texts(_null(latex.boxed), pa.list_(pa.string())), "array<string>")
final_answer = _Udf(_texts(_answer, _ANSWER), "answer string, matched boolean")
steps = _Udf(_texts(extract.steps, pa.list_(pa.string())), "array<string>")
number = _Udf(_texts(_null(latex.number), pa.float64()), "double")
correct = _Udf(_pairs(latex.correct), "boolean")
equivalent = _Udf(_pairs(lambda a, b: None if a is None or b is None else latex.equivalent(a, b)), "boolean")


def _classes(answers: list | None) -> list[int] | None:
    """The class of each answer, in the order given: that of the first representative it equals."""
    if answers is None:
        return None
    heads: list[str] = []
    out = []
    for a in answers:
        a = a or ""
        hit = next((i for i, h in enumerate(heads) if latex.equivalent(a, h)), None)
        if hit is None:
            hit = len(heads)
            heads.append(a)
        out.append(hit)
    return out


def _class_lists(c: pa.Array) -> pa.Array:
    return pa.array([_classes(x) for x in c.to_pylist()], pa.list_(pa.int32()))


equivalence_classes = _Udf(_class_lists, "array<int>")
