"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source x language x topic.  The token sums of the cells are
raked: scaled in turn to the target marginal of each dimension until every share of every
dimension is within ``TOLERANCE`` of its target.  Where empty cells keep that from happening (targets
that no weights can meet), raking ends when a round moves no marginal by more than a tenth of the
tolerance, or after ``rounds`` of them; a warning then names the greatest error, and the marginals of
the last dimension are met.  The weight of a cell is its raked share over its own share.  A document is drawn
with the probability ``min(1, scale * weight)``, where the scale is such that the tokens
expected are ``fraction`` of all; the draw compares the probability with a number
from the MD5 of doc_id and seed, so it is repeatable and SQL can restate it.

A document's topic is the value of a column, if ``topics`` names one (null is ``(none)``), else the
group of word endings that its text has most of (the tables at hand have no topics).

A target is a number, the power to which the shares found are raised (1 leaves the
marginal as it is, 0 levels it), or a mapping of values to shares; what a mapping doesn't
name keeps its own share of the rest, a named value that isn't there is left out,
and the shares are scaled to sum to 1.  A mapping whose shares leave no rest (they sum to 1)
says how the named values divide what they have together; all others keep the share found.

The documents are not shuffled: one pass sums the cells, a second draws.  The cells
number at most sources x languages x topics; up to ``driver_cells`` of them are raked on
the driver, more by the same steps as DataFrames.

Defined cases: a null source or language is a value of its own, ``(none)``; null and empty
texts have no tokens and weigh nothing, but are drawn with their cell's probability (that of
weight 1 where a cell has no tokens); rows of one doc_id are drawn or left together, a
null doc_id like the text ``null``; an empty table gives an empty one.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, require, sized

#: A topic is the group of endings that a text has most of; the first of equals, "other" without any.
TOPICS = {"process": ("tion", "ment", "ung", "ción"), "quality": ("ble", "ly", "heit", "eux"), "agent": ("er ", "or ", "eur ", "ador ")}
TARGETS = {"source": 0.5, "lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}, "topic": {"process": 0.4, "quality": 0.2, "agent": 0.3, "other": 0.1}}
FRACTION = 0.6
ROUNDS = 1000
TOLERANCE = 1e-9
DRIVER_CELLS = 200_000
DIMENSIONS = ("source", "lang", "topic")
#: A mapping leaves a rest for values that it doesn't name if its shares sum to less than 1 by more than this.
LEAST_REST = 1e-9
SEED = 2


def token_count(text: Column) -> Column:
    """Spaces and line ends plus one: a count of words that needs no splitting."""
    text = F.coalesce(text, F.lit(""))
    marks = sum((F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in (" ", "\n")), F.lit(0))
    return F.when(text == "", F.lit(0)).otherwise(marks + 1).cast("bigint")


def topic_of(text: Column, topics: dict = TOPICS) -> Column:
    """The name of the group with the most occurrences."""
    text = F.coalesce(text, F.lit(""))
    n = {}
    for name, endings in topics.items():
        n[name] = sum(((F.length(text) - F.length(F.replace(text, F.lit(e), F.lit("")))) / len(e) for e in endings), F.lit(0.0))
    most = F.greatest(*n.values(), F.lit(0.0))
    out = F.lit("other")
    for name in reversed(list(n)):
        out = F.when((n[name] == most) & (most > 0), F.lit(name)).otherwise(out)
    return out


def _needed(topics: dict | str) -> list[str]:
    return list(dict.fromkeys(["doc_id", "source", "lang", "text", *([topics] if isinstance(topics, str) else [])]))


def _features(docs: DataFrame, topics: dict | str) -> list[Column]:
    topic = F.coalesce(docs[topics].cast("string"), F.lit("(none)")) if isinstance(topics, str) else topic_of(docs["text"], topics)
    return [
        F.coalesce(docs["source"], F.lit("(none)")).alias("source"),
        F.coalesce(docs["lang"], F.lit("(none)")).alias("lang"),
        topic.alias("topic"),
        token_count(docs["text"]).alias("tokens"),
    ]


def _split(target: dict, named: float, rest: float) -> tuple[float, float]:
    """Factors for the shares named and for the shares found of all other values: named is the sum of those that occur, rest the others' share."""
    left = 1 - sum(target.values())
    if left > LEAST_REST:
        return 1.0, left / rest if rest else 0.0
    return (1 - rest) / named if rest and named else 1.0, 1.0


def target_shares(shares: dict, target) -> dict:
    """The shares that a marginal is raked to, by value, from those found."""
    if isinstance(target, dict):
        named = {v: target[v] for v in shares if v in target}
        rest = sum(s for v, s in shares.items() if v not in target)
        goal, other = _split(target, sum(named[v] for v in named if shares[v] > 0), rest)
        wanted = {v: named[v] * goal if v in named else s * other for v, s in shares.items()}
    else:
        wanted = {v: s ** float(target) if s > 0 else 0.0 for v, s in shares.items()}
    wanted = {v: w if shares[v] > 0 else 0.0 for v, w in wanted.items()}
    total = sum(wanted.values())
    return {v: w / total for v, w in wanted.items()} if total else dict(shares)


def _marginals(codes: np.ndarray, w: np.ndarray, wanted: list[np.ndarray]) -> list[np.ndarray]:
    return [np.bincount(codes[:, d], weights=w, minlength=len(shares)) for d, shares in enumerate(wanted)]


def marginal_error(codes: np.ndarray, w: np.ndarray, wanted: list[np.ndarray]) -> float:
    """The greatest distance of a share from its target."""
    return float(max(np.abs(h - s).max() for h, s in zip(_marginals(codes, w, wanted), wanted)))


def rake(codes: np.ndarray, tokens: np.ndarray, wanted: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Fits the cells' tokens (codes: cell x dimension) to the marginals; shares that sum to 1."""
    w = tokens / tokens.sum()
    have = _marginals(codes, w, wanted)
    for _ in range(rounds):
        for d, shares in enumerate(wanted):
            now = np.bincount(codes[:, d], weights=w, minlength=len(shares))
            w = w * np.divide(shares, now, out=np.zeros_like(now), where=now > 0)[codes[:, d]]
        before, have = have, _marginals(codes, w, wanted)
        if marginal_error(codes, w, wanted) <= tolerance or max(np.abs(a - b).max() for a, b in zip(before, have)) <= tolerance / 10:
            break
    return w / w.sum()


def _tell(error: float, tolerance: float) -> None:
    if error > tolerance:
        warnings.warn(f"the targets can't all be met: a marginal is {error:.3g} off", stacklevel=3)


def scale_for(weights: np.ndarray, tokens: np.ndarray, fraction: float) -> float:
    """The scale at which sum(min(1, scale * weight) * tokens) is the fraction of all tokens."""
    order = np.argsort(-weights, kind="stable")
    w, t = weights[order], tokens[order].astype(float)
    goal = fraction * t.sum()
    full = np.concatenate([[0.0], np.cumsum(t)])
    rest = np.concatenate([np.cumsum((w * t)[::-1])[::-1], [0.0]])
    for i in range(len(w)):
        if rest[i] <= 0:
            break
        scale = (goal - full[i]) / rest[i]
        if scale * w[i] <= 1:
            return float(max(scale, 0.0))
    return float("inf")


def _on_driver(cells: DataFrame, targets: dict, fraction: float, rounds: int) -> DataFrame:
    spark = cells.sparkSession
    pdf = cells.orderBy(*DIMENSIONS).toPandas()
    tokens = pdf["tokens"].to_numpy(np.float64)
    if tokens.sum() == 0:
        weights, scale = np.ones(len(pdf)), fraction
    else:
        codes, wanted = [], []
        for d in DIMENSIONS:
            values, code = np.unique(pdf[d].to_numpy(str), return_inverse=True)
            have = np.bincount(code, weights=tokens) / tokens.sum()
            shares = target_shares(dict(zip(values, have)), targets[d])
            codes.append(code)
            wanted.append(np.array([shares[v] for v in values]))
        codes = np.stack(codes, 1)
        raked = rake(codes, tokens, wanted, rounds)
        _tell(marginal_error(codes, raked, wanted), TOLERANCE)
        weights = np.divide(raked, tokens / tokens.sum(), out=np.ones(len(tokens)), where=tokens > 0)
        scale = scale_for(weights, tokens, fraction)
    pdf["weight"] = weights
    pdf["probability"] = np.where(weights > 0, np.minimum(1.0, weights * scale if np.isfinite(scale) else 1.0), 0.0)
    return spark.createDataFrame(pdf[[*DIMENSIONS, "weight", "probability"]], "source string, lang string, topic string, weight double, probability double")


def _error(cells: DataFrame, d: str) -> float:
    """The greatest distance of a share of a dimension from its target."""
    found = cells.groupBy(d).agg(F.sum("w").alias("w"), F.first(f"to_{d}").alias("to"))
    return found.agg(F.max(F.abs(F.col("w") - F.coalesce("to", "w")))).first()[0]


def _as_frames(cells: DataFrame, targets: dict, fraction: float, rounds: int, scratch: Scratch) -> DataFrame:
    """The same by DataFrames, for cells too many for the driver.  A mapping's values are few, those of a power any number."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    if not total:
        return cells.select(*DIMENSIONS, F.lit(1.0).alias("weight"), F.lit(float(fraction)).alias("probability"))
    now = cells.select(*DIMENSIONS, "tokens", (F.col("tokens") / total).alias("w"))
    for d in DIMENSIONS:
        have = now.groupBy(d).agg(F.sum("w").alias("s"))
        target = targets[d]
        if isinstance(target, dict):
            named = F.create_map(*[F.lit(x) for pair in target.items() for x in pair])[F.col(d)].cast("double")
            there, rest = have.where("s > 0").agg(F.sum(named), F.sum(F.when(named.isNull(), F.col("s")))).first()
            goal, other = _split(target, there or 0.0, rest or 0.0)
            goal = F.coalesce(named * goal, F.col("s") * other)
        else:
            goal = F.pow("s", F.lit(float(target)))
        have = have.select(d, F.when(F.col("s") > 0, goal).otherwise(0.0).alias("g"))
        sum_g = have.agg(F.sum("g")).first()[0]
        now = now.join(have.select(d, (F.col("g") / sum_g if sum_g else F.lit(None)).alias(f"to_{d}")), d)
    now = scratch.table(now, "cells-0")
    error = float("inf")
    for i in range(rounds):
        for d in DIMENSIONS:
            sums = now.groupBy(d).agg(F.sum("w").alias("_have"))
            now = now.join(sums, d).withColumn("w", F.when(F.col("_have") > 0, F.col("w") * F.coalesce(f"to_{d}", "_have") / F.col("_have")).otherwise(0.0)).drop("_have")
        now = scratch.table(now, f"cells-{i + 1}")
        scratch.drop(f"cells-{i}")
        before, error = error, max(_error(now, d) for d in DIMENSIONS)
        if error <= TOLERANCE or abs(before - error) <= TOLERANCE / 10:
            break
    _tell(error, TOLERANCE)
    whole = now.agg(F.sum("w")).first()[0]
    now = scratch.table(now.select(*DIMENSIONS, "tokens", F.when(F.col("tokens") > 0, F.col("w") / whole / (F.col("tokens") / total)).otherwise(1.0).alias("weight")), "weights")

    def at(scale: float) -> float:
        """The exact scale if the cells that this one fills are those that are full."""
        full = F.col("weight") * F.lit(scale) >= 1
        whole, part = now.agg(F.sum(F.when(full, F.col("tokens"))), F.sum(F.when(~full, F.col("weight") * F.col("tokens")))).first()
        return max(0.0, (fraction * total - (whole or 0)) / part) if part else float("inf")

    # cells only fill as the scale grows, and it never passes the exact one
    scale, high = 0.0, at(0.0)
    while high > scale * (1 + 1e-12) and high != float("inf"):
        scale, high = high, at(high)
    return now.select(*DIMENSIONS, "weight", F.when(F.col("weight") > 0, F.least(F.lit(1.0), F.col("weight") * high if high != float("inf") else F.lit(1.0))).otherwise(0.0).alias("probability"))


def cell_weights(docs: DataFrame, targets: dict = TARGETS, fraction: float = FRACTION, rounds: int = ROUNDS, topics: dict | str = TOPICS, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """(source, lang, topic, weight, probability) for every cell."""
    base = require(docs, *_needed(topics))
    return _weights(base.select(*_features(base, topics)), targets, fraction, rounds, driver_cells)


def _weights(features: DataFrame, targets: dict = TARGETS, fraction: float = FRACTION, rounds: int = ROUNDS, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    scratch = Scratch(features.sparkSession, "raking")
    cells = scratch.table(features.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    if cells.count() <= driver_cells:
        return _on_driver(cells, targets, fraction, rounds)
    return _as_frames(cells, targets, fraction, rounds, scratch)


def uniform(doc_id: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5."""
    text = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def sample(docs: DataFrame, topics: dict | str = TOPICS, seed: int = SEED, **options) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, weight, probability) of the documents drawn; the texts are read once."""
    base = require(docs, *_needed(topics))
    features = Scratch(docs.sparkSession, "raking").table(base.select("doc_id", *_features(base, topics)), "features")
    cells = sized(_weights(features, **options).select(*DIMENSIONS, "weight", "probability"))
    drawn = features.join(cells, list(DIMENSIONS)).where(uniform(F.col("doc_id"), seed) < F.col("probability"))
    return drawn.select("doc_id", *DIMENSIONS, "tokens", "weight", "probability")


def mix(docs: DataFrame, topics: dict | str = TOPICS, seed: int = SEED, **options) -> DataFrame:
    """The documents drawn, with the columns of ``docs``; texts are read twice and not shuffled."""
    cells = sized(cell_weights(docs, topics=topics, **options).select(*DIMENSIONS, "probability"))
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    drawn = docs.select(row, *_features(docs, topics)).join(cells, list(DIMENSIONS)).where(uniform(F.col("_row.doc_id"), seed) < F.col("probability"))
    return drawn.select("_row.*")


def oracle() -> str:
    """The sample as DuckDB SQL: raking by a recursive query, the scale by sorting cells."""

    def quoted(e: str) -> str:
        return "'" + e.replace("'", "''") + "'"

    counts = {name: " + ".join(f"(length(x) - length(replace(x, {quoted(e)}, ''))) / {len(e)}.0" for e in endings) for name, endings in TOPICS.items()}
    case = " ".join(f"when n_{name} = greatest({', '.join('n_' + k for k in counts)}) and n_{name} > 0 then '{name}'" for name in counts)
    goal_parts = []
    for d in DIMENSIONS:
        t = TARGETS[d]
        if isinstance(t, dict):
            named = "case v " + " ".join(f"when {quoted(k)} then {float(x)!r}::double" for k, x in t.items()) + " end"
            listed = ", ".join(quoted(k) for k in t)
            left = 1 - sum(t.values())
            rest, there = f"sum(case when v not in ({listed}) then s else 0 end) over ()", f"sum(case when s > 0 then coalesce({named}, 0) else 0 end) over ()"
            if left > LEAST_REST:
                g = f"coalesce({named}, s * {left!r} / nullif({rest}, 0), 0)"
            else:
                g = f"coalesce({named} * case when {rest} > 0 and {there} > 0 then (1 - {rest}) / {there} else 1 end, s)"
        else:
            g = f"pow(s, {float(t)!r})"
        goal_parts.append(
            f"goal_{d} as (select v, g / sum(g) over () as g from (select v, case when s > 0 then {g} else 0 end as g from "
            f"(select {d} as v, sum(w) as s from cells group by 1)))"
        )
    # the three scalings of a round, then the marginals after it (ms, ml, mt) beside those before (ps, pl, pt)
    scaled = "from raked where not done"
    for n, (d, g) in enumerate((("source", "gs"), ("lang", "gl"), ("topic", "gt"))):
        own, total = ("w" if not n else f"w{n}"), f"sum({'w' if not n else f'w{n}'}) over (partition by {d})"
        scaled = f"from (select *, case when {total} > 0 then {own} * {g} / {total} else 0 end as w{n + 1} {scaled})"
    sums = "sum(w) over (partition by source) as ms, sum(w) over (partition by lang) as ml, sum(w) over (partition by topic) as mt"
    far = lambda x: f"max(greatest({', '.join(f'abs(m{k} - {x}{k})' for k in 'slt')})) over ()"
    step = (
        f"select *, {far('g')} <= {TOLERANCE!r} or {far('p')} <= {TOLERANCE / 10!r} or it = {ROUNDS} as done from ("
        f"select *, {sums} from (select it + 1 as it, source, lang, topic, tokens, own, gs, gl, gt, w3 as w, ms as ps, ml as pl, mt as pt {scaled}))"
    )
    return f"""
with recursive docs as (
  select doc_id, coalesce(source, '(none)') as source, coalesce(lang, '(none)') as lang, coalesce(text, '') as x from documents),
counted as (select *, {', '.join(f'{e} as n_{k}' for k, e in counts.items())} from docs),
feats as (
  select doc_id, source, lang, case {case} else 'other' end as topic,
    case when x = '' then 0 else 2 * length(x) - length(replace(x, ' ', '')) - length(replace(x, chr(10), '')) + 1 end::bigint as tokens
  from counted),
cells as (
  select source, lang, topic, sum(tokens)::bigint as tokens, sum(tokens)::double / sum(sum(tokens)) over () as w from feats group by 1, 2, 3),
{', '.join(goal_parts)},
raked as (
  select 0 as it, source, lang, topic, tokens, w as own, s.g as gs, l.g as gl, t.g as gt, w,
    0::double as ps, 0::double as pl, 0::double as pt, sum(w) over (partition by source) as ms, sum(w) over (partition by lang) as ml, sum(w) over (partition by topic) as mt, false as done
  from cells join goal_source s on s.v = source join goal_lang l on l.v = lang join goal_topic t on t.v = topic
  union all {step}),
weighed as (
  select source, lang, topic, tokens, case when tokens > 0 then w / sum(w) over () / own else 1 end as weight from raked where it = (select max(it) from raked)),
ranked as (
  select *, coalesce(sum(tokens) over (order by weight desc, source, lang, topic rows between unbounded preceding and 1 preceding), 0) as above,
    sum(weight * tokens) over (order by weight desc, source, lang, topic rows between current row and unbounded following) as below,
    sum(tokens) over () as total from weighed),
scales as (
  select ({FRACTION!r} * total - above) / below as scale from ranked
  where below > 0 and ({FRACTION!r} * total - above) / below * weight <= 1 order by above, weight desc limit 1),
drawn as (
  select source, lang, topic, weight, case when weight > 0 then least(1.0, weight * coalesce((select scale from scales), 1e300)) else 0 end as probability from weighed)
select doc_id, source, lang, topic, tokens, round(weight, 6) as weight, round(probability, 6) as probability
from feats join drawn using (source, lang, topic)
where ('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || ':{SEED}'), 1, 8))::bigint::double / 4294967296.0 < probability
"""
