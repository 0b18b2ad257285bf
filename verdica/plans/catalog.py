"""All queries of the library: name, Spark function, and DuckDB SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import audit, compare, grading, runs, selection, stats
from ..sources import generators, results, scorers
from . import tables as T

_QUERIES: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}


def _add(name: str, f: Callable, sql: str | None) -> None:
    _QUERIES[name] = (f, sql)


# grouped accuracy

_TALLY = "count(*) filter (where ok)::double / count(*) as accuracy, count(*) filter (where ok) as correct, count(*) as total"


def _group(name: str, view: str, key: str) -> None:
    _add(
        name,
        lambda spark, d: stats.group_accuracy(T.view(spark, d, view), key),
        T.with_view(view, f"select {key}::varchar as key, {_TALLY} from {view} where {key} is not null group by 1"),
    )


_group("group_accuracy_subject", "eval_rows", "subject")
_group("group_accuracy_difficulty", "eval_rows", "difficulty")
_group("group_accuracy_large", "big_rows", "difficulty")


@query(T.with_view("big_rows", f"select subject as row, difficulty::varchar as col, {_TALLY} from big_rows group by 1, 2"))
def cross_tab(spark, d):
    return stats.cross_tab(T.view(spark, d, "big_rows"), "subject", "difficulty")


@query(
    T.with_view(
        "eval_rows",
        f""", cells as (select subject as row, (index % 40)::varchar as col, {_TALLY} from eval_rows group by 1, 2)
        select row, col, accuracy, coalesce(correct, 0) as correct, coalesce(total, 0) as total
        from (select distinct row from cells) a cross join (select distinct col from cells) b left join cells using (row, col)""",
    )
)
def cross_tab_dense(spark, d):
    rows = T.view(spark, d, "eval_rows").withColumn("part", F.col("index") % 40)
    return stats.dense_cross_tab(rows, "subject", "part")


@query(
    T.with_view(
        "big_rows",
        f"""select subject as a, difficulty::varchar as b, grouping(subject, difficulty)::int as level, {_TALLY}
        from big_rows group by grouping sets ((subject, difficulty), (subject), (difficulty), ())""",
    )
)
def accuracy_grouping_sets(spark, d):
    return stats.grouping_sets(T.view(spark, d, "big_rows"), "subject", "difficulty")


@query(
    T.with_view(
        "samples",
        """select count(*) as questions, count(*) filter (where ok) as correct, count(*) filter (where ok)::double / count(*) as accuracy,
        sum(milli)::double / count(milli) / 1000 as mean_score,
        count(*) filter (where not coalesce(matched, false) or coalesce(predicted, '') = '') as parse_failures,
        count(*) filter (where not coalesce(matched, false) or coalesce(predicted, '') = '')::double / count(*) as parse_failure_rate,
        count(*) filter (where trim(coalesce(predicted, '')) = '') as empty_responses, sum(coalesce(tokens, 0))::bigint as total_tokens
        from samples where sample_index = 0""",
    )
)
def run_summary(spark, d):
    return stats.summary(T.view(spark, d, "samples").where("sample_index = 0"))


# ranks and calibration

_DIST = "dist as (select milli::bigint as milli, count(*) filter (where ok) as p, count(*) filter (where not ok) as n from {v} where milli is not null group by 1)"
_AUC = (
    "auc as (select sum(p::hugeint * (2 * nb + n))::double / nullif(2.0 * sum(p) * sum(n), 0) as auc, sum(p)::bigint as n_right, sum(n)::bigint as n_wrong from "
    "(select p, n, coalesce(sum(n) over (order by milli rows between unbounded preceding and 1 preceding), 0) as nb from dist))"
)
_CI = (
    "ci as (select auc, n_right, n_wrong, case when auc is not null then greatest(0.0, auc - 1.96 * sqrt(greatest(v, 0.0))) end as ci_low, "
    "case when auc is not null then least(1.0, auc + 1.96 * sqrt(greatest(v, 0.0))) end as ci_high from (select *, (a * (1 - a) + (n_right - 1) * (a / (2 - a) - a * a) + "
    "(n_wrong - 1) * (2 * a * a / (1 + a) - a * a)) / (n_right::double * n_wrong) as v from (select *, least(greatest(auc, 0.5 / (n_right::double * n_wrong)), 1 - 0.5 / (n_right::double * n_wrong)) as a from auc)))"
)
_PEARSON = (
    "pear as (select case when c >= 2 then (c * sxy - sx * sy) / nullif(sqrt(c * sxx - sx * sx) * sqrt(c * syy - sy * sy), 0) end as r from (select sum(p + n)::double as c, sum(milli * (p + n))::double as sx, "
    "sum(p)::double as sy, sum(milli * milli * (p + n))::double as sxx, sum(p)::double as syy, sum(milli * p)::double as sxy from dist))"
)
_MEANS = (
    "means as (select *, mean_correct - mean_incorrect as separation from (select sum(milli * p)::double / nullif(sum(p), 0) / 1000 as mean_correct, "
    "sum(milli * n)::double / nullif(sum(n), 0) / 1000 as mean_incorrect from dist))"
)
_BINS = (
    "bins as (select b::int as bin, b / 10.0::double as lo, (b + 1) / 10.0::double as hi, coalesce(count, 0) as count, coalesce(correct, 0) as correct, correct::double / count as accuracy, total::double / count / 1000 as mean_score "
    "from range(10) t(b) left join (select least(floor(least(greatest(milli, 0), 1000) * 10 / 1000), 9)::bigint as b, sum(p + n)::bigint as count, sum(p)::bigint as correct, "
    "sum(least(greatest(milli, 0), 1000) * (p + n))::bigint as total from dist group by 1) using (b))"
)
_ECE = "e as (select sum(count * abs(accuracy - mean_score)) / sum(count) as ece from bins where count > 0)"


def _from(view: str, parts: tuple[str, ...], select: str) -> str:
    return T.with_view(view, ", " + ", ".join((_DIST.format(v=view), *parts)) + " " + select)


for _view, _suffix in (("eval_rows", ""), ("big_rows", "_large")):
    _rounded = lambda df, *cs: df.withColumns({c: F.round(c, 12) for c in cs})
    _add(f"roc_auc{_suffix}", lambda s, d, v=_view: stats.roc_auc(T.view(s, d, v)), _from(_view, (_AUC,), "select * from auc"))
    _add(
        f"auc_ci{_suffix}", lambda s, d, v=_view: _rounded(stats.auc_with_interval(T.view(s, d, v)), "ci_low", "ci_high"),
        _from(_view, (_AUC, _CI), "select auc, round(ci_low, 12) as ci_low, round(ci_high, 12) as ci_high, n_right, n_wrong from ci"),
    )
    _add(
        f"avg_rank{_suffix}", lambda s, d, v=_view: stats.average_ranks(T.view(s, d, v)),
        _from(_view, (), "select milli, p as right, n as wrong, coalesce(sum(p + n) over (order by milli rows between unbounded preceding and 1 preceding), 0)::bigint + (p + n + 1) / 2.0::double as average_rank from dist"),
    )
    _add(f"pearson_r{_suffix}", lambda s, d, v=_view: _rounded(stats.pearson(T.view(s, d, v)), "r"), _from(_view, (_PEARSON,), "select round(r, 12) as r from pear"))
    _add(f"calibration_bins{_suffix}", lambda s, d, v=_view: stats.calibration_bins(T.view(s, d, v)), _from(_view, (_BINS,), "select * from bins"))
    _add(f"populated_bins{_suffix}", lambda s, d, v=_view: stats.populated(stats.calibration_bins(T.view(s, d, v))), _from(_view, (_BINS,), "select * from bins where count > 0"))
    _add(f"class_means{_suffix}", lambda s, d, v=_view: stats.class_means(T.view(s, d, v)), _from(_view, (_MEANS,), "select * from means"))
    _add(f"ece{_suffix}", lambda s, d, v=_view: _rounded(stats.expected_calibration_error(T.view(s, d, v)), "ece"), _from(_view, (_BINS, _ECE), "select round(ece, 12) as ece from e"))
    _add(
        f"calibration_block{_suffix}",
        lambda s, d, v=_view: _rounded(stats.calibration(T.view(s, d, v)), "ci_low", "ci_high", "r", "ece"),
        _from(
            _view, (_AUC, _CI, _PEARSON, _MEANS, _BINS, _ECE),
            "select n_right + n_wrong as n, n_right, n_wrong, auc, round(ci_low, 12) as ci_low, round(ci_high, 12) as ci_high, "
            "case when ci_low is null then null when ci_low <= 0.5 and ci_high >= 0.5 then false when least(n_right, n_wrong) < 10 then null else true end as beats_chance, "
            "case when ci_low > 0.5 then 'above' when ci_high < 0.5 then 'below' when ci_low is not null then 'unclear' end as direction, "
            "round(r, 12) as r, mean_correct, mean_incorrect, separation, round(ece, 12) as ece from ci, pear, means, e",
        ),
    )
    _add(
        f"score_histogram{_suffix}", lambda s, d, v=_view: stats.score_histogram(T.view(s, d, v)),
        T.with_view(_view, f"select coalesce(ok, false) as ok, least(floor(least(greatest(milli, 0), 1000) * 10 / 1000), 9)::int as bin, count(*) as count from {_view} where milli is not null group by 1, 2"),
    )


# selection of one of k samples

_ROW = "index, sample_index, predicted, milli, ok"
_PICK = {
    "first": "row_number() over (partition by index order by sample_index)",
    "best": "row_number() over (partition by index order by coalesce(milli, 0) desc, sample_index)",
    "majority": "row_number() over (partition by index order by votes desc, head, coalesce(milli, 0) desc, sample_index)",
    "weighted": "row_number() over (partition by index order by weight desc, head, coalesce(milli, 0) desc, sample_index)",
}
_VOTED = (
    ", voted as (select *, count(*) over c as votes, sum(coalesce(milli, 0)) over c as weight, min(sample_index) over c as head "
    "from samples window c as (partition by index, coalesce(predicted, '')))"
)
for _s in selection.STRATEGIES:
    _add(
        f"select_{_s}", lambda spark, d, s=_s: selection.select(T.view(spark, d, "samples").select(*_ROW.split(", ")), s),
        T.with_view("samples", f"{_VOTED} select {_ROW} from (select *, {_PICK[_s]} as r from voted) where r = 1"),
    )
_ALL = " union all ".join(f"select '{s}' as strategy, ok from (select *, {r} as r from voted) where r = 1" for s, r in _PICK.items())


@query(
    T.with_view(
        "samples",
        f"""{_VOTED}, chosen as ({_ALL}), rated as (select strategy, count(*) filter (where ok) as correct, count(*) as total from chosen group by 1)
        select strategy, correct::double / total as accuracy, correct, total,
          (correct * (select total from rated where strategy = 'first') - total * (select correct from rated where strategy = 'first')) * 100::double
            / (total * (select total from rated where strategy = 'first')) as delta from rated""",
    )
)
def selection_accuracy(spark, d):
    return selection.selection_accuracy(T.view(spark, d, "samples"))


# runs against each other

_SHORTEST = ", al as (select * from runs where pos < (select min(n) from (select count(*) as n from runs group by backend)))"


@query(T.with_view("runs", f"{_SHORTEST} select backend, count(*) filter (where ok) as correct, count(*) as total, count(*) filter (where ok)::double / count(*) as accuracy from al group by 1"))
def compare_accuracy(spark, d):
    return compare.accuracy(T.view(spark, d, "runs"))


@query(
    T.with_view(
        "runs",
        f"""{_SHORTEST} select x.backend as a, y.backend as b, count(*) filter (where x.ok = y.ok) as agree, count(*) as total, count(*) filter (where x.ok = y.ok)::double / count(*) as agreement
        from al x join al y on x.pos = y.pos and x.ord < y.ord group by 1, 2""",
    )
)
def compare_agreement(spark, d):
    return compare.agreement(T.view(spark, d, "runs"))


_DIVERGE = (
    f"{_SHORTEST} select pos, min_by(index, ord) as index, coalesce(string_agg(case when ok then backend end, ',' order by ord), '') as right, "
    "coalesce(string_agg(case when not ok then backend end, ',' order by ord), '') as wrong from al group by pos having min(ok::int) <> max(ok::int)"
)


@query(T.with_view("runs", _DIVERGE))
def compare_divergences(spark, d):
    return compare.divergences(T.view(spark, d, "runs"))


@query(T.with_view("runs", _DIVERGE + " order by pos limit 40"))
def compare_divergences_top40(spark, d):
    return compare.top_divergences(T.view(spark, d, "runs"))


# resuming, splicing, regrading


@query("select o_orderkey as index, o_totalprice as price from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 45)")
def resume_pending(spark, d):
    problems = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("index"), F.col("o_totalprice").alias("price"))
    return runs.pending(problems, T.read(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("index")))


@query("select l_orderkey as index, count(*) as rows from lineitem where l_orderkey in (select o_orderkey from orders where o_orderkey % 3 = 0) group by 1")
def resume_cached(spark, d):
    done = T.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("index")).agg(F.count("*").alias("rows"))
    return runs.cached(T.read(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("index")), done)


@query("select user_id as index, event_id, event_type from events qualify row_number() over (partition by user_id order by event_id desc) = 1")
def checkpoint_latest(spark, d):
    return runs.latest(T.read(spark, d, "events").select(F.col("user_id").alias("index"), "event_id", "event_type"), "index", "event_id")


@query("select user_id::int as index, 'e' || max(event_id) as problem from events where event_id < (select max(event_id) from events) * 3 // 4 and event_id > 0 group by 1")
def checkpoint_log(spark, d):
    """A log with a header, a cut line three quarters down and more behind it."""
    e = T.read(spark, d, "events")
    last = e.agg((F.max("event_id") * 3).alias("m")).select(F.floor(F.col("m") / 4).alias("cut"))
    good = F.to_json(F.struct(F.col("user_id").cast("int").alias("index"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("problem")))
    line = F.when(F.col("event_id") == 0, F.lit('{"fingerprint": "f1"}')).when(F.col("event_id") == F.col("cut"), F.substring(good, 1, 9)).otherwise(good)
    lines = e.crossJoin(F.broadcast(last)).select(F.col("event_id").alias("pos"), line.alias("line"))
    return results.checkpoint_rows(lines, "f1", "index int, problem string")


@query("select o_orderkey - 1 as pos, case when o_orderkey = 100 then 'spliced' else o_orderstatus end as status from orders union all select 10000000, 'spliced'")
def splice_row(spark, d):
    rows = T.read(spark, d, "orders").select((F.col("o_orderkey") - 1).alias("pos"), F.col("o_orderstatus").alias("status"))
    new = spark.createDataFrame([(99, "spliced"), (10_000_000, "spliced")], "pos long, status string")
    return runs.splice(rows, new)


_SAME = "a * d = b * c"
_PAIRS = "with pairs as (select p_partkey, p_size::bigint as a, p_partkey % 12 + 1 as b, case when p_partkey % 2 = 0 then 2 * p_size::bigint else p_size::bigint + 1 end as c, case when p_partkey % 2 = 0 then 2 else 1 end * (p_partkey % 12 + 1) as d from part)"


@query(
    f"""{_PAIRS}, g as (select *, p_partkey % 3 = 0 as was, p_partkey % 10 <> 0 and {_SAME} as ok, p_partkey % 10 = 0 as empty from pairs)
    select count(*) as questions, count(*) filter (where was) as correct_before, count(*) filter (where ok) as correct_after, count(*) filter (where ok and not was) as now_right,
      count(*) filter (where was and not ok) as now_wrong, count(*) filter (where not ok) as still_wrong, count(*) filter (where not ok and empty) as empty_failures from g"""
)
def regrade_diff(spark, d):
    rows = T.answer_pairs(spark, d).withColumn("ok", F.col("p_partkey") % 3 == 0).withColumn("predicted", F.when(F.col("p_partkey") % 10 == 0, F.lit("  ")).otherwise(F.col("predicted")))
    return runs.regrade_report(runs.regrade(rows))


# generation and scores


@query(
    """with r as (select item_id, text, ('0x' || substr(sha256('0|0.0|0|' || text), 1, 8))::bigint as whole from benchmark),
    s as (select *, whole / 4294967295.0::double as roll, len(regexp_extract_all(text, '\\S+')) as words from r)
    select item_id as index, whole, roll < 0.6 as gold, words::int as prompt_tokens, 28::int as eval_tokens, (words + 28)::int as total_tokens from s"""
)
def mock_generate(spark, d):
    rows = T.read(spark, d, "benchmark").select(F.col("item_id").alias("index"), F.col("text").alias("prompt"), F.lit(0).alias("sample_index"), F.col("item_id").cast("string").alias("answer"))
    mock = generators.Mock()
    made = mock.generate(rows)
    whole, roll = mock.roll(F.col("prompt"), F.col("sample_index"), 0.0)
    return made.select("index", whole.alias("whole"), (roll < 0.6).alias("gold"), "prompt_tokens", "eval_tokens", "total_tokens")


@query("select event_id, round(case when x >= 0 then 1 / (1 + exp(-x)) else exp(x) / (1 + exp(x)) end, 12) as p from (select event_id, value - 50 as x from events)")
def plus_probability(spark, d):
    return T.read(spark, d, "events").select("event_id", F.round(C.positive_share(F.col("value"), F.lit(50.0)), 12).alias("p"))


@query("select event_id, round(case when event_id % 2 = 0 then v else 1 - v end, 12) as p from (select event_id, (event_id % 1000) / 1000.0::double as v from events)")
def label_probability(spark, d):
    v = (F.col("event_id") % 1000) / 1000.0
    return T.read(spark, d, "events").select("event_id", F.round(C.label_probability(F.when(F.col("event_id") % 2 == 0, "LABEL_1").otherwise("LABEL_0"), v), 12).alias("p"))


@query("select event_id, thinking, case when thinking <> '' then thinking || chr(10) || chr(10) || event_type else event_type end as text from (select event_id, event_type, case when event_id % 3 = 0 then 'so' else '' end as thinking from events)")
def merge_thinking(spark, d):
    e = T.read(spark, d, "events").select("event_id", "event_type", F.when(F.col("event_id") % 3 == 0, "so").otherwise("").alias("thinking"))
    return e.select("event_id", "thinking", generators.merged(F.col("thinking"), F.col("event_type")).alias("text"))


# answers: native functions


@query("select p_partkey, p_size::varchar as numeral, (p_partkey % 9 + 2)::varchar as base from part")
def strip_base(spark, d):
    n = F.concat(F.col("p_size").cast("string"), F.lit("_"), (F.col("p_partkey") % 9 + 2).cast("string"))
    return T.read(spark, d, "part").select("p_partkey", C.strip_base(n).alias("numeral"), C.base_of(n).alias("base"))


@query("select p_partkey, case p_partkey % 3 when 0 then p_size::varchar when 1 then '[' || p_size || ',9]' else 'x==' || p_size end as bare from part")
def strip_prefix(spark, d):
    s = F.col("p_size").cast("string")
    n = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("x="), s)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("xin["), s, F.lit(",9]"))).otherwise(F.concat(F.lit("x=="), s))
    return T.read(spark, d, "part").select("p_partkey", C.strip_prefix(n).alias("bare"))


@query(
    """select p_partkey, case p_partkey % 6 when 0 then '(' || p_size || ',' || (p_size + 3) || ']' when 1 then '[' || p_size || ',' || (p_size + 3) || ')' when 2 then '(-oo,' || p_size || ')'
    when 3 then '[' || p_size || ',oo)' when 4 then null else '[' || p_size || ',' || (p_size + 3) || ')' end as found from part"""
)
def interval_from_inequality(spark, d):
    s, t, k = F.col("p_size").cast("string"), (F.col("p_size") + 3).cast("string"), F.col("p_partkey") % 6
    text = (
        F.when(k == 0, F.concat(s, F.lit("<x<="), t)).when(k == 1, F.concat(s, F.lit("<=x<"), t)).when(k == 2, F.concat(F.lit("x<"), s))
        .when(k == 3, F.concat(F.lit("x>="), s)).when(k == 4, F.concat(s, F.lit("<x>"), t)).otherwise(F.concat(t, F.lit(">x>="), s))
    )
    return T.read(spark, d, "part").select("p_partkey", C.interval(text).alias("found"))


@query("select p_partkey, u.i::int as reading, p_size || case when u.i = 0 then '+' else '-' end || 'sqrt(' || (p_partkey % 7) || ')' as text from part, (values (0), (1)) u(i) where p_partkey % 2 = 0 union all select p_partkey, 0, p_size::varchar from part where p_partkey % 2 = 1")
def expand_plus_minus(spark, d):
    s = F.col("p_size").cast("string")
    n = F.when(F.col("p_partkey") % 2 == 0, F.concat(s, F.lit("+-sqrt("), (F.col("p_partkey") % 7).cast("string"), F.lit(")"))).otherwise(s)
    return T.read(spark, d, "part").select("p_partkey", F.posexplode(C.both_signs(n)).alias("reading", "text"))


@query(f"{_PAIRS} select p_partkey, a || '' || b as form from pairs")
def old_normalise(spark, d):
    return T.answer_pairs(spark, d).select("p_partkey", C.old_normal(F.col("expected")).alias("form"))


@query(f"{_PAIRS} select a || '' || b as form, count(distinct struct_pack(a := a, b := b)) as variants from pairs group by 1 having variants > 1")
def collisions_old(spark, d):
    return audit.collisions(T.answer_pairs(spark, d), C.old_normal(F.col("answer")), "expected").select("form", "variants")


@query(f"{_PAIRS}, c as (select a || '' || b as form, bool_and(a * b0 = b * a0) as genuine, count(distinct struct_pack(a := a, b := b)) as n from (select *, first_value(a) over w as a0, first_value(b) over w as b0 from pairs window w as (partition by a || '' || b order by chr(92) || 'frac{{' || a || '}}{{' || b || '}}')) group by 1) select form, genuine from c where n > 1")
def collisions_classified(spark, d):
    return audit.classify(audit.collisions(T.answer_pairs(spark, d), C.old_normal(F.col("answer")), "expected")).select("form", "genuine")


@query("select 0::bigint as found")
def collisions_new(spark, d):
    return audit.collisions(T.answer_pairs(spark, d), C.normal("answer"), "expected").agg(F.count("*").alias("found"))


@query(
    """with g as (select distinct p_size as n, u.u from part, (values (''), (' cm'), ('_8')) u(u))
    select count(*) as pairs, count(*) as equal_by_grading, 0::bigint as equal_by_value from g x join g y on x.n = y.n and x.u < y.u"""
)
def core_pairs(spark, d):
    """Numbers bare, with a unit and with a base: grading forgives what one side leaves out, values differ."""
    units = F.explode(F.array(F.lit(""), F.concat(F.lit("\\"), F.lit("text{ cm}")), F.lit("_8"))).alias("u")
    golds = T.read(spark, d, "part").select("p_size", units).select(F.concat(F.col("p_size").cast("string"), "u").alias("answer"))
    p = audit.core_pairs(golds)
    return p.agg(F.count("*").alias("pairs"), F.count_if("graded_equal").alias("equal_by_grading"), F.count_if(F.col("equal")).alias("equal_by_value"))


# answers: the scanner


@query(f"{_PAIRS} select p_partkey, a || '/' || b as form from pairs")
def normalise_fraction(spark, d):
    return T.answer_pairs(spark, d).select("p_partkey", C.normal("expected").alias("form"))


_FORMS = {  # kind: (parts of the raw text, parts of its normal form); a and b are numbers of the row
    "boxed": ("\\boxed{\\fbox{ a }}", "a"), "command": ("\\alpha + a \\times b \\foo", "alpha+a*b"), "dash": ("−a – b", "-a-b"), "degree": ("a^\\circ", "a"), "dollars": ("$a$.", "a"),
    "interval": ("x \\in [a, b)", "xin[a,b)"), "matrix": ("\\begin{pmatrix} a & b \\\\ b & a \\end{pmatrix}", "(a,b,b,a)"), "mixed": ("a\\frac{b}{7}", "a*b/7"), "ordinal": ("a^{\\mathrm{th}}", "a"),
    "percent": ("a\\%", "a%"), "power": ("x^{a}", "x**a"), "root": ("\\sqrt[3]{a}", "a**(1/3)"), "set": ("\\{a, b\\}", "{a,b}"), "subscript": ("a_{b}", "a_b"),
    "surd": ("a\\sqrt{b}", "a*sqrt(b)"), "text": ("a\\text{ cm}", "a*cm"), "tuple": ("\\left(a, b\\right)", "(a,b)"),
}

def _filled(text: str, a, b, lit, join):
    """The text with its lone letters a and b replaced by the row's numbers."""
    import re

    parts = re.split(r"(?<![A-Za-z])([ab])(?![A-Za-z])", text)
    return join([{"a": a, "b": b}[p] if i % 2 else lit(p) for i, p in enumerate(parts) if p])


def _forms_sql() -> str:
    rows = ", ".join(
        f"('{k}', " + _filled(form, "p_size::varchar", "(p_partkey % 12 + 1)::varchar", lambda x: "'" + x + "'", " || ".join) + ")" for k, (_, form) in _FORMS.items()
    )
    return f"select p_partkey, u.kind, u.form from part, lateral (values {rows}) u(kind, form)"


@query(_forms_sql())
def normal_forms(spark, d):
    """One of each kind of LaTeX for every part, and the normal form it must have."""
    a, b = F.col("p_size").cast("string"), (F.col("p_partkey") % 12 + 1).cast("string")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), _filled(raw, a, b, F.lit, lambda ps: F.concat(*ps)).alias("raw")) for k, (raw, _) in _FORMS.items()])).alias("u")
    return T.read(spark, d, "part").select("p_partkey", each).select("p_partkey", "u.kind", C.normal("u.raw").alias("form"))


@query(
    "select p_partkey, p_size || '-1' as dashes, p_size::varchar as degrees, p_size || '_' || (p_partkey % 9) as subscripts, p_size || 'x' as ordinals, "
    "p_size || '*x*(' || p_size || ')*y' as products, p_size::varchar as dots from part"
)
def native_steps(spark, d):
    """The steps of the plain form that built-ins can do."""
    s, c = F.col("p_size").cast("string"), lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    return T.read(spark, d, "part").select(
        "p_partkey", C.unify_dashes(c(s, "−1")).alias("dashes"), C.drop_degrees(c(s, "^\\circ")).alias("degrees"), C.flatten_subscripts(c(s, "_{", (F.col("p_partkey") % 9).cast("string"), "}")).alias("subscripts"),
        C.drop_ordinals(c(s, "^{th}x")).alias("ordinals"), C.explicit_products(c(s, "x*(", s, ")y")).alias("products"), C.drop_final_dots(c(s, "...")).alias("dots"),
    )


@query("select p_partkey, p_partkey % 2 = 0 as ok from part")
def grade_intervals(spark, d):
    s, t, even = F.col("p_size").cast("string"), (F.col("p_size") + 5).cast("string"), F.col("p_partkey") % 2 == 0
    said = F.concat(s, F.when(even, F.lit(" < x \\le ")).otherwise(F.lit(" \\le x \\le ")), t)
    rows = T.read(spark, d, "part").select("p_partkey", F.concat(F.lit("("), s, F.lit(", "), t, F.lit("]")).alias("expected"), said.alias("predicted"))
    return grading.grade(rows).select("p_partkey", "ok")


@query("select p_partkey, p_partkey % 3 <> 0 as ok from part")
def grade_plus_minus(spark, d):
    s, k = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    root = F.lit("\\sqrt{11}")
    two, one = F.concat(s, F.lit("-"), root, F.lit(", "), s, F.lit("+"), root), F.concat(s, F.lit("+"), root)
    rows = T.read(spark, d, "part").select("p_partkey", F.concat(s, F.lit("\\pm"), root).alias("expected"), F.when(k == 0, one).when(k == 1, two).otherwise(F.concat(F.lit("x="), two)).alias("predicted"))
    return grading.grade(rows).select("p_partkey", "ok")


@query("select p_partkey, p_partkey % 2 = 1 as ok from part")
def grade_matrices(spark, d):
    s, t = F.col("p_size").cast("string"), (F.col("p_size") + 1).cast("string")
    cells = lambda x, y: F.concat(F.lit("\\begin{pmatrix} "), x, F.lit("/2 \\\\ "), y, F.lit(" \\end{pmatrix}"))
    half = F.format_string("%.1f", F.col("p_size") / 2)
    said = F.when(F.col("p_partkey") % 2 == 1, F.concat(F.lit("("), half, F.lit(", "), t, F.lit(")"))).otherwise(F.concat(F.lit("("), t, F.lit(", "), half, F.lit(")")))
    rows = T.read(spark, d, "part").select("p_partkey", cells(s, t).alias("expected"), said.alias("predicted"))
    return grading.grade(rows).select("p_partkey", "ok")


@query("select event_id, abs(value - (value + d)) <= greatest(1e-9 * greatest(abs(value), abs(value + d)), 1e-9) as near from (select event_id, value, case when event_id % 2 = 0 then 1e-10 else 1e-3 end as d from events)")
def close_numbers(spark, d):
    moved = F.col("value") + F.when(F.col("event_id") % 2 == 0, F.lit(1e-10)).otherwise(F.lit(1e-3))
    return T.read(spark, d, "events").select("event_id", C.close(F.col("value"), moved).alias("near"))


@query("select o_orderkey, ((o_totalprice * 100)::bigint + 1000)::varchar as form from orders where o_orderkey % 3 = 0")
def digit_grouping(spark, d):
    n = (F.round(F.col("o_totalprice") * 100).cast("bigint") + 1000)
    return T.read(spark, d, "orders").where("o_orderkey % 3 = 0").select("o_orderkey", C.normal(F.format_number(n, 0)).alias("form"))


@query("select o_orderkey, ((o_totalprice * 100)::bigint + 1000)::varchar as form from orders where o_orderkey % 3 = 0")
def digit_grouping_native(spark, d):
    n = (F.round(F.col("o_totalprice") * 100).cast("bigint") + 1000)
    return T.read(spark, d, "orders").where("o_orderkey % 3 = 0").select("o_orderkey", C.lone_grouping(F.format_number(n, 0)).alias("form"))


@query(f"{_PAIRS} select p_partkey, {_SAME} as ok from pairs")
def grade_fraction_pairs(spark, d):
    return grading.grade(T.answer_pairs(spark, d)).select("p_partkey", "ok")


@query("select p_partkey, p_partkey % 3 = 0 as ok from part")
def grade_units(spark, d):
    s, k = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    unit = lambda u: F.concat(s, F.lit("\\"), F.lit("text{ " + u + "}"))
    rows = T.read(spark, d, "part").select("p_partkey", unit("cm").alias("expected"), F.when(k == 0, s).when(k == 1, unit("km")).otherwise((F.col("p_size") + 1).cast("string")).alias("predicted"))
    return grading.grade(rows).select("p_partkey", "ok")


@query("select p_partkey, p_partkey % 3 <> 2 as ok from part")
def grade_sets(spark, d):
    s, t, k = F.col("p_size").cast("string"), (F.col("p_partkey") + 100).cast("string"), F.col("p_partkey") % 3
    fence = lambda o, x, y, c: F.concat(F.lit(o), x, F.lit(", "), y, F.lit(c))
    predicted = F.when(k == 0, fence("\\{", t, s, "\\}")).when(k == 1, fence("", t, s, "")).otherwise(fence("(", s, t, ")"))
    rows = T.read(spark, d, "part").select("p_partkey", fence("\\{", s, t, "\\}").alias("expected"), predicted.alias("predicted"))
    return grading.grade(rows).select("p_partkey", "ok")


@query("select p_partkey, p_partkey % 2 = 0 as ok from part")
def grade_surds(spark, d):
    s = F.col("p_size")
    root = lambda n: F.concat(F.lit("\\"), F.lit("sqrt{"), n.cast("string"), F.lit("}"))
    square = s * s * 13 + F.when(F.col("p_partkey") % 2 == 0, 0).otherwise(13)
    rows = T.read(spark, d, "part").select("p_partkey", F.concat(s.cast("string"), root(F.lit(13))).alias("expected"), root(square).alias("predicted"))
    return grading.grade(rows).select("p_partkey", "ok")


@query("select p_partkey, case p_partkey % 8 when 6 then false when 7 then p_partkey % 3 = 0 else true end as ok from part")
def grade_identities(spark, d):
    """Answers that are equal as functions only: trigonometry, powers of one base, high powers, roots, factorials."""
    s, t, k = F.col("p_size").cast("string"), (F.col("p_partkey") % 12 + 1).cast("string"), F.col("p_partkey") % 8
    c = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    high, more = (F.col("p_size") + 30).cast("string"), (F.col("p_size") + 31).cast("string")
    sides = [
        (c("\\sin(", s, "x)^2+\\cos(", s, "x)^2"), F.lit("1")), (c("\\sin(", (F.col("p_size") * 2).cast("string"), "y)"), c("2\\sin(", s, "y)\\cos(", s, "y)")),
        (c("2^{", s, "x}*2^{", t, "x}"), c("2^{", (F.col("p_size") + F.col("p_partkey") % 12 + 1).cast("string"), "x}")), (c("x^{", high, "}"), c("x*x^{", (F.col("p_size") + 29).cast("string"), "}")),
        (c("(x+", s, ")^{25}"), c("(", s, "+x)^{25}")), (c("\\sqrt{x+", s, "}^2"), c("x+", s)), (c("x^{", high, "}"), c("x^{", more, "}")),
        (c((F.col("p_partkey") % 10 + 1).cast("string"), "!"), (F.factorial((F.col("p_partkey") % 10 + 1).cast("int")) + F.when(F.col("p_partkey") % 3 == 0, 0).otherwise(1)).cast("string")),
    ]
    pick = lambda side: F.element_at(F.array(*[x[side] for x in sides]), (k + 1).cast("int"))
    return grading.grade(T.read(spark, d, "part").select("p_partkey", pick(0).alias("expected"), pick(1).alias("predicted"))).select("p_partkey", "ok")


@query("select p_partkey, p_size::double / (p_partkey % 12 + 1) as value from part")
def parse_number(spark, d):
    return T.answer_pairs(spark, d).select("p_partkey", C.number("expected").alias("value"))


_SAID = "item_id * 3 + case when item_id % 4 = 0 then 1 else 0 end"


@query(f"select item_id::int as index, case item_id % 3 when 2 then 'No more to say here.' else ({_SAID})::varchar end as predicted, item_id % 3 <> 2 as matched from benchmark".replace("when 2 then 'No more to say here.'", f"when 2 then 'x = ' || ({_SAID})").replace("item_id % 3 <> 2 as matched", "true as matched"))
def extract_answer(spark, d):
    return grading.read_answers(T.responses(spark, d)).select("index", "predicted", "matched")


@query(f"select item_id::int as index, ({_SAID})::varchar as box from benchmark where item_id % 3 = 0")
def extract_boxed(spark, d):
    return T.responses(spark, d).select("index", F.explode(C.boxes("text")).alias("box"))


@query(f"select item_id::int as index, ({_SAID})::varchar as box from benchmark where item_id % 3 = 0")
def extract_boxed_native(spark, d):
    return T.responses(spark, d).select("index", C.last_flat_box(F.col("text")).alias("box")).where("box is not null")


_STEPS = (
    "steps as (select item_id::int as index, u.i::int as step, case u.i when 0 then 'We read the question once more.' when 1 then 'Then it follows: x = ' || ({s}) else "
    "case item_id % 3 when 0 then 'So ' || chr(92) || 'boxed{{' || ({s}) || '}}' when 1 then 'The final answer is ' || ({s}) || '.' else 'No more to say here.' end end as text from benchmark, (values (0), (1), (2)) u(i))"
).format(s=_SAID)


@query(f"with {_STEPS} select * from steps")
def extract_steps(spark, d):
    return grading.read_steps(T.responses(spark, d)).select("index", F.posexplode("steps").alias("step", "text"))


@query(f"with {_STEPS} select x.index, x.step, any_value(b.text) || chr(10) || chr(10) || string_agg(y.text, chr(10) || chr(10) order by y.step) as prefix from steps x join steps y on x.index = y.index and y.step <= x.step join benchmark b on b.item_id = x.index group by 1, 2")
def step_prefixes(spark, d):
    return grading.step_prefixes(grading.read_steps(T.responses(spark, d))).select("index", "step", "prefix")


@query(f"with {_STEPS} select index, step, text, case when step < 2 then (step + 1) / 4.0::double end as score from steps")
def step_scores(spark, d):
    rows = grading.read_steps(T.responses(spark, d)).select("index", "steps", F.array(F.lit(0.25), F.lit(0.5)).alias("scores"))
    return grading.zip_scores(rows)


@query("select item_id::int as index, 0::int as none, null::double as score from benchmark")
def no_scorer(spark, d):
    rows = scorers.NoScorer().score(grading.read_steps(T.responses(spark, d)))
    return rows.select("index", F.size("step_scores").alias("none"), "score")


@query(f"select item_id::int as index, 3::int as steps, round((0.5 + 0.55 + 0.6) / 3, 12) as score from benchmark")
def step_scorer(spark, d):
    def load():
        return lambda text: [{"entity": "LABEL_1", "score": 0.45 + 0.05 * (text.count("\n\n") - 1)}]

    rows = scorers.StepScorer(load).score(grading.read_steps(T.responses(spark, d)).withColumn("problem", F.lit("p")))
    return rows.select("index", F.size("step_scores").alias("steps"), F.round("score", 12).alias("score"))


@query("with s as (select index, sample_index, predicted, min(sample_index) over (partition by index, predicted) as head from (select conv_id as index, cast(row_number() over (partition by conv_id order by turn) - 1 as int) as sample_index, length(text) % 3 as predicted from conversations where role = 'assistant')) select index, sample_index, (dense_rank() over (partition by index order by head) - 1)::int as class from s")
def equivalence_classes(spark, d):
    """Answers spelled in three ways; classes must be those of the numbers."""
    s = T.view(spark, d, "samples").select("index", "sample_index", "predicted")
    k, n = F.col("sample_index") % 3, F.col("predicted")
    spelled = F.when(k == 0, n).when(k == 1, F.concat(n, F.lit(".0"))).otherwise(F.concat(F.lit("\\frac{"), (n.cast("int") * 2).cast("string"), F.lit("}{2}")))
    return selection.equivalence_classes(s.withColumn("predicted", spelled)).select("index", "sample_index", "class")


@query(T.with_view("samples", f"{_VOTED} select {_ROW} from (select *, {_PICK['majority']} as r from voted) where r = 1"))
def majority_equivalent(spark, d):
    s = T.view(spark, d, "samples").select(*_ROW.split(", "))
    spelled = F.when(F.col("sample_index") % 2 == 0, F.col("plain")).otherwise(F.concat("plain", F.lit(".0")))
    classed = selection.equivalence_classes(s.withColumnRenamed("predicted", "plain").withColumn("predicted", spelled))
    return selection.select(classed, "majority", "class").select("index", "sample_index", F.col("plain").alias("predicted"), "milli", "ok")


@query("select event_id, cast(json_extract(props, '$.k') as int) as k from events")
def json_props(spark, d):
    return T.read(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("select n, case when n < 500 then 'report_mock_partial.html' else 'report.html,report_mock.html' end as targets from (select o_orderkey % 1000 as n from orders)")
def report_targets(spark, d):
    n = F.col("o_orderkey") % 1000
    from . import report

    partial, full = ",".join(report.targets("report.html", "mock", 1)), ",".join(report.targets("report.html", "mock", 500))
    return T.read(spark, d, "orders").select(n.alias("n"), F.when(n < report.FULL_RUN, partial).otherwise(full).alias("targets"))
