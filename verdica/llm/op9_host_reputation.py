"""URL filter by empirical-Bayes host reputation.

A labelled page is good or bad.  Bad pages are counted for each host, its registered
domain and that one's suffix.  Rates are shrunk down the hierarchy: the suffix towards
the whole, the domain towards its suffix, the host towards its domain.  At each level the
prior is a beta distribution whose mean ``m`` is the parent's posterior mean and whose
spread is found from all groups of the level by moments: a group of n pages and y bad ones
has the expected square deviation ``m (1 - m) (1 + (n - 1) rho) / n``.  ``rho``, the
correlation of pages within a group, is 0 where groups don't differ more than by chance (all
have their parent's rate; also where no group has two labels); the prior counts as many
pages as ``(1 - rho) / rho``, any number from ``least_strength`` on, a parameter: one page, so
that a single label never says all of a group.  A group's variance is that of its own
posterior and, as far as it rests on its parent, the parent's.

A host whose posterior bad rate exceeds ``LIMIT`` even at its lower bound, ``Z`` standard
deviations below the mean, is rejected, and its pages with it; a host without labelled pages
has its domain's mean and wide bounds.

Suffixes are the last label, or the longest that a public suffix list has (``suffixes``: rules with
``*`` and ``!``, an iterable or a table with a column ``suffix``, of list size).  An IP address
is its own domain; all of them have the suffix ``(address)``.

Counts and posteriors are sums over the pages and tables of hosts, so all of it is
plain SQL; the html is never read.  Hosts are aggregated once and each level is written down, so
no window or sort holds more than a group.

Defined cases: a url without a host (null, empty, malformed) has host null and is judged
as a group of its own without parents but the whole; a url's label is that of the row it
is joined to, null is unlabelled, as is a number beyond the type of doc_id; repeated rows count each; without any label nothing is
rejected; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, kind, require, sized
from .suffixes import SUFFIXES

LIMIT = 0.5
Z = 1.645
LEAST_STRENGTH = 1.0
ADDRESS = "(address)"
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]]+)"
_IS_ADDRESS = r"^(?:\[.*\]|[0-9]{1,3}(?:\.[0-9]{1,3}){3})$"


def host_of(url: Column) -> Column:
    """The lower-cased host without user, port and final dot, null where there is none."""
    found = F.lower(F.regexp_extract(url, _HOST, 1))
    return F.nullif(F.regexp_replace(found, r"\.+$", ""), F.lit(""))


def rules_of(suffixes: Iterable[str] | DataFrame) -> list[str]:
    listed = [r[0] for r in suffixes.select("suffix").collect()] if isinstance(suffixes, DataFrame) else list(suffixes)
    return sorted({s.strip().lower() for s in listed if s and s.strip()})


def _labels(host: Column, n: Column) -> Column:
    """The last n labels of a host."""
    parts = F.split(host, r"\.")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.greatest(n, F.lit(0))), ".")


def _suffix_labels(host: Column, rules: list[str]) -> Column:
    """How many labels the host's suffix has: the longest rule that matches, an exception before all."""
    plain = [r for r in rules if r[0] not in "*!"]
    wild, exempt = [r[2:] for r in rules if r.startswith("*.")], [r[1:] for r in rules if r[0] == "!"]
    has = lambda c, some: c.isin(some) if some else F.lit(False)
    out, size = F.lit(1), F.size(F.split(host, r"\."))
    deepest = max((r.count(".") + 1 for r in rules), default=1)
    for n in range(2, deepest + 1):
        here = has(_labels(host, F.lit(n)), plain) | has(_labels(host, F.lit(n - 1)), wild)
        out = F.when((size >= n) & here, F.lit(n)).otherwise(out)
    for n in range(2, deepest + 1):
        out = F.when((size >= n) & has(_labels(host, F.lit(n)), exempt), F.lit(n - 1)).otherwise(out)
    return out


def suffix_of(host: Column, suffixes=SUFFIXES) -> Column:
    return F.when(F.regexp_like(host, F.lit(_IS_ADDRESS)), F.lit(ADDRESS)).otherwise(_labels(host, _suffix_labels(host, rules_of(suffixes))))


def domain_of(host: Column, suffixes=SUFFIXES) -> Column:
    """The suffix with one more label; the host itself where it has none, or is an address."""
    return F.when(F.regexp_like(host, F.lit(_IS_ADDRESS)), host).otherwise(_labels(host, _suffix_labels(host, rules_of(suffixes)) + 1))


def _rho(groups: DataFrame, least_strength: float) -> float:
    """The correlation of pages within the groups (n, y, mean) of a level."""
    v = F.col("mean") * (1 - F.col("mean"))
    square = F.col("n") * F.pow(F.col("y") / F.col("n") - F.col("mean"), F.lit(2.0))
    # sum of n * deviation^2 = sum of v * (1 + (n - 1) * rho)
    some = groups.where("n > 0").agg(F.sum(square).alias("square"), F.sum(v).alias("v"), F.sum(v * (F.col("n") - 1)).alias("more")).first()
    return min(1 / (1 + least_strength), max(0.0, (some["square"] - some["v"]) / some["more"])) if some["more"] else 0.0


def _level(parents: DataFrame, counts: DataFrame, up: str, least_strength: float) -> DataFrame:
    """The groups with the mean and variance of their posterior, from their parents'."""
    above = sized(parents.select(F.col(up).alias("_up"), F.col("post").alias("mean"), F.col("var").alias("_var")))
    groups = counts.join(above, F.col(up).eqNullSafe(F.col("_up"))).drop("_up")
    rho = _rho(groups, least_strength)
    weight = F.lit(1 - rho) + F.col("n") * rho
    post = F.coalesce((F.col("mean") * (1 - rho) + F.col("y") * rho) / F.nullif(weight, F.lit(0.0)), F.col("mean"))
    rest = F.coalesce((1 - rho) / F.nullif(weight, F.lit(0.0)), F.lit(1.0))
    own = F.col("post") * (1 - F.col("post")) * rho / (1 + F.col("n") * rho)
    return groups.withColumn("post", post).withColumn("var", own + rest * rest * F.col("_var")).drop("mean", "_var")


def reputation(pages: DataFrame, limit: float = LIMIT, z: float = Z, suffixes: Iterable[str] | DataFrame = SUFFIXES, least_strength: float = LEAST_STRENGTH) -> DataFrame:
    """(host, domain, suffix, pages, labelled, bad, mean, low, high, rejected) of each host; pages need url and bad."""
    scratch, rules = Scratch(pages.sparkSession, "hosts"), rules_of(suffixes)
    base = require(pages, "url", "bad").select(host_of(F.col("url")).alias("host"), F.col("bad").cast("boolean").alias("bad"))
    hosts = base.groupBy("host").agg(F.count("*").alias("pages"), F.count("bad").alias("n"), F.count_if("bad").alias("y"))
    hosts = scratch.table(hosts.withColumns({"domain": domain_of(F.col("host"), rules), "suffix": suffix_of(F.col("host"), rules)}), "hosts")
    sums = [F.sum("n").alias("n"), F.sum("y").alias("y")]
    domains = scratch.table(hosts.groupBy("domain", "suffix").agg(*sums), "domain-counts")
    suffixes_ = scratch.table(domains.groupBy("suffix").agg(*sums), "suffix-counts")
    n, y = suffixes_.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("y"), F.lit(0))).first()
    p = (y + 1) / (n + 2)
    whole = pages.sparkSession.createDataFrame([(True, p, p * (1 - p) / (n + 3))], "whole boolean, post double, var double")
    suffix = scratch.table(_level(whole, suffixes_.withColumn("whole", F.lit(True)), "whole", least_strength), "suffix")
    domain = scratch.table(_level(suffix, domains, "suffix", least_strength), "domain")
    host = _level(domain, hosts, "domain", least_strength)
    a, sd = F.col("post"), F.sqrt("var")
    return host.select(
        "host", "domain", "suffix", "pages", F.col("n").alias("labelled"), F.col("y").alias("bad"), a.alias("mean"),
        F.greatest(F.lit(0.0), a - z * sd).alias("low"), F.least(F.lit(1.0), a + z * sd).alias("high"), ((a - z * sd > limit) & F.lit(n > 0)).alias("rejected"),
    )


def judge(pages: DataFrame, **options) -> DataFrame:
    """The pages' page_id, host, the host's figures, and whether the page stays."""
    hosts = Scratch(pages.sparkSession, "reputation").table(reputation(pages, **options), "hosts")
    mine = require(pages, "page_id", "url").select("page_id", host_of(F.col("url")).alias("_host"))
    joined = mine.join(sized(hosts.select("host", "mean", "low", "high", "rejected")), F.col("_host").eqNullSafe(F.col("host")))
    return joined.select("page_id", "host", "mean", "low", "high", (~F.col("rejected")).alias("kept"))


def keep(pages: DataFrame, **options) -> DataFrame:
    """The pages of hosts that aren't rejected, with the columns of ``pages``."""
    gone = Scratch(pages.sparkSession, "reputation").table(reputation(pages, **options).where("rejected").select("host"), "gone")
    return pages.join(sized(gone), host_of(pages["url"]).eqNullSafe(gone["host"]), "left_anti")


def outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Pages with ``bad`` from the labels of the documents that their urls number (null without one)."""
    number = F.regexp_extract(pages["url"], r"/([0-9]+)(?:\.html)?/?(?:[?#].*)?$", 1).try_cast("bigint")
    marks = require(labels, "doc_id", "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(((F.min("quality") < 1) | (F.max("toxic") > 0)).alias("bad"))
    marks = Scratch(pages.sparkSession, "outcomes").table(marks, "labels")
    out = require(pages, "page_id", "url").withColumn("_doc", number.try_cast(kind(labels, "doc_id")))
    return out.join(sized(marks), F.col("_doc") == F.col("doc_id"), "left").select("page_id", "url", "bad")


def oracle() -> str:
    """judge(outcomes(pages, labels)) as DuckDB SQL."""
    rules = rules_of(SUFFIXES)
    quoted = lambda some: ", ".join(f"'{r}'" for r in some)
    plain = quoted(r for r in rules if r[0] not in "*!")
    wild, exempt = quoted(r[2:] for r in rules if r.startswith("*.")), quoted(r[1:] for r in rules if r[0] == "!")
    deepest = max(r.count(".") + 1 for r in rules)
    last = lambda n: f"array_to_string(parts[greatest(len(parts) - ({n}) + 1, 1):], '.')"
    exceptions = " ".join(f"when len(parts) >= {n} and {last(n)} in ({exempt}) then {n - 1}" for n in range(deepest, 1, -1))
    longest = " ".join(f"when len(parts) >= {n} and ({last(n)} in ({plain}) or {last(n - 1)} in ({wild})) then {n}" for n in range(deepest, 1, -1))

    def level(name: str, groups: str) -> str:
        v = "mean * (1 - mean)"
        rho = f"(sum(n * pow(y::double / n - mean, 2)) - sum({v})) / nullif(sum({v} * (n - 1)), 0)"
        return (
            f"{name}_g as ({groups}), {name}_r as (select coalesce(least({1 / (1 + LEAST_STRENGTH)!r}, greatest(0, {rho})), 0) as rho from {name}_g where n > 0), "
            f"{name}_p as (select g.*, rho, coalesce((mean * (1 - rho) + y * rho) / nullif(1 - rho + n * rho, 0), mean) as post, coalesce((1 - rho) / nullif(1 - rho + n * rho, 0), 1) as rest from {name}_g g, {name}_r), "
            f"{name} as (select * exclude (var), post * (1 - post) * rho / (1 + n * rho) + rest * rest * var as var from {name}_p)"
        )

    low = f"post - {Z} * sqrt(var)"
    return f"""
with marks as (select doc_id, min(quality) < 1 or max(toxic) > 0 as bad from labels where doc_id is not null group by 1),
base as (
  select page_id, bad, nullif(regexp_replace(lower(regexp_extract(url, '{_HOST}', 1)), '\\.+$', ''), '') as host
  from pages left join marks on try_cast(regexp_extract(url, '/([0-9]+)(?:\\.html)?/?(?:[?#].*)?$', 1) as bigint) = doc_id),
counted as (select host, string_split(host, '.') as parts, count(*) as pages, count(bad) as n, count(*) filter (where bad) as y from base group by host),
deep as (select *, case {exceptions} {longest} else 1 end as k, regexp_matches(host, '{_IS_ADDRESS}') as address from counted),
hosts as (
  select host, pages, n, y, case when address then host else {last('k + 1')} end as domain, case when address then '{ADDRESS}' else {last('k')} end as suffix from deep),
whole as (select p, p * (1 - p) / (n + 3) as v from (select (coalesce(sum(y), 0) + 1)::double / (coalesce(sum(n), 0) + 2) as p, coalesce(sum(n), 0) as n from hosts)),
{level('su', "select suffix, sum(n)::bigint as n, sum(y)::bigint as y, any_value(p) as mean, any_value(v) as var from hosts, whole group by suffix")},
{level('dom', "select h.domain, h.suffix, h.n, h.y, su.post as mean, su.var as var from (select domain, suffix, sum(n)::bigint as n, sum(y)::bigint as y from hosts group by 1, 2) h join su on h.suffix is not distinct from su.suffix")},
{level('ho', "select h.*, d.post as mean, d.var as var from hosts h join dom d on h.domain is not distinct from d.domain")}
select page_id, ho.host, round(post, 9) as mean, round(greatest(0, {low}), 9) as low, round(least(1, post + {Z} * sqrt(var)), 9) as high,
  not ({low} > {LIMIT} and (select sum(n) from hosts) > 0) as kept
from base join ho on base.host is not distinct from ho.host
"""
