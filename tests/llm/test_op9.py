import math

import pytest
from pyspark.sql import functions as F

from verdica.llm import op9_host_reputation as op


def test_urls(spark):
    cases = {
        "https://User@WWW.Example.co.uk.:80/x?y": ("www.example.co.uk", "example.co.uk", "co.uk"), "http://a.b.c.com": ("a.b.c.com", "c.com", "com"), "ftp://localhost/x": ("localhost", "localhost", "localhost"),
        "https://m.shop.example.net/en/25#top": ("m.shop.example.net", "example.net", "net"), "https://co.uk/": ("co.uk", "co.uk", "co.uk"), "no url": (None, None, None), "": (None, None, None), "http:///x": (None, None, None),
        "https://me.github.io/x": ("me.github.io", "me.github.io", "github.io"), "https://a.hmrc.gov.uk/": ("a.hmrc.gov.uk", "hmrc.gov.uk", "gov.uk"), "http://www.shop.foo.ck/": ("www.shop.foo.ck", "shop.foo.ck", "foo.ck"),
        "http://a.www.ck/": ("a.www.ck", "www.ck", "ck"), "http://1.2.3.4:8080/x": ("1.2.3.4", "1.2.3.4", op.ADDRESS), "http://[2001:db8::1]:80/": ("[2001:db8::1]", "[2001:db8::1]", op.ADDRESS), "http://[::1": (None, None, None),
        "http://a..com/": ("a..com", ".com", "com"), "http://1.2.3.4.com/": ("1.2.3.4.com", "4.com", "com"),
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string").withColumn("h", op.host_of(F.col("url")))
    for r in df.select("url", "h", op.domain_of(F.col("h")).alias("d"), op.suffix_of(F.col("h")).alias("s")).collect():
        assert (r["h"], r["d"], r["s"]) == cases[r["url"]], r["url"]
    table = spark.createDataFrame([("shop.example.net",), (None,), (" ",)], "suffix string")
    one = df.where("h = 'm.shop.example.net'").select(op.domain_of(F.col("h"), table), op.suffix_of(F.col("h"), table))
    assert tuple(one.first()) == ("m.shop.example.net", "shop.example.net")


def brute(hosts):
    """hosts: {host: (domain, suffix, n, y)}; posterior means and variances level by level."""
    def level(groups, above):
        dev = sum(n * (y / n - above[g][0]) ** 2 for g, (n, y) in groups.items() if n)
        v = sum(above[g][0] * (1 - above[g][0]) for g, (n, _) in groups.items() if n)
        more = sum(above[g][0] * (1 - above[g][0]) * (n - 1) for g, (n, _) in groups.items() if n)
        rho = min(1 / (1 + op.LEAST_STRENGTH), max(0, (dev - v) / more)) if more else 0
        out = {}
        for g, (n, y) in groups.items():
            m, var = above[g]
            if rho == 0:
                out[g] = (m, var)
                continue
            s = (1 - rho) / rho  # pages that the prior counts as
            a = (m * s + y) / (s + n)
            out[g] = (a, a * (1 - a) / (s + n + 1) + (s / (s + n)) ** 2 * var)
        return out

    def summed(place):
        out = {}
        for h in hosts.values():
            n, y = out.get(h[place], (0, 0))
            out[h[place]] = (n + h[2], y + h[3])
        return out

    n, y = sum(h[2] for h in hosts.values()), sum(h[3] for h in hosts.values())
    p = (y + 1) / (n + 2)
    up = {h[0]: h[1] for h in hosts.values()}
    suffix = level(summed(1), dict.fromkeys(summed(1), (p, p * (1 - p) / (n + 3))))
    domain = level(summed(0), {d: suffix[up[d]] for d in summed(0)})
    return level({k: h[2:] for k, h in hosts.items()}, {k: domain[h[0]] for k, h in hosts.items()})


def test_posteriors_against_a_loop(spark):
    rows, hosts = [], {}
    for d in range(6):
        for h in range(4):
            host, domain, suffix = f"h{h}.d{d}.{'com' if d % 2 else 'org'}", f"d{d}.{'com' if d % 2 else 'org'}", "com" if d % 2 else "org"
            n, y = (d * h) % 7, min((d * h) % 7, d)
            hosts[host] = (domain, suffix, n, y)
            rows += [(len(rows), f"http://{host}/{i}", i < y if i < n else None) for i in range(n + 2)]
    got = {r["host"]: r for r in op.reputation(spark.createDataFrame(rows, "page_id int, url string, bad boolean")).collect()}
    for k, (a, var) in brute(hosts).items():
        assert got[k]["mean"] == pytest.approx(a, abs=1e-9) and (got[k]["labelled"], got[k]["bad"]) == hosts[k][2:]
        low = a - op.Z * math.sqrt(var)
        assert got[k]["low"] == pytest.approx(max(0, low), abs=1e-9) and got[k]["rejected"] == (low > op.LIMIT)


def test_one_bad_label_rejects_nothing(spark):
    df = spark.createDataFrame([(i, f"http://h{i}.com/", True if i == 3 else None) for i in range(9)], "page_id int, url string, bad boolean")
    assert op.keep(df).count() == 9


def test_no_window_and_no_single_task_sort(spark):
    df = spark.createDataFrame([(1, "http://a.com/", True)], "page_id int, url string, bad boolean")
    plan = op.judge(df)._jdf.queryExecution().toString()
    assert "Window" not in plan and "SinglePartition" not in plan and "NestedLoop" not in plan


def test_bad_hosts_go_and_others_stay(spark):
    rows = [(i, f"http://bad{i % 3}.farm.com/{i}", True) for i in range(90)] + [(100 + i, f"http://good{i % 5}.site{i % 7}.org/{i}", i % 10 == 0) for i in range(200)] + [(500, "http://new.site1.org/", None), (501, None, None), (502, "junk", True)]
    df = spark.createDataFrame(rows, "page_id int, url string, bad boolean")
    kept = {r["page_id"] for r in op.keep(df).collect()}
    assert not kept & set(range(90)) and {100 + i for i in range(200)} | {500, 501, 502} <= kept
    judged = op.judge(df)
    assert judged.count() == len(rows) and {r["page_id"] for r in judged.where("kept").collect()} == kept


def test_odd_rows(spark):
    schema = "page_id int, url string, bad boolean, host string, mean string, _host string, _up string"
    rows = [(1, "http://a.com/", None), (1, "http://a.com/", None), (None, None, None), (2, "", None), (3, "http://" + "x" * 5000 + ".com/", None)]
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], schema)
    assert op.keep(df).count() == 5 and op.keep(df).columns == df.columns and op.judge(df).where("kept").count() == 5
    assert op.keep(df.where("false")).count() == 0 and op.judge(df.where("false")).count() == 0
    pages = df.withColumnRenamed("bad", "doc_id")
    labels = spark.createDataFrame([(1, 0, 0, "u"), (None, 1, 1, "u")], "doc_id long, quality int, toxic int, url string")
    assert op.outcomes(pages, labels).count() == 5


def test_numbers_of_any_bigint_are_labelled(spark):
    numbers = {"7": 7, "007": 7, "999999999": 999999999, "1000000000": 10**9, "12345678901.html": 12345678901, "9223372036854775807/?x#y": 2**63 - 1, "9223372036854775808": None, "1" * 30: None, "0": None, "x": None, "": None}
    pages = spark.createDataFrame([(i, f"http://a.com/{u}") for i, u in enumerate(numbers)] + [(99, None)], "page_id int, url string")
    ids = sorted({n for n in numbers.values() if n})
    labels = spark.createDataFrame([(n, k % 2, 0) for k, n in enumerate(ids)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["bad"] for r in op.outcomes(pages, labels).collect()}
    assert got == {i: None if n is None else ids.index(n) % 2 == 0 for i, n in enumerate(numbers.values())} | {99: None}
    small = labels.where("doc_id < 2000000000").withColumn("doc_id", F.col("doc_id").cast("int"))
    assert op.outcomes(pages, small).where("bad is not null").count() == 4
