import numpy as np
import pytest

from verdica.llm import op2_raking as op


def test_raking_meets_all_marginals():
    rng = np.random.default_rng(1)
    codes = np.array([(a, b, c) for a in range(4) for b in range(3) for c in range(2)])
    tokens = rng.integers(1, 1000, len(codes)).astype(float)
    wanted = [np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.5, 0.25, 0.25]), np.array([0.7, 0.3])]
    w = op.rake(codes, tokens, wanted, 60)
    for d, shares in enumerate(wanted):
        assert np.bincount(codes[:, d], weights=w) == pytest.approx(shares, abs=1e-9)
    # raking keeps the cells' odds ratios
    grid, was = w.reshape(4, 3, 2), (tokens / tokens.sum()).reshape(4, 3, 2)
    odds = lambda g: g[0, 0, 0] * g[1, 1, 0] / (g[0, 1, 0] * g[1, 0, 0])
    assert odds(grid) == pytest.approx(odds(was))


def test_scale_spends_the_fraction():
    rng = np.random.default_rng(2)
    for fraction in (0.05, 0.5, 0.95):
        w, t = rng.random(30) * 5, rng.integers(1, 99, 30)
        s = op.scale_for(w, t, fraction)
        assert (np.minimum(1, s * w) * t).sum() == pytest.approx(fraction * t.sum())
    assert op.scale_for(np.array([0.0, 1.0]), np.array([9, 1]), 0.5) == float("inf")


def test_target_shares():
    have = {"a": 0.5, "b": 0.3, "c": 0.2}
    assert op.target_shares(have, {"a": 0.2, "z": 0.3}) == pytest.approx({"a": 0.2 / 0.7, "b": 0.5 * 0.6 / 0.7, "c": 0.5 * 0.4 / 0.7})
    assert op.target_shares(have, 0) == pytest.approx(dict.fromkeys("abc", 1 / 3))
    assert op.target_shares(have, 1) == pytest.approx(have)


def test_odd_rows(awkward, no_docs):
    out = op.mix(awkward)
    assert out.columns == awkward.columns and 0 < out.count() <= awkward.count()
    assert op.mix(awkward, fraction=1.0, targets={"source": 1, "lang": 1, "topic": 1}).count() == awkward.count()
    assert op.mix(no_docs).count() == 0 and op.sample(no_docs).count() == 0
    ids = [r[0] for r in op.sample(awkward, fraction=1.0, targets={"source": 1, "lang": 1, "topic": 1}).select("doc_id").collect()]
    assert ids.count(6) == 2 and ids.count(None) == 1
    values = {r["source"] for r in op.cell_weights(awkward).collect()}
    assert "(none)" in values


def test_texts_without_tokens_are_drawn_at_the_plain_rate(spark):
    docs = spark.createDataFrame([(i, None, "en", "s") for i in range(400)], "doc_id long, text string, lang string, source string")
    assert 180 < op.mix(docs, fraction=0.5).count() < 300


def test_the_distributed_way_agrees(awkward, spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (docs, awkward):
        a = {tuple(r[:3]): (r[3], r[4]) for r in op.cell_weights(df, rounds=6).collect()}
        b = {tuple(r[:3]): (r[3], r[4]) for r in op.cell_weights(df, rounds=6, driver_cells=0).collect()}
        assert a.keys() == b.keys()
        for k in a:
            assert a[k] == pytest.approx(b[k], rel=1e-6, abs=1e-9)


def test_languages_that_no_target_names_are_drawn(spark):
    have = {"en": 0.5, "de": 0.1, "it": 0.2, "(none)": 0.2}
    assert op.target_shares(have, op.TARGETS["lang"]) == pytest.approx({"en": 0.4, "de": 0.2, "it": 0.2, "(none)": 0.2})
    assert op.target_shares({"it": 0.3, "(none)": 0.7}, op.TARGETS["lang"]) == pytest.approx({"it": 0.3, "(none)": 0.7})
    langs = ["en"] * 5 + ["de"] + ["it"] * 2 + [None] * 2
    docs = spark.createDataFrame([(i, "one two three four", langs[i % 10], "s") for i in range(1000)], "doc_id long, text string, lang string, source string")
    n = {r["lang"]: r["count"] for r in op.mix(docs).groupBy("lang").count().collect()}
    assert n.keys() == {"en", "de", "it", None} and 90 < n["it"] < 150 and 90 < n[None] < 150
    a, b = ({tuple(r[:3]): tuple(r[3:]) for r in op.cell_weights(docs, driver_cells=k, rounds=2).collect()} for k in (99, 0))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-6) for k in a)


def test_slow_and_impossible_targets():
    """Few cells make raking slow: it goes on until the marginals are met; targets that can't be met are told."""
    codes = np.array([(0, 0), (0, 1), (1, 1), (1, 2), (2, 2)])
    tokens = np.array([5.0, 1, 1, 1, 900])
    wanted = [np.array([0.4, 0.35, 0.25]), np.array([0.2, 0.4, 0.4])]
    w = op.rake(codes, tokens, wanted)
    assert op.marginal_error(codes, w, wanted) <= op.TOLERANCE < op.marginal_error(codes, op.rake(codes, tokens, wanted, 5), wanted)
    impossible = [np.array([0.5, 0.3, 0.2]), np.array([0.6, 0.2, 0.2])]
    w = op.rake(codes, tokens, impossible)
    assert op.marginal_error(codes, w, impossible) > 0.05 and np.bincount(codes[:, 1], weights=w) == pytest.approx(impossible[1])


def test_unmet_targets_warn(spark):
    rows = [(i, "one two", "en" if i % 2 else "de", "a" if i % 2 else "b") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.2, "de": 0.8}, "topic": 1}
    for k in (99, 0):
        with pytest.warns(UserWarning, match="can't all be met"):
            op.cell_weights(docs, targets, driver_cells=k).collect()


def test_topics_from_a_column(spark):
    rows = [(i, "one two three", "en", "s", ("law", "art", None)[i % 3]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, subject string")
    out = op.mix(docs, topics="subject", targets={"source": 1, "lang": 1, "topic": {"law": 0.8, "art": 0.1}}, fraction=0.4)
    n = {r["subject"]: r["count"] for r in out.groupBy("subject").count().collect()}
    assert out.columns == docs.columns and 250 < n["law"] <= 300 and 20 < n["art"] < 60 and 20 < n[None] < 60


def test_sql_agrees_where_languages_are_null_or_unlisted(spark, tmp_path):
    import duckdb

    rows = [(i, "one two three nation\n" * (1 + i % 5), ("en", "de", "it", None)[i % 4], ("x", None, "y")[i % 3]) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in c.execute(f"select doc_id, source, lang, topic, tokens, weight, probability from ({op.oracle()})").fetchall()}
    got = {r[0]: tuple(r[1:]) for r in op.sample(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect()}
    assert got.keys() == want.keys() and all(got[k][:4] == want[k][:4] and got[k][4:] == pytest.approx(want[k][4:], abs=1e-5) for k in got)
