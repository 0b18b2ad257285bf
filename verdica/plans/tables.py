"""The evaluation's views of the given tables, for Spark and, word for word alike, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compare import positions


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Select lists and tables: SQL that both engines read alike.
SQL = {
    "eval_rows": "select d.doc_id as index, lang as subject, cast(d.doc_id % 5 + 1 as string) as difficulty, quality = 1 as ok, cast(n_chars % 1001 as int) as milli from labels l join documents d on l.doc_id = d.doc_id",
    "big_rows": "select concat(l_returnflag, l_linestatus) as subject, l_linenumber as difficulty, l_discount > 0.05 as ok, cast((l_orderkey * 7 + l_linenumber * 13) % 1001 as int) as milli from lineitem",
    "run_rows": "select backend, ord, o_orderkey as index, ok from (select 'a' as backend, 0 as ord, o_orderkey, o_orderstatus = 'F' as ok from orders union all "
    "select 'b', 1, o_orderkey, o_totalprice > 250000 from orders union all "
    "select 'c', 2, o_orderkey, o_orderpriority in ('1-URGENT', '2-HIGH') from orders where o_orderkey % 50 <> 7) x",
    "runs": "select *, row_number() over (partition by backend order by index) - 1 as pos from (ROWS) y",
    "samples": "select conv_id as index, cast(row_number() over (partition by conv_id order by turn) - 1 as int) as sample_index, cast(length(text) % 3 as string) as predicted, "
    "cast(conv_id % 3 as string) as gold, length(text) % 3 = conv_id % 3 as ok, case when length(text) % 7 = 0 then null else cast(length(text) % 1001 as int) end as milli, "
    "length(text) % 11 <> 0 as matched, case when length(text) % 13 = 0 then null else cast(length(text) as int) end as tokens from conversations where role = 'assistant'",
}
SQL["runs"] = SQL["runs"].replace("ROWS", SQL["run_rows"])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views, from the tables it names; positions of runs are numbered in ranges."""
    if name == "runs":
        return positions(view(spark, sf_dir, "run_rows"), "index")
    text = SQL[name]
    for table in ("documents", "labels", "lineitem", "orders", "conversations"):
        if f" {table}" in text:
            text = text.replace(f" {table}", f" {{{table}}}")
    return spark.sql(text, **{t: read(spark, sf_dir, t) for t in ("documents", "labels", "lineitem", "orders", "conversations") if f"{{{t}}}" in text})


def with_view(name: str, query: str) -> str:
    """DuckDB: the query with the view in front; ``index`` and ``string`` are spelled its way."""
    return f"with {name} as ({SQL[name]}) {query}"


def _slash():
    return F.lit("\\")


def answer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of formatted numbers of which it is known whether they are equal: a/b against c/d.

    a = p_size, b = p_partkey % 12 + 1; every other part has c/d = 2a/2b, others (a+1)/b, written
    as a LaTeX fraction, a quotient, with a unit or boxed.
    """
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("bigint").alias("a"), (F.col("p_partkey") % 12 + 1).alias("b"))
    even = F.col("p_partkey") % 2 == 0
    p = p.withColumns({"c": F.when(even, F.col("a") * 2).otherwise(F.col("a") + 1), "d": F.when(even, F.col("b") * 2).otherwise(F.col("b"))})
    frac = lambda x, y, name: F.concat(_slash(), F.lit(name + "{"), F.col(x).cast("string"), F.lit("}{"), F.col(y).cast("string"), F.lit("}"))
    quotient = F.concat(F.col("c").cast("string"), F.lit("/"), F.col("d").cast("string"))
    k = F.col("p_partkey") % 4
    right = F.when(k == 0, quotient).when(k == 1, frac("c", "d", "dfrac")).when(k == 2, F.concat(quotient, _slash(), F.lit("text{ cm}"))).otherwise(F.concat(_slash(), F.lit("boxed{"), frac("c", "d", "frac"), F.lit("}")))
    return p.select("p_partkey", "a", "b", "c", "d", frac("a", "b", "frac").alias("expected"), right.alias("predicted"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts with a worked tail: (index, problem, answer, text), the answer item_id * 3 or wrong."""
    b = read(spark, sf_dir, "benchmark")
    n = F.col("item_id") * 3
    said = F.when(F.col("item_id") % 4 == 0, n + 1).otherwise(n).cast("string")
    head = F.lit("We read the question once more.\nThen it follows:\n")
    display = F.concat(_slash(), F.lit("[\nx = "), said, F.lit("\n"), _slash(), F.lit("]\n"))
    tail = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("So "), _slash(), F.lit("boxed{"), said, F.lit("}"))).when(F.col("item_id") % 3 == 1, F.concat(F.lit("The final answer is "), said, F.lit("."))).otherwise(F.lit("No more to say here."))
    return b.select(F.col("item_id").cast("int").alias("index"), F.col("text").alias("problem"), n.cast("string").alias("answer"), F.concat(head, display, tail).alias("text"))
