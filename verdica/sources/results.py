"""Stored results: tables of our own, JSON documents and checkpoint logs of older runs; and their sinks."""

from __future__ import annotations

import json
import os
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """The rows of result documents: null rows dropped, missing fields null, a missing index the place in the file."""
    document = T.StructType([T.StructField("results", T.ArrayType(T.StructType.fromDDL(schemas.RESULT)))])
    whole = spark.read.schema(document).option("multiLine", True).json(path)
    rows = whole.select(F.posexplode("results").alias("pos", "r"), F.col("_metadata.file_name").alias("file")).where("r is not null")
    names = [f.name for f in rows.schema["r"].dataType.fields if f.name != "index"]
    backend = F.nullif(F.regexp_extract("file", r"results_([A-Za-z0-9]+)\.json$", 1), F.lit(""))
    return rows.select("pos", F.coalesce("r.index", "pos").alias("index"), *[f"r.{n}" for n in names], backend.alias("backend"))


def read_own(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The rows of a document that ``write_json`` made; their fields are those of ``schema`` or the usual ones."""
    fields = schema or T.StructType.fromDDL(schemas.OWN)
    document = T.StructType([T.StructField("results", T.ArrayType(fields))])
    whole = spark.read.schema(document).option("multiLine", True).json(path)
    return whole.select(F.explode("results").alias("r")).where("r is not null").select("r.*")


def is_own(path: str) -> bool:
    """Written by this library (its rows have ``ok``)?"""
    with open(path) as f:
        return '"ok"' in f.read(1 << 20)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Result rows of either kind of document, by the names of this library."""
    if is_own(path):
        return read_own(spark, path)
    older = {"answer_accuracy": "ok", "parse_matched": "matched", "eval_tokens": "tokens", "step_prm_scores": "step_scores"}
    return read_json(spark, path).withColumnsRenamed(older).withColumn("milli", F.round(F.col("prm_score") * 1000).cast("bigint"))


def read_summary(path: str) -> dict:
    """What a document says beside its rows."""
    with open(path) as f:
        return {k: v for k, v in json.load(f).items() if k not in ("results", "divergences")}


def read_comparison(path: str) -> dict | None:
    """A stored comparison with its divergences, None where there is none."""
    if not os.path.exists(path):
        return None
    with open(path) as f:
        return json.load(f)


def checkpoint_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line) of a text log; positions grow along the file."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"))
    return text.select(F.struct("_at", "_id").alias("pos"), F.col("value").alias("line"))


def checkpoint_rows(lines: DataFrame, fingerprint: str, schema: str = schemas.RESULT) -> DataFrame:
    """The last row of each index from the lines before the first bad one; none if the header has another fingerprint.

    A line without an index counts as bad.
    """
    some = lines.where(~F.regexp_like(F.coalesce("line", F.lit("")), F.lit(r"^\s*$")))
    header = some.agg(F.min_by("line", "pos").alias("h"), F.min("pos").alias("first"))
    fits = header.where(F.try_variant_get(F.try_parse_json("h"), "$.fingerprint", "string") == fingerprint).select("first")
    value = F.try_parse_json("line")
    marked = some.crossJoin(F.broadcast(fits)).where(F.col("pos") > F.col("first")).withColumn("_index", F.try_variant_get(value, "$.index", "int"))
    bad = marked.where("_index is null").agg(F.min("pos").alias("bad"))
    good = marked.crossJoin(F.broadcast(bad)).where(F.col("bad").isNull() | (F.col("pos") < F.col("bad")))
    last = good.groupBy("_index").agg(F.max_by("line", "pos").alias("line"))
    return last.select(F.from_json("line", schema).alias("r")).select("r.*")


class Log:
    """Rows of runs, appended chunk by chunk under their configuration's fingerprint.

    Each chunk is committed as whole files, so a crash leaves no half row; a row that is
    written again replaces the earlier one on reading.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, fingerprint: str) -> str:
        return f"{self.root}/fingerprint={fingerprint}"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def append(self, rows: DataFrame, fingerprint: str, chunk: int) -> None:
        rows.withColumn("_chunk", F.lit(chunk)).write.mode("append").parquet(self._path(fingerprint))

    def exists(self, fingerprint: str) -> bool:
        fs, p = self._fs(self._path(fingerprint))
        return fs.exists(p)

    def next_chunk(self, fingerprint: str) -> int:
        if not self.exists(fingerprint):
            return 0
        return (self.spark.read.parquet(self._path(fingerprint)).agg(F.max("_chunk")).first()[0] or 0) + 1

    def rows(self, fingerprint: str) -> DataFrame | None:
        if not self.exists(fingerprint):
            return None
        df = self.spark.read.parquet(self._path(fingerprint))
        w = Window.partitionBy("index").orderBy(F.desc("_chunk"))
        return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_chunk")

    def clear(self, fingerprint: str) -> None:
        fs, p = self._fs(self._path(fingerprint))
        fs.delete(p, True)


def write_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def write_json(summary: dict, rows: DataFrame, path: str, key: str = "results") -> None:
    """One document with all rows, for readers of that format; the rows pass one by one.

    A table of any size goes to ``write_table``; this is for what a reader of one file can hold.
    """
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    draft = target.with_name(target.name + ".part")
    with draft.open("w") as f:
        head = json.dumps(summary, indent=2, default=str)
        f.write(head[:-2].rstrip() + (",\n" if summary else "\n") + f'  "{key}": [')
        for n, row in enumerate(rows.select(F.to_json(F.struct("*"))).toLocalIterator()):
            f.write((",\n    " if n else "\n    ") + row[0])
        f.write("\n  ]\n}\n")
    os.replace(draft, target)


def rewrite(path: str, write) -> None:
    """Overwrites a file and keeps the former one beside it as .bak."""
    shutil.copyfile(path, f"{path}.bak")
    write(path)


def archive(log_dir: str, stamp: str, *paths: str) -> list[str]:
    """Moves the files that exist into the folder under a common stamp; never over another."""
    moved = []
    for path in (Path(p) for p in paths if p and os.path.exists(p)):
        Path(log_dir).mkdir(parents=True, exist_ok=True)
        names = (f"{path.stem}_{stamp}{'' if n == 1 else f'_{n}'}{path.suffix}" for n in range(1, 1000))
        target = next(t for t in (Path(log_dir) / name for name in names) if not t.exists())
        shutil.move(path, target)
        moved.append(str(target))
    return moved
