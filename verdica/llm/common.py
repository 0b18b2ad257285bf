"""What the operators share: scratch tables in the cluster's shared folder, joins by a checked size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Estimated bytes up to which a side is broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20
#: Rows of text that a Python worker is handed at a time.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where the session names none, a temporary one is made and set in local mode only (tests, a
    laptop).  On a cluster each machine would have its own, so that is an error.
    """
    have = spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        have = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not have:
        made = spark.sparkContext.getCheckpointDir()
        if not made and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        have = made if made else "file://" + tempfile.mkdtemp(prefix="verdica-")
        spark.conf.set("spark.checkpoint.dir", have)
    return have.rstrip("/")


class Scratch:
    """Intermediate tables, written once as Parquet in the shared folder and read back.

    Writing cuts the lineage, survives the loss of executors, and computes each
    intermediate once however often the plan uses it.  A lazy result may read some of
    them, so these last until the session ends; then the folder is deleted.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/verdica/{name}-{uuid.uuid4().hex}"
        self._files().deleteOnExit(self._path())

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes and rereads.  Python gets small batches meanwhile: texts are long, and memory is shared."""
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(_BATCH)
        self.spark.conf.set(_BATCH, str(min(int(before), BATCH_ROWS)))
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_BATCH, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes tables that nothing lazy refers to any longer."""
        for name in names:
            self._files().delete(self._path(name), True)


def estimated_bytes(df: DataFrame) -> int:
    """What a table takes in memory: 16 bytes a row, 8 a field, and the bytes of texts and binaries."""
    texts = [f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "binary", "varchar", "char")]
    size = sum((F.coalesce(F.octet_length(df[c]).cast("bigint"), F.lit(0)) for c in texts), F.lit(16 + 8 * len(df.columns)).cast("bigint"))
    return df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


def sized(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it is estimated at most ``limit`` bytes, else as it is (a shuffled join)."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns, so that no other column of the table can clash with an operator's own."""
    return df.select(*[df[c] for c in columns])


def kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, label): each vertex of the edges (a, b) with the least id of its connected component.

    Minimum labels spread along the edges, with a pointer jump in each round, so that the
    rounds grow with the logarithm of a component's diameter.  Every round is written down.
    Ids are of any type that can be ordered.
    """
    both = scratch.table(
        edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        f"{name}-edges",
    )
    labels = scratch.table(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumn("moved", F.lit(True)), f"{name}-0")
    step = 0
    while not labels.where("moved").isEmpty():
        step += 1
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        own = labels.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("above"))
        moved = own.join(up, "label", "left").select("id", "was", F.least("label", F.coalesce("above", "label")).alias("label"))
        labels = scratch.table(moved.select("id", "label", (F.col("label") != F.col("was")).alias("moved")), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
    return labels.drop("moved")
