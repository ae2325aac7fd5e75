"""Helpers the operators of this subpackage share: written intermediates and connected components."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType


def checkpoint_root(spark: SparkSession) -> str:
    """The folder every executor shares.  Where the session names none, a private one on one machine, and an
    error on a cluster, whose executors would each write to a disk of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loomfield-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


#: Rows of a batch between the JVM and Python; texts are long, and both sides hold some batches a task.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Has the session send batches of BATCH_ROWS at most, which bounds a task's memory beside the heap."""
    if int(spark.conf.get(_BATCH)) > BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


class Workspace:
    """Tables written to the shared checkpoint folder.

    Writing cuts lineage: a lost executor costs the re-read of a file, never a recomputed chain.
    ``drop`` deletes a table as soon as no later step reads it; the rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        small_batches(spark)
        self.path = f"{checkpoint_root(spark)}/loomfield-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.drop_all)

    def save(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.path}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._workspace_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._workspace_path)

    def free(self) -> None:
        """Has executors delete the shuffle files that no plan holds any more; else these stay until the
        driver's heap happens to be full."""
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)

    def drop_all(self) -> None:
        try:
            self._delete(self.path)
        except Exception:  # the JVM may be gone when the interpreter ends
            return

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that no column of df has."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def only(df: DataFrame, **casts: str) -> DataFrame:
    """Exactly the named columns, cast; columns that clash with an operator's own names go no further."""
    return df.select(*[df[c].cast(t).alias(c) for c, t in casts.items()])


#: Bytes of data up to which a side is broadcast; beyond, it is joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def _bytes(value: Column, kind: DataType) -> Column:
    """About what a value takes in memory."""
    if isinstance(kind, ArrayType):
        inner = kind.elementType
        flat = isinstance(inner, (StringType, BinaryType, ArrayType, StructType))
        total = F.aggregate(value, F.lit(0).cast("long"), lambda n, x: n + _bytes(x, inner)) if flat else 8 * F.size(value).cast("long")
    elif isinstance(kind, StructType):
        total = sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(8).cast("long"))
    elif isinstance(kind, (StringType, BinaryType)):
        total = F.octet_length(value).cast("long")
    else:
        return F.lit(8).cast("long")
    return F.coalesce(total, F.lit(0).cast("long")) + 8


def data_bytes(side: DataFrame) -> int:
    """About what a table takes in memory, by the types of its columns."""
    row = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in side.schema.fields), F.lit(16).cast("long"))
    return side.agg(F.sum(row)).first()[0] or 0


def small_or_shuffled(side: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """side (a written table) for a join: broadcast up to ``most`` bytes, else left to a shuffle."""
    return F.broadcast(side) if data_bytes(side) <= most else side


def components(edges: DataFrame, ws: Workspace, jumps: int = 2) -> DataFrame:
    """Connected components by repeated contraction.

    edges: two long columns a, b.  Returns (node, component) for every node of an edge; component is
    the smallest node reachable.  Each round maps a node to the smallest node next to it, follows that
    mapping ``jumps`` times by joins, and contracts the edges; the smallest node of a component always
    maps to itself, so it is the one that is left.  All steps are joins and partially aggregated
    minima, so that a hub costs no task more than others; each round is written to the shared folder.
    """
    e = ws.save(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct())
    total = None
    while not e.isEmpty():
        both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = ws.save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to")))
        near = step
        for _ in range(jumps):
            hop = near.select(F.col("node").alias("to"), F.col("to").alias("next"))
            near = near.join(hop, "to").select("node", F.col("next").alias("to"))
        near = ws.save(near)
        ws.drop(step)
        if total is None:
            total = near
        else:
            moved = near.select(F.col("node").alias("to"), F.col("to").alias("next"))
            total = ws.save(total.join(moved, "to", "left").select("node", F.coalesce("next", "to").alias("to")))
        left = near.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = near.select(F.col("node").alias("b"), F.col("to").alias("y"))
        old, e = e, ws.save(e.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        ws.drop(old)
    if total is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return total.select("node", F.col("to").alias("component"))
