"""Sessions and their shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def create(name: str = "loomfield", **conf: str) -> SparkSession:
    """A session with adaptive execution and a state store that spills to disk."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder that spark.checkpoint.dir names.  Where none is set, a private one on one machine, and an error
    on a cluster, whose executors would each write to a disk of their own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="loomfield-"))
