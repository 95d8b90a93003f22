"""Session settings, table loading and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators are written for.  Every one is a plain Spark setting, so a
# cluster may override them; AQE sizes and splits the shuffle partitions at run time.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # streaming state outside the heap of the executors
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # the changes of every batch, from which updates are handed out
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "tabledoc", **extra: str) -> SparkSession:
    """Create a session with the package settings; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table as a parquet scan (columns and filters are pushed into it)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_spread(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """As ``load_table``, dealt out by its key where the session asks for it.

    The setting ``tabledoc.scan.partitions`` is for tables that lie in fewer row groups than there are
    cores, as the benchmark's do.  Without it, the plan is the plain scan at every size.
    """
    df = load_table(spark, sf_dir, name)
    partitions = spark.conf.get("tabledoc.scan.partitions", None)
    return df.repartition(int(partitions), key) if partitions else df


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where the session names none (tests, a laptop) a folder of this machine is
    chosen and set, so that a cluster never writes to a machine-local path.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if root:
        return root
    known = spark.sparkContext.getCheckpointDir()
    if known:
        # Spark appends one folder of its own to the path it was given.
        return known.rsplit("/", 1)[0]
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    root = tempfile.mkdtemp(prefix="tabledoc-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new, not yet existing folder for one write under the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Used where a result is consumed more than once: the files outlive a lost executor
    and end the lineage, and the readers still prune columns and push filters.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
