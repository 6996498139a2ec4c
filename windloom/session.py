"""Session helpers: the local test session, table access and the shared checkpoint folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("windloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_source(spark: SparkSession, path: str) -> tuple[str, str]:
    """Folder and pattern of names for a stream over a table that is a file or a folder of files."""
    of = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder, name = path.rsplit("/", 1)
    return (path, "*") if of.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(of).isDirectory() else (folder, name)


def _shared(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return shared or tempfile.mkdtemp(prefix="windloom-checkpoint-")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors share, under the cluster's ``spark.checkpoint.dir``."""
    return f"{_shared(spark).rstrip('/')}/windloom-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint.

    The folder is the cluster's ``spark.checkpoint.dir``. Only on a local master without that
    setting (tests, a laptop) is a local folder used instead; elsewhere its absence is an error,
    for executors would write to disks that no other executor sees.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(_shared(df.sparkSession))
    return df.checkpoint(eager=True)


#: Largest side that is broadcast on purpose, in bytes of its values.
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast when its values take at most ``most`` bytes; a shuffled join serves beyond.

    Values are measured by one distributed aggregate, strings by their length and others as eight
    bytes, with 16 bytes a row on top. Pass a checkpointed frame, or the measuring runs its plan.
    """
    size = F.lit(16)
    for name, kind in df.dtypes:
        size = size + (F.coalesce(F.octet_length(name), F.lit(0)) if kind == "string" else F.lit(8))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= most else df


#: A table of at most so many bytes (one default split) may be spread, in parts of at least so many.
SPREAD_BYTES, SPREAD_PART = 128 << 20, 64 << 10


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table that is smaller than one split, and has fewer files than cores, over the cores.

    For work that is heavy for each row. The size is the optimizer's estimate; nothing is run to get
    it, and a table beyond ``SPREAD_BYTES`` is never shuffled by this, whatever the number of cores.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    cores = df.sparkSession.sparkContext.defaultParallelism
    if size > SPREAD_BYTES or len(df.inputFiles()) >= cores:
        return df
    parts = min(cores, -(-size // SPREAD_PART))
    return df.repartition(parts) if parts > 1 else df


def ship(spark: SparkSession) -> None:
    """Give the package to the executors' Python workers, once for each Spark context."""
    context = spark.sparkContext
    if not getattr(context, "_windloom_shipped", False):
        package = Path(__file__).parent
        base = str(Path(tempfile.mkdtemp(prefix="windloom-code-")) / "windloom")
        context.addPyFile(shutil.make_archive(base, "zip", package.parent, package.name))
        context._windloom_shipped = True
