"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    # A table that is exploded counts as no bigger than what it came from, and a join once planned as a broadcast stays one, as
    # undoing it takes another shuffle. So only sizes measured at run time, and ``F.broadcast``, make a broadcast.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
    # Sorted rows of repeated words take some ten times what they take when shuffled. So the parts that tasks get are kept small:
    # with Spark's 64 MB of compressed rows a task had more than its share of memory, and spilled.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8MB",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "600",
    "spark.sql.files.maxPartitionBytes": "32MB",
    # HotSpot never compiles a method above this size; Spark then splits the stage instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# Settings a running session can still be given.
RUNTIME = (
    "spark.sql.session.timeZone", "spark.sql.codegen.hugeMethodLimit", "spark.sql.autoBroadcastJoinThreshold",
    "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.files.maxPartitionBytes",
)


def build_session(app: str = "zonewatch", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect.

    ``conf`` keys use ``__`` in place of ``.``. The number of shuffle partitions is left to the
    caller: on a cluster it should be about twice the cores, with AQE merging small ones.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return ship(builder.getOrCreate())


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application, for the steps that run in Python."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        folder = tempfile.mkdtemp(prefix="zonewatch-code-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        package = Path(__file__).resolve().parent
        context.addPyFile(
            shutil.make_archive(f"{folder}/zonewatch", "zip", root_dir=package.parent, base_dir=package.name)
        )
        # The process that sets up streaming state does not see added files; it gets the code itself.
        cloudpickle.register_pickle_by_value(sys.modules[__package__])
        _SHIPPED.add(context.applicationId)
    return spark


def tuned(spark: SparkSession) -> SparkSession:
    """A session made elsewhere with the settings results and speed depend on.

    Every operator reads clock text and days as UTC.
    """
    for key in RUNTIME:
        if spark.conf.get(key, None) != DEFAULTS[key]:
            spark.conf.set(key, DEFAULTS[key])
    return ship(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``, else one below the warehouse.

    Both are settings of the cluster that every executor can reach; local mode takes the same way.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_zonewatch"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


_OPEN: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Tables staged inside are removed at the end; for work that is finished by then, as a stream's batch."""
    _OPEN.append([])
    try:
        yield
    finally:
        for folder in _OPEN.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a Parquet table below the shared checkpoint folder and read it back.

    The ordered operators read their input twice, once only its key and time columns; from a table
    that second read is narrow, and the work that made the rows is done once. ``options`` are the writer's;
    unless they say so, zstd is the codec, which takes less disk.
    """
    folder = f"{checkpoint_dir(df.sparkSession)}/stages/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(folder)
    with _shuffles_freed(df.sparkSession):
        df.write.options(**{"compression": "zstd"} | options).parquet(folder)
    table = df.sparkSession.read.schema(df.schema).parquet(folder)
    table.staged_in = folder
    return table


@contextmanager
def _shuffles_freed(spark: SparkSession):
    """What a job shuffled inside leaves the disk when it ends, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def filled_up(spark: SparkSession, folder: str, schema, count: int) -> list:
    """The Parquet files of ``folder``, with empty ones added up to ``count``: a stream takes so many files a batch, so a batch is never cut."""
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    fs = path(folder).getFileSystem(conf)

    def files(of: str) -> list:
        found = [f.getPath() for f in fs.listStatus(path(of))] if fs.exists(path(of)) else []
        return [p for p in found if p.getName().endswith(".parquet")]

    out = files(folder)
    if len(out) < count:
        blank = f"{checkpoint_dir(spark)}/stages/blank-{uuid.uuid4().hex}"
        spark.createDataFrame([], schema).write.parquet(blank)
        empty = files(blank)[0]
        for n in range(len(out), count):
            out.append(path(f"{folder}/empty-{n}.parquet"))
            spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, empty, fs, out[-1], False, conf)
        fs.delete(path(blank), True)
    return out


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that no later step reads."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.staged_in)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
