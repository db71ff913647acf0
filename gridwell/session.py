"""Sessions, table access and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
BATCH_BYTES = 8 << 20
#: Of a chain of queries, whose executors hold what earlier ones left.
CHAIN_BATCH_BYTES = 2 << 20
_LOCAL_SHARED: list[str] = []
#: Applications that have the package as an archive.
_SHIPPED: set[str] = set()


def build_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    ship()
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gridwell")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession | None = None, batch_bytes: int = BATCH_BYTES) -> None:
    """Let Python workers import this package, and get rows in Arrow batches of
    ``batch_bytes`` at most, or of one row.

    Workers on this machine find the package where the driver has it; those of a cluster
    get it as an archive.
    """
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    if spark is not None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch_bytes)
        env = spark.sparkContext.environment
        own = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if ROOT not in own:
            env["PYTHONPATH"] = os.pathsep.join([ROOT, *own])
        context = spark.sparkContext
        if not context.master.startswith("local") and context.applicationId not in _SHIPPED:
            # Spark sends the file to each executor; the driver alone reads this folder
            base = os.path.join(tempfile.mkdtemp(prefix="gridwell-"), "gridwell")
            context.addPyFile(shutil.make_archive(base, "zip", ROOT, "gridwell"))
            _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A parquet table of ``sf_dir``, with only ``columns`` if any are named."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir``. Where that is unset, a temporary folder of this
    machine stands in for it in a local session; on a cluster that is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _LOCAL_SHARED:
        _LOCAL_SHARED.append(tempfile.mkdtemp(prefix="gridwell-"))
    return "file://" + _LOCAL_SHARED[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` as a table written to the shared folder and read again.

    Later stages then depend on files that outlive an executor, not on lineage
    or on blocks that an executor holds. The frame knows where its table is
    (``table_path``), for :func:`drop_written`; frames made from it don't.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression)
    made = _made.get()
    if made is not None:
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def drop_written(*tables: DataFrame) -> None:
    """Delete tables, each a frame that :func:`written` returned; nothing may read them again."""
    for df in tables:
        _delete(df.sparkSession, [df.table_path])


#: What :func:`passing` of the present thread has seen written.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def passing(make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, as a written table; all others that it wrote are deleted."""
    outer = _made.get()
    token = _made.set([])
    try:
        df = make()
        if getattr(df, "table_path", None) is None:
            df = written(df, "kept")
        made = _made.get()
    finally:
        _made.reset(token)
    _delete(df.sparkSession, [p for p in made if p != df.table_path])
    if outer is not None:
        outer.append(df.table_path)
    return df
