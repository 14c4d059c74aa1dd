"""Session helpers.

On a cluster the session is created by the platform; ``get_spark`` only adds the
settings the operators rely on when they are not already set.  The checkpoint folder
is always read from ``spark.checkpoint.dir`` (a shared folder named by the cluster);
a local scratch folder is created only when the setting is absent, as in tests.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # streaming state (ST1's keys) on the executors' disks, not in their memory
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "newsloom") -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    active = SparkSession.getActiveSession()
    for k, v in _DEFAULTS.items():
        if active is None or active.conf.get(k, None) is None:
            builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if active is None:      # only before the JVM starts, and only a local one is sized here
        builder = builder.config("spark.driver.memory", os.environ.get("NEWSLOOM_DRIVER_MEM", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting a scratch one only when unset."""
    conf = spark.sparkContext.getConf()
    path = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not path:
        master = conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="newsloom-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Truncate lineage with a written table in the shared checkpoint folder.

    The result is reliable (it survives executor loss: it lives in ``spark.checkpoint.dir``, not in
    executor memory or local disk) and, unlike ``checkpoint()``'s serialized rows, it is a Parquet
    table: columnar, compressed, read with column pruning and filter push-down.
    """
    import uuid
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    scope = _SCOPE.get()
    if scope is not None:
        scope.append(path)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


_SCOPE: ContextVar[list[str] | None] = ContextVar("tables of the innermost table_scope", default=None)


@contextmanager
def table_scope() -> Iterator[list[str]]:
    """The paths of the tables that ``cut_lineage`` writes inside the block (an inner block keeps its own)."""
    paths: list[str] = []
    token = _SCOPE.set(paths)
    try:
        yield paths
    finally:
        _SCOPE.reset(token)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of ``cut_lineage`` that nothing reads any more, and lets Spark's cleaner drop the shuffle files
    of plans that are gone."""
    import gc
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    gc.collect()
    jvm.System.gc()


def qualified(spark: SparkSession, path: str) -> str:
    """The folder's full URI: a bare path lies on Hadoop's default file system, as for Spark's own readers and writers."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + uri[len("file:"):] if uri.startswith("file:/") and not uri.startswith("file://") else uri


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``newsloom`` importable in Python workers (``addPyFile`` of a zip of the package), once
    per SparkContext.  Needed by the Arrow/Pandas stages, whose functions refer to package helpers."""
    import shutil
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="newsloom-pyfiles-")
    archive = shutil.make_archive(os.path.join(out_dir, "newsloom"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir="newsloom")
    sc.addPyFile(archive)
    _SHIPPED.add(key)
