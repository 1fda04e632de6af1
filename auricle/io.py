"""Table loading and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: list[str] = []
_WRITTEN: list[str] = []


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data set as a lazy scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where that setting is absent, a session on one machine gets a temporary folder, which it keeps for later calls; on a
    cluster this is an error, as executors would write to their own disks.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("auricle.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="auricle-")
        _LOCAL_DIRS.append(path)
        spark.conf.set("auricle.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession) -> str:
    """A fresh place in the shared folder, which ``clean`` deletes."""
    path = f"{shared_dir(spark)}/auricle-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


@atexit.register
def _clean() -> None:
    for path in _LOCAL_DIRS:
        shutil.rmtree(path, ignore_errors=True)


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage, survives the loss of executors and is columnar,
    so later scans prune columns and push filters.
    """
    spark = df.sparkSession
    path = new_path(spark)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Delete the tables that ``materialize`` wrote; call it once the results that read them are stored."""
    conf, n = spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _WRITTEN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per session, as they may not have it installed."""
    if spark.conf.get("auricle.shipped", None) == spark.sparkContext.applicationId:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    home = tempfile.mkdtemp(prefix="auricle-package-")
    _LOCAL_DIRS.append(home)
    archive = os.path.join(home, "auricle.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for at, _, names in os.walk(os.path.join(root, "auricle")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(at, name)
                    out.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(archive)
    spark.conf.set("auricle.shipped", spark.sparkContext.applicationId)
