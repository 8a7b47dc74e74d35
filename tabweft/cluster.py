"""What every operator needs from the cluster: shared folders, shipped code, lineage cuts."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Folder used when the session names none, as in tests on one machine.
LOCAL_SHARED_DIR = "file:///tmp/checkpoints/tabweft"

_shipped: set[str] = set()
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or that of ``setCheckpointDir``.

    Where neither is set, a session on one machine gets an own folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            named = known.get()
        elif re.fullmatch(r"local(\[.*\])?", sc.master):
            named = LOCAL_SHARED_DIR
            sc.setCheckpointDir(named)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; nothing is created yet."""
    path = f"{shared_dir(spark)}/tabweft-{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def made() -> list[str]:
    """The folders that this process made in the shared folder and has not deleted."""
    return list(_made)


def clear(spark: SparkSession, folders: list[str] | None = None) -> None:
    """Delete these folders (all) that this process made in the shared folder; frames that read them are then void."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in made() if folders is None else folders:
        if path in _made:
            _made.remove(path)
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def release(*written: DataFrame) -> None:
    """Delete the files of frames that :func:`materialize` gave and that nothing reads any more, and have Spark drop the shuffle files of jobs that are over.

    Shuffle files stay until the driver's garbage is collected, which a driver with memory to spare does late.
    """
    for df in written:
        spark = df.sparkSession
        files = df.inputFiles()
        clear(spark, [path for path in made() if any(f"/{path.rsplit('/', 1)[1]}/" in f for f in files)])
        spark._jvm.System.gc()


@atexit.register
def _clear_local() -> None:
    """The own default folder is on this machine: leave nothing behind there."""
    for path in _made:
        if path.startswith(LOCAL_SHARED_DIR):
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, so that functions pickled by reference resolve there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    top = os.path.dirname(root)
    out = os.path.join(tempfile.mkdtemp(prefix="tabweft-ship-"), "tabweft_code.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, top))
    spark.sparkContext.addPyFile(out)
    _shipped.add(app)


def materialize(df: DataFrame, label: str, codec: str = "zstd", partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back; ``partition_by``: a column with a folder for each value.

    Cuts the lineage in a way that survives the loss of an executor and lets later scans prune columns.
    """
    path = new_folder(df.sparkSession, label)
    writer = df.write.option("compression", codec)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
