"""Session helpers: where intermediate tables live and how lineage is cut."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_scratch: dict[str, str] = {}
_run_dirs: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` decides. Only a ``local`` session may fall back to a
    temporary folder of its own; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local_scratch:
        _local_scratch[sc.applicationId] = tempfile.mkdtemp(prefix="photonest-")
    return "file://" + _local_scratch[sc.applicationId]


def _file_system(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def run_dir(spark: SparkSession) -> str:
    """The application's own folder within the shared one; it goes when the application ends, or by ``release``."""
    path = f"{scratch_dir(spark)}/photonest-{spark.sparkContext.applicationId}"
    if _run_dirs.get(spark.sparkContext.applicationId) != path:
        where, files = _file_system(spark, path)
        files.mkdirs(where)
        files.deleteOnExit(where)
        if spark.sparkContext.applicationId in _local_scratch:
            own, files = _file_system(spark, scratch_dir(spark))
            files.deleteOnExit(own)
        _run_dirs[spark.sparkContext.applicationId] = path
    return path


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; what still reads them cannot be computed any more."""
    path = _run_dirs.pop(spark.sparkContext.applicationId, None)
    if path:
        where, files = _file_system(spark, path)
        files.delete(where, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's folder."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder of the application's own that the driver and executors can open as plain files."""
    path = new_path(spark, name)
    plain = re.sub("^file:(//)?(?=/)", "", path)
    if re.match("[A-Za-z][A-Za-z0-9+.-]*:", plain):
        raise ValueError(f"plain files cannot be kept at {path}; name a folder that all executors share")
    os.makedirs(plain, exist_ok=True)
    return plain


def materialize(df: DataFrame, name: str = "table", thin: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage, survives lost executors and gives the optimizer real sizes. ``thin``: the rows are
    few or short against the work that makes them, so they are rebalanced into files of a fair size
    behind that work, which keeps all its tasks.
    """
    path = new_path(df.sparkSession, name)
    if thin:
        df = df.hint("rebalance")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_lines(lines: DataFrame, path: str) -> int:
    """Append the lines of ``lines`` (one text column), in order, to the driver's file ``path``; returns the bytes.

    Executors write them side by side to the shared folder; the driver then copies bytes and never holds a row.
    """
    spark = lines.sparkSession
    jvm, where = spark.sparkContext._jvm, new_path(spark, "lines")
    lines.write.option("compression", "none").option("lineSep", "\n").text(where)
    folder, files = _file_system(spark, where)
    parts = [x.getPath() for x in files.listStatus(folder) if x.getPath().getName().startswith("part-")]
    before = os.path.getsize(path)
    out = jvm.java.io.FileOutputStream(os.path.abspath(path), True)
    try:
        for part in sorted(parts, key=lambda x: (int(x.getName().split("-")[1]), x.getName())):
            content = files.open(part)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(content, out, 1 << 20, False)
            finally:
                content.close()
    finally:
        out.close()
    files.delete(folder, True)
    return os.path.getsize(path) - before


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
