"""Session construction and shared scratch locations.

Library code never creates a machine-local temporary folder on a cluster:
every scratch path (stream checkpoints, message files, snapshot versions)
lives under the shared folder named by ``spark.checkpoint.dir``. Only a
``local[...]`` session without that setting (tests, the bench) gets a fresh
folder under ``/tmp``, which is then registered as the checkpoint dir.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    master: str | None = None,
    app_name: str = "orderpulse",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with AQE, UTC and the UI off."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and scratch tables.

    Reads ``spark.checkpoint.dir`` (or the context's checkpoint dir). When
    neither is set, a local session gets a fresh ``/tmp`` folder; any other
    master is refused, because a driver-local folder is invisible to
    executors on other machines.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        try:
            root = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key raises on some versions
            root = None
    if not root:
        root = sc.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; set it to a shared folder "
            "(HDFS/S3/ABFS) before running jobs that write scratch tables"
        )
    root = tempfile.mkdtemp(prefix="orderpulse-ckpt-")
    sc.setCheckpointDir(root)
    # setCheckpointDir adds a uuid subfolder; use what Spark reports
    return (sc.getCheckpointDir() or root).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the checkpoint root."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme so Python can inspect a local path."""
    if path.startswith("file:"):
        path = path[len("file:"):]
        while path.startswith("//"):
            path = path[1:]
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when ``path`` exists on the file system that Spark resolves it on
    (a bare path belongs to ``fs.defaultFS``, not to the driver's disk)."""
    fs, hpath = _fs_path(spark, path)
    return bool(fs.exists(hpath))


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def list_dirs(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(name, full path) of the sub-folders of ``path`` (file-system metadata
    only; one listing call on the driver)."""
    fs, hpath = _fs_path(spark, path)
    if not fs.exists(hpath):
        return []
    return [(st.getPath().getName(), st.getPath().toString())
            for st in fs.listStatus(hpath) if st.isDirectory()]


def delete_path(spark: SparkSession, path: str) -> bool:
    """Recursively delete ``path`` on its file system."""
    fs, hpath = _fs_path(spark, path)
    return bool(fs.delete(hpath, True))


def list_files(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(name, full path) of the plain files directly under ``path``."""
    fs, hpath = _fs_path(spark, path)
    if not fs.exists(hpath):
        return []
    return [(st.getPath().getName(), st.getPath().toString())
            for st in fs.listStatus(hpath) if st.isFile()]


def create_file(spark: SparkSession, path: str, text: str) -> bool:
    """Create ``path`` with ``text`` if it does not exist; False if it does.
    It appears whole, and of several writers exactly one succeeds: by a hard
    link on a local or mounted file system, elsewhere by a rename, which HDFS
    refuses when the target exists. (Object stores without such a rename need
    a lock service; none is built in.)"""
    fs, hpath = _fs_path(spark, path)
    temp = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}.tmp"
    fs.mkdirs(hpath.getParent())
    if fs.getUri().getScheme() == "file":
        target, source = local_path(hpath.toUri().getPath()), local_path(_fs_path(spark, temp)[1].toUri().getPath())
        with open(source, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(source, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(source)
        return True
    htemp = _fs_path(spark, temp)[1]
    out = fs.create(htemp, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.exists(hpath) and fs.rename(htemp, hpath):
        return True
    fs.delete(htemp, False)
    return False


def read_file(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None if it does not exist (any more)."""
    fs, hpath = _fs_path(spark, path)
    if not fs.exists(hpath):
        return None
    source = fs.open(hpath)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def file_sizes(spark: SparkSession, path: str, suffix: str = ".parquet") -> list[int]:
    """Sizes of the files directly under ``path`` (metadata only)."""
    fs, hpath = _fs_path(spark, path)
    if not fs.exists(hpath):
        return []
    return [st.getLen() for st in fs.listStatus(hpath) if st.isFile() and st.getPath().getName().endswith(suffix)]
