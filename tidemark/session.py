"""Session settings and the shared folder that staged tables are written to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_CHECKPOINT_SETTING = "spark.checkpoint.dir"
_local_folder: tempfile.TemporaryDirectory | None = None


def build_session(app_name: str, master: str | None = None, **settings: str) -> SparkSession:
    """Session with adaptive execution and UTC; ``settings`` override anything here."""
    options = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **settings,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in options.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only a local session without the setting gets a folder of its own; on a
    cluster a machine-local folder would lose data, so that is an error.
    """
    global _local_folder
    root = spark.conf.get(_CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_CHECKPOINT_SETTING} to a folder all executors share")
        if _local_folder is None:
            _local_folder = tempfile.TemporaryDirectory(prefix="tidemark-")
        root = _local_folder.name
    return f"{root.rstrip('/')}/tidemark/{spark.sparkContext.applicationId}"


def staging_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing was written to before."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _hadoop_path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _hidden(name: str) -> bool:
    return name.startswith(("_", "."))


def holds_parquet(spark: SparkSession, path: str) -> bool:
    """Whether a finished write left parquet under ``path``; stops at the first file.

    A folder needs its ``_SUCCESS`` mark, and files below hidden names, such as
    those of a write that was killed, don't count. A parquet file counts itself.
    """
    target, fs = _hadoop_path(spark, path)
    if not fs.exists(target):
        return False
    if fs.getFileStatus(target).isFile():
        return target.getName().endswith(".parquet")
    if not fs.exists(_hadoop_path(spark, f"{path.rstrip('/')}/_SUCCESS")[0]):
        return False
    folders = [target]
    while folders:
        for entry in fs.listStatus(folders.pop()):
            name = entry.getPath().getName()
            if _hidden(name):
                continue
            if entry.isDirectory():
                folders.append(entry.getPath())
            elif name.endswith(".parquet"):
                return True
    return False


def path_exists(spark: SparkSession, path: str) -> bool:
    target, fs = _hadoop_path(spark, path)
    return bool(fs.exists(target))


def is_file(spark: SparkSession, path: str) -> bool:
    target, fs = _hadoop_path(spark, path)
    return bool(fs.exists(target) and fs.getFileStatus(target).isFile())


def folder_names(spark: SparkSession, root: str, prefix: str, finished: bool = True) -> list[str]:
    """Names of the folders right below ``root`` that begin with ``prefix``; those of finished writes only, or all."""
    target, fs = _hadoop_path(spark, root)
    if not fs.exists(target):
        return []
    names = [entry.getPath().getName() for entry in fs.listStatus(target)]
    return [n for n in names if n.startswith(prefix) and (not finished or path_exists(spark, f"{root}/{n}/_SUCCESS"))]


def finished_versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the folders ``version=N`` below ``root`` whose write finished, ascending."""
    return sorted(int(name.removeprefix("version=")) for name in folder_names(spark, root, "version="))


def folder_bytes(spark: SparkSession, path: str) -> int:
    target, fs = _hadoop_path(spark, path)
    return int(fs.getContentSummary(target).getLength()) if fs.exists(target) else 0


def remove_path(spark: SparkSession, path: str) -> None:
    target, fs = _hadoop_path(spark, path)
    fs.delete(target, True)


def discard_staged(spark: SparkSession) -> None:
    """Delete what this application staged; call it once the results are written."""
    target, fs = _hadoop_path(spark, shared_folder(spark))
    fs.delete(target, True)
