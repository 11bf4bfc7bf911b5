"""Tables a session writes for itself: where they go, and their removal when the interpreter ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as ``spark.checkpoint.dir`` names it.

    Only where the setting is absent in local mode (tests, notebooks) a temporary folder is made and set; on
    a cluster a folder of the driver's own would be lost to the executors, so there the setting must be.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
        found = "file://" + tempfile.mkdtemp(prefix="quillstack-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A name under the shared folder that nothing has yet."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def stamp(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files at ``path``, which differ once these are written anew."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found))


def remove_folder(path: str) -> None:
    """Removes a folder that ``new_folder`` named, however its path is written."""
    for i, (spark, known) in enumerate(_WRITTEN):
        if path.rsplit("/", 1)[-1] == known.rsplit("/", 1)[-1]:
            _delete(spark, known)
            del _WRITTEN[i]
            return


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


@atexit.register
def clear_scratch() -> None:
    """Remove every folder named so far. Safe to call once results have been written."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session is gone, and nothing reads the folder any more
            return
