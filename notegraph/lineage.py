"""Cutting lineage with tables written to the shared checkpoint folder.

Iterative operators write each round to `<spark.checkpoint.dir>/notegraph-scratch/...`
and read it back.  The folder is shared by all executors, so a lost executor costs
a re-read and never a recomputation of earlier rounds.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only in local mode where it is unset."""
    global _LOCAL
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _LOCAL is None:
        _LOCAL = tempfile.mkdtemp(prefix="notegraph-")
        atexit.register(shutil.rmtree, _LOCAL, ignore_errors=True)
    return "file://" + _LOCAL


def _file(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _file(spark, path)
    return fs.exists(jpath)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file in any file system that Spark reaches."""
    fs, jpath = _file(spark, path)
    out = fs.create(jpath, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, jpath = _file(spark, path)
    stream = fs.open(jpath)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def glob(spark: SparkSession, pattern: str) -> list[str]:
    fs, jpath = _file(spark, pattern)
    return sorted(s.getPath().toString() for s in (fs.globStatus(jpath) or []))


_ROOTS: dict[str, tuple[SparkSession, str]] = {}


def clean_up(spark: SparkSession) -> None:
    """Deletes all tables that operators of this session have written; what they returned can no longer be read."""
    app = spark.sparkContext.applicationId
    for root, (_, of) in list(_ROOTS.items()):
        if of == app:
            fs, jpath = _file(spark, root)
            fs.delete(jpath, True)
            del _ROOTS[root]


@atexit.register
def _at_exit() -> None:
    for spark, app in {a: (s, a) for s, a in _ROOTS.values()}.values():
        try:
            if spark.sparkContext.applicationId == app and not spark.sparkContext._jsc.sc().isStopped():
                clean_up(spark)
        except Exception:  # noqa: BLE001 the session has gone
            pass


class Scratch:
    """Written intermediate tables of one operator run.

    `table` writes a DataFrame and returns it as read from the files; `drop` deletes the
    files of tables that a later round has replaced.  What is left goes with `clean_up` or at the
    end of the session's process.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/notegraph-scratch/{name}-{uuid.uuid4().hex}"
        _ROOTS[self.root] = (spark, spark.sparkContext.applicationId)

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = getattr(df, "_scratch_path", None)
            if path:
                jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jpath, True)
