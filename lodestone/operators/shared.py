"""Folders for what operators write, paths that Spark and pyarrow read alike, and the sizes that Spark expects."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share. Without one, a temporary folder on a local master and an error elsewhere."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return qualified(spark, named.rstrip("/"))
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, _roots[app], ignore_errors=True)
    return f"file://{_roots[app]}"


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below ``shared_root``."""
    return f"{shared_root(spark)}/lodestone/{what}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, as Spark resolves it, so that Python workers open the same place."""
    target, system = _hadoop(spark, path)
    full = system.makeQualified(target).toString()
    return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full


def exists(spark: SparkSession, path: str) -> bool:
    target, system = _hadoop(spark, path)
    return system.exists(target)


def drop_folder(spark: SparkSession, path: str) -> None:
    target, system = _hadoop(spark, path)
    system.delete(target, True)


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system and path of a qualified path."""
    return pafs.FileSystem.from_uri(uri)


def read_bytes(uri: str) -> bytes:
    system, path = place(uri)
    with system.open_input_stream(path) as f:
        return f.read()


def write_bytes(uri: str, raw: bytes) -> None:
    system, path = place(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path) as f:
        f.write(raw)


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to a shared folder and read it again: computed once, and a lost executor costs nothing."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def expected_bytes(df: DataFrame) -> int:
    """Bytes that Spark expects ``df`` to have."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame) -> bool:
    """Whether Spark expects ``df`` to be small enough to broadcast."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return expected_bytes(df) <= int(str(limit))


#: Bytes of an Arrow batch that is handed to Python.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let Spark hand texts to Python in batches of ``BATCH_BYTES``; 10,000 long ones would fill a worker.

    The size is a setting of the session, so it changes for all that the session runs, unless it was set to another than the default."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "67108864b") in ("67108864b", "64MB"):
        spark.conf.set(key, str(BATCH_BYTES))
