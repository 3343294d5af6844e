"""Tables written between the steps of a job, under the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local folder, which only a local master can use."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-steps-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written and read again: its lineage ends here, and lost executors do not make it again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, in order; none if it does not exist."""
    files, at = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []


def create_once(spark: SparkSession, path: str, content: str = "") -> bool:
    """Make a file unless it exists already, whoever made it: of several that try, one succeeds."""
    files, at = _file_system(spark, path)
    try:
        out = files.create(at, False)
    except Py4JJavaError as refused:
        if "FileAlreadyExists" in refused.java_exception.getClass().getName() or "already exists" in str(refused.java_exception.getMessage()):
            return False
        raise
    out.write(bytearray(content.encode()))
    out.close()
    return True


def text_of(spark: SparkSession, path: str) -> str:
    """The content of a small file."""
    files, at = _file_system(spark, path)
    stream = files.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder with all it holds; `path` may be a URI, as file metadata give it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(path) if "://" in path or path.startswith("file:") else path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
