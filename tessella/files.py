"""Small files on any Hadoop file system: what Spark can reach, this can."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .errors import InvalidArgs


def work_folder(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, the place that all
    executors share. Where it is unset, a session of one machine takes a
    temporary folder, and any other has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise InvalidArgs("set spark.checkpoint.dir to a folder that all executors share")
    return f"{named.rstrip('/')}/work-{uuid.uuid4().hex}" if named else tempfile.mkdtemp(prefix="work-")


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, replace: bool = False) -> None:
    """Write beside ``path`` and rename, so a reader sees all or nothing. Without
    ``replace`` only one of several writers succeeds; the others get a
    FileExistsError. (The rename is one step on HDFS; on a local disk it looks
    first and then moves.)"""
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    _, draft = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
        stream.hsync()
    finally:
        stream.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration())
    option = jvm.org.apache.hadoop.fs.Options.Rename
    array = spark.sparkContext._gateway.new_array(option, 1)
    array[0] = option.OVERWRITE if replace else option.NONE
    try:
        context.rename(draft, p, array)
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if not replace and "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            raise FileExistsError(path) from None
        raise


def read_parquet(spark: SparkSession, paths: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of the Parquet files that a column of paths names, however many.
    The names go from the rows to the reader within the JVM."""
    encoder = spark._jvm.org.apache.spark.sql.Encoders.STRING()
    found = getattr(paths._jdf, "as")(encoder).collectAsList()
    if found.isEmpty():
        return spark.createDataFrame([], schema)
    names = spark._jvm.scala.jdk.javaapi.CollectionConverters.asScala(found).toSeq()
    return DataFrame(spark.read.schema(schema)._jreader.parquet(names), spark)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of a folder's entries, sorted; none for a missing folder."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
