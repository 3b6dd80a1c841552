"""Small text files on whatever file system Spark writes to, so that a model's numbers lie beside its tables."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _file(spark: SparkSession, path: str):
    context = spark.sparkContext
    p = context._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(context._jsc.hadoopConfiguration())
    fs.setWriteChecksum(False)
    fs.setVerifyChecksum(False)  # the library's own checksums tell what changed
    return fs, p


def write_text(spark: SparkSession, path: str, body: str) -> None:
    fs, p = _file(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(body.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """FileNotFoundError if there is none."""
    fs, p = _file(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
