"""Small file-system calls through Hadoop, so that local paths, HDFS and object stores work alike."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _open(spark, path)
    return fs.exists(hadoop_path)


def children(spark: SparkSession, path: str) -> list[tuple[str, bool, int, int]]:
    """One level: name, is a directory, length in bytes, modification time in milliseconds."""
    fs, hadoop_path = _open(spark, path)
    if not fs.exists(hadoop_path):
        return []
    return [(s.getPath().getName(), s.isDirectory(), s.getLen(), s.getModificationTime())
            for s in fs.listStatus(hadoop_path)]


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a file, or a folder with all it holds; False if there is none."""
    fs, hadoop_path = _open(spark, path)
    return fs.delete(hadoop_path, True)


def remove_uri(spark: SparkSession, uri: str) -> bool:
    """Delete what a file's metadata names; such addresses are encoded as URIs, paths are not."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    fs, hadoop_path = _open(spark, path)
    if not fs.rename(hadoop_path, _open(spark, to)[1]):
        raise OSError(f"could not rename {path} to {to}")


def read_text(spark: SparkSession, path: str) -> str:
    """The content of a small file."""
    fs, hadoop_path = _open(spark, path)
    stream = fs.open(hadoop_path)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
