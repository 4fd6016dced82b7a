"""Single files of any file system that Spark reaches."""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder; nothing if there is none."""
    fs, target = hadoop_path(spark, path)
    fs.delete(target, True)


def listing(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(name, time of change in milliseconds) of what a folder holds; nothing if there is none."""
    fs, target = hadoop_path(spark, folder)
    try:
        return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(target)]
    except Py4JJavaError as e:
        if _is(spark, e, "java.io.FileNotFoundException"):
            return []
        raise


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = hadoop_path(spark, path)
    return fs.exists(target)


def put_if_absent(spark: SparkSession, path: str, content: bytes) -> bool:
    """Make a file with all its content at once; False, and nothing done, if there is one.

    A finished temporary file gets the name in one step that fails where the name
    is taken: a link on a local disk, whose renames would replace the file, and
    a rename without replacement elsewhere.
    """
    jvm = spark.sparkContext._jvm
    fs, target = hadoop_path(spark, path)
    parent = target.getParent()
    fs.mkdirs(parent)
    temporary = jvm.org.apache.hadoop.fs.Path(parent, f"_{target.getName()}.{uuid.uuid4().hex}")
    out = fs.create(temporary, False)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    try:
        real = fs.resolvePath(temporary).toUri()
        if real.getScheme() == "file":
            folder = jvm.java.nio.file.Paths.get(real).getParent()
            files = jvm.java.nio.file.Files
            files.createLink(folder.resolve(target.getName()), folder.resolve(temporary.getName()))
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
                fs.makeQualified(target).toUri(), spark.sparkContext._jsc.hadoopConfiguration()
            )
            rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            context.rename(temporary, target, spark.sparkContext._gateway.new_array(rename, 0))
        return True
    except Py4JJavaError as e:
        if _is(spark, e, "java.nio.file.FileAlreadyExistsException", "org.apache.hadoop.fs.FileAlreadyExistsException"):
            return False
        raise
    finally:
        fs.delete(temporary, False)


def _is(spark: SparkSession, error: Py4JJavaError, *names: str) -> bool:
    return error.java_exception.getClass().getName() in names


def literal(path: str) -> str:
    """A path whose characters stand for themselves where Spark takes a pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)
