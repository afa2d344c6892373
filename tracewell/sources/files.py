"""Small files and paths through Hadoop's file system, as Spark itself resolves them."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Refused(ValueError):
    """What is asked for would change something that is sealed."""


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _store(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme and authority, so that a library which takes URIs meets the same store as Spark."""
    return _store(spark, path).makeQualified(_path(spark, path)).toString()


def exists(spark: SparkSession, path: str) -> bool:
    return _store(spark, path).exists(_path(spark, path))


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    return sorted(s.getPath().getName() for s in _store(spark, folder).listStatus(_path(spark, folder))) if exists(spark, folder) else []


def read_text(spark: SparkSession, path: str) -> str:
    stream = _store(spark, path).open(_path(spark, path))
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def canonical(value) -> str:
    """JSON with sorted keys and a line end; numbers that JSON can't hold are refused."""
    return json.dumps(value, sort_keys=True, indent=2, allow_nan=False, ensure_ascii=False) + "\n"


def seal_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file once, whole or not at all: True if it is new, False if it was there with equal text; unlike text is refused.

    The text goes to a file of its own first, which is then renamed without the right to overwrite, so of two writers one wins
    and the other is treated as late.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    if not exists(spark, path):
        part = f"{path}.{jvm.java.util.UUID.randomUUID()}.partial"
        store = _store(spark, path)
        out = store.create(_path(spark, part), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(_path(spark, qualified(spark, part)), _path(spark, qualified(spark, path)), gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Exception:
            store.delete(_path(spark, part), False)
            if not exists(spark, path):
                raise
    if read_text(spark, path) != text:
        raise Refused(f"{path} is sealed with other content")
    return False


def seal_json(spark: SparkSession, path: str, value) -> bool:
    return seal_text(spark, path, canonical(value))


def delete(spark: SparkSession, folder: str) -> None:
    _store(spark, folder).delete(_path(spark, folder), True)
