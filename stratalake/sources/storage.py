"""Path helpers over the Hadoop file system, so object stores work like local disks."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _fs(spark, path)
    return fs.exists(hadoop_path)


def is_dir(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _fs(spark, path)
    return fs.exists(hadoop_path) and fs.getFileStatus(hadoop_path).isDirectory()


def children(spark: SparkSession, path: str) -> list[str]:
    """Names right below ``path``; empty when it does not exist."""
    fs, hadoop_path = _fs(spark, path)
    if not fs.exists(hadoop_path):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(hadoop_path))


def child_dirs(spark: SparkSession, path: str) -> list[str]:
    """Names of the directories right below ``path``; empty when it does not exist."""
    fs, hadoop_path = _fs(spark, path)
    if not fs.exists(hadoop_path):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(hadoop_path) if s.isDirectory())


def delete_dir(spark: SparkSession, path: str) -> None:
    fs, hadoop_path = _fs(spark, path)
    fs.delete(hadoop_path, True)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text, read by the driver."""
    fs, hadoop_path = _fs(spark, path)
    stream = fs.open(hadoop_path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def first_lines(spark: SparkSession, path: str) -> Iterator[str]:
    """The lines of a text file one by one, undoing a compression that its suffix names; reads no further than asked."""
    fs, hadoop_path = _fs(spark, path)
    jvm = spark._jvm
    stream = fs.open(hadoop_path)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(hadoop_path)
        plain = codec.createInputStream(stream) if codec is not None else stream
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8"))
        while (line := reader.readLine()) is not None:
            yield line
    finally:
        stream.close()


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Put a small file there with its whole text, or give False because there is one already.

    Of two writers one succeeds: a hard link (local) or a rename (HDFS) of a finished file does not replace another, and an object store
    is asked to create only.
    """
    fs, target = _fs(spark, path)
    fs.mkdirs(target.getParent())
    data = bytearray(text.encode())
    if fs.getScheme() == "file":
        name = target.toUri().getPath()
        draft = f"{os.path.dirname(name)}/.{uuid.uuid4().hex}"
        with open(draft, "wb") as out:
            out.write(data)
        try:
            os.link(draft, name)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    if fs.getScheme() in ("hdfs", "viewfs"):
        draft = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
        _write(fs.create(draft, False), data)
        done = not fs.exists(target) and fs.rename(draft, target)
        if not done:
            fs.delete(draft, False)
        return done
    try:
        _write(fs.create(target, False), data)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception) or fs.exists(target):
            return False
        raise
    return True


def _write(stream, data: bytearray) -> None:
    try:
        stream.write(data)
    finally:
        stream.close()


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path."""
    fs, hadoop_path = _fs(spark, path)
    return fs.getContentSummary(hadoop_path).getLength()


def dir_times(spark: SparkSession, path: str) -> dict[str, float]:
    """Names of the directories right below ``path`` and when each was changed, in seconds."""
    fs, hadoop_path = _fs(spark, path)
    if not fs.exists(hadoop_path):
        return {}
    return {s.getPath().getName(): s.getModificationTime() / 1000 for s in fs.listStatus(hadoop_path) if s.isDirectory()}


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh directory every executor can reach.

    The session's ``spark.checkpoint.dir`` names the shared folder. Without it only a
    local-mode session may fall back to this machine's temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/stratalake/{name}-{uuid.uuid4().hex}"
    if re.match(r"local(\[|$)", spark.sparkContext.master):  # not local-cluster, whose executors have folders of their own
        return tempfile.mkdtemp(prefix=f"stratalake-{name}-")
    raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
