"""Files of any file system that Spark reaches: existence, patterns, small texts. Paths are Hadoop paths or local ones."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _system(path: str):
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("no Spark session")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm


def exists(path: str) -> bool:
    fs, at, _ = _system(path)
    return fs.exists(at)


def matching(pattern: str) -> list[str]:
    """The paths that a pattern matches, in order; one without * matches itself if it exists."""
    fs, at, _ = _system(pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(at) or [])


def below(folder: str, ending: str) -> list[str]:
    """All files under a folder with an ending, in order."""
    fs, at, _ = _system(folder)
    out = []
    if fs.exists(at):
        it = fs.listFiles(at, True)
        while it.hasNext():
            p = it.next().getPath().toString()
            if p.endswith(ending):
                out.append(p)
    return sorted(out)


def read_text(path: str) -> str:
    """A small text (configuration, word list), whole."""
    fs, at, jvm = _system(path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_text(path: str, text: str) -> None:
    """A small text, in place of what is there."""
    fs, at, _ = _system(path)
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
