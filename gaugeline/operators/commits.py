"""Small numbered commit files beside a dataset: what has been written for good.

``<dir>/_commit-<number>.json`` holds one JSON document; the highest readable number counts.  A commit creates the next
number and never overwrites: two writers of one dataset cannot both succeed, and a file cut short by a crash is
passed over.  Names with a leading underscore are hidden from Spark's readers.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

_PREFIX = "_commit-"


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of a path."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, hpath = file_system(spark, path)
    return fs.exists(hpath)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or a folder, if it is there."""
    fs, hpath = file_system(spark, path)
    fs.delete(hpath, True)


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    fs, hpath = file_system(spark, f"{folder}/{_PREFIX}*.json")
    found = fs.globStatus(hpath) or []
    return sorted(int(s.getPath().getName()[len(_PREFIX):-len(".json")]) for s in found)


def _path(folder: str, number: int) -> str:
    return f"{folder}/{_PREFIX}{number:012d}.json"


def read_commit(spark: SparkSession, folder: str) -> tuple[int, dict | None]:
    """(highest number in use or -1, the newest complete document or None)."""
    numbers = _numbers(spark, folder)
    jvm = spark.sparkContext._jvm
    for number in reversed(numbers):
        fs, hpath = file_system(spark, _path(folder, number))
        stream = fs.open(hpath)
        try:
            text = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
        finally:
            stream.close()
        try:
            return numbers[-1], json.loads(text or "")
        except ValueError:
            continue
    return (numbers[-1] if numbers else -1), None


def write_commit(spark: SparkSession, folder: str, number: int, doc: dict) -> None:
    """Create commit ``number`` (an error if it is taken); older files than the one before it go."""
    fs, hpath = file_system(spark, _path(folder, number))
    out = fs.create(hpath, False)
    try:
        out.write(bytearray(json.dumps(doc, sort_keys=True).encode("utf-8")))
    finally:
        out.close()
    for old in _numbers(spark, folder):
        if old < number - 1:
            fs.delete(file_system(spark, _path(folder, old))[1], False)
