"""Readers of records, article files, graphs and progress."""

from __future__ import annotations

import fnmatch
import functools
import itertools
import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from graphloom.tables import local_folder

WIKI = "id string, title string, text string"
ESSAY = "essay_title string, essay_content string"
GRAPH = (
    "article_title string, nodes map<string,struct<concepts:array<string>>>, relations map<string,struct<definition:string,concepts:array<string>>>, "
    "triples array<struct<subject:string,relation:string,object:string>>, entity_map map<string,string>, relation_map map<string,string>"
)
PROGRESS = "key string"
FILES = 2_000


def _missing(e: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in (e.getCondition() or str(e))


def wiki_records(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, title, text)`` from JSON lines; blank lines are skipped, a broken line fails the read, a missing path gives no rows."""
    try:
        rows = spark.read.schema(WIKI).option("mode", "FAILFAST").json(path)
    except AnalysisException as e:
        if not _missing(e):
            raise
        rows = spark.createDataFrame([], WIKI)
    return rows.select(F.col("id").alias("doc_id"), "title", "text")


def essay_records(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, title, text)`` from JSON lines of essays; the title is the key."""
    try:
        rows = spark.read.schema(ESSAY).option("mode", "FAILFAST").json(path)
    except AnalysisException as e:
        if not _missing(e):
            raise
        rows = spark.createDataFrame([], ESSAY)
    return rows.select(F.col("essay_title").alias("doc_id"), F.col("essay_title").alias("title"), F.col("essay_content").alias("text"))


def article_files(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, title, text)``, one row a file, with line ends as ``\\n``; key and title are the file name without its ending."""
    rows = spark.read.text(path, wholetext=True).select("value", "_metadata.file_name")
    stem = F.regexp_extract("file_name", r"^(.*?)(\.[^.]*)?$", 1)
    return rows.select(stem.alias("doc_id"), stem.alias("title"), F.regexp_replace("value", r"\r\n?", "\n").alias("text"))


def graphs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Graph documents from JSON files of one document each, or from JSON lines; ``path`` may hold a pattern."""
    return spark.read.schema(GRAPH).option("multiLine", not lines).json(path)


def graph_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Graphs of JSON files with their ``file``, and ``(file, value)`` of the files that hold none; a broken file stops no other."""
    rows = _whole_files(spark, path)
    good = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    rows = rows.withColumns({"good": good, "g": F.from_json("value", GRAPH)})
    return rows.filter("good and g.triples is not null").select("file", "g.*"), rows.filter("not good or g.triples is null").select("file", "value")


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    """``(file, value)`` of each file that ``path`` matches.

    Many small files in one folder of the file system are listed once, by a task, and read by name, ``FILES`` a task: Spark's
    own reader lists each file by itself, counts it as 4 MB, and leaves out names that begin with ``_`` or a dot.
    """
    folder, _, pattern = path.rpartition("/")
    if folder and not set(folder) & set("*?[]{}\\") and not set(pattern) & set("[]{}\\"):
        local = local_folder(spark, folder)
        kinds = Counter(e.is_file() for e in _matching(local, pattern)) if local and os.path.isdir(local) else {}
        if set(kinds) == {True}:
            tasks = max(spark.sparkContext.defaultParallelism, -(-kinds[True] // FILES))
            names = spark.range(0, 1, 1, 1).mapInArrow(functools.partial(_list_batches, local, pattern), "file string").repartition(tasks, "file")
            return names.mapInArrow(functools.partial(_read_batches, local), "file string, value binary").select("file", F.col("value").cast("string").alias("value"))
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")


def _matching(folder: str, pattern: str) -> Iterator[os.DirEntry]:
    """Entries of a folder, without the files that a writer has not finished and the checksums of Hadoop."""
    match = re.compile(fnmatch.translate(pattern)).match
    with os.scandir(folder) as entries:
        for e in entries:
            if match(e.name) and not (e.name.startswith(".") and e.name.endswith((".part", ".crc"))):
                yield e


def _list_batches(folder: str, pattern: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _ in batches:
        names = (e.name for e in _matching(folder, pattern))
        while some := list(itertools.islice(names, 10_000)):
            yield pa.record_batch({"file": pa.array(some, pa.string())})


def _read_batches(folder: str, batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    out = lambda rows: pa.record_batch({"file": pa.array([n for n, _ in rows], pa.string()), "value": pa.array([v for _, v in rows], pa.binary())})
    for batch in batches:
        rows, size = [], 0
        for name in batch.column(0).to_pylist():
            with open(os.path.join(folder, name), "rb") as f:
                rows.append((name, f.read()))
            size += len(rows[-1][1])
            if size >= most:
                yield out(rows)
                rows, size = [], 0
        if rows:
            yield out(rows)


def progress(spark: SparkSession, path: str) -> DataFrame:
    """``key`` of every record that is done; nothing is done where nothing was written."""
    try:
        return spark.read.schema(PROGRESS).json(path).filter("key is not null").distinct()
    except AnalysisException as e:
        if not _missing(e):
            raise
        return spark.createDataFrame([], PROGRESS)


def remaining(records: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """Records whose key is not done yet; which side is broadcast is left to the optimizer."""
    return records.join(done.select(F.col("key").alias(key)), key, "left_anti")
