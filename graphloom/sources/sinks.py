"""Writers of graphs, property-graph tables and progress."""

from __future__ import annotations

import functools
import os
import shutil
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import file_name
from graphloom.operators import graph
from graphloom.tables import local_folder


def write_json_lines(documents: DataFrame, path: str, mode: str = "append") -> None:
    """One document a line, not escaped beyond what JSON needs."""
    documents.write.mode(mode).json(path)


def append_graphs(documents: DataFrame, path: str) -> None:
    """Appends graphs, one a line, each with the ``key`` of its record.

    The lines are the progress as well (``readers.progress`` reads them): a graph and the note that it
    is done are one write, so that a run that breaks off leaves neither without the other.
    """
    rows = documents.withColumn("key", F.col("doc_id").cast("string")).drop("doc_id")
    write_json_lines(rows.filter("key is not null"), path)


def write_json_files(documents: DataFrame, path: str) -> None:
    """One file a document, named after its title; a later document of the same title replaces the earlier one."""
    named = documents.withColumn("file", file_name(F.coalesce("article_title", F.lit(""))))
    write_named_files(named.groupBy("file").agg(F.max_by(F.to_json(F.struct(*documents.columns)), "doc_id").alias("value")), path)


def write_named_files(files: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A file for each row of ``(file, value)``, ended by a line end; for people and exports, tables are what scales.

    In a folder of the file system (``file:``) the tasks write the files under their names, each at once or not at all;
    ``overwrite`` puts the whole folder in place when it is complete. Elsewhere Spark writes a folder a file, which is renamed.
    """
    spark, folder = files.sparkSession, local_folder(files.sparkSession, path)
    if folder is None:
        files.select("file", "value").write.mode(mode).partitionBy("file").text(path)
        return unfold_files(spark, path)
    if mode not in ("append", "overwrite"):
        raise ValueError(f"no mode {mode!r}")
    target = Path(folder)
    into = target if mode == "append" else target.with_name(f".{uuid.uuid4().hex}.writing")
    into.mkdir(parents=True, exist_ok=True)
    try:
        rows = files.select(F.col("file").cast("string"), F.col("value").cast("string"))
        rows.mapInArrow(functools.partial(_write_batches, str(into)), "n long").write.format("noop").mode("overwrite").save()
        if into != target:
            old = into.with_suffix(".old")
            if target.exists():
                target.rename(old)
            into.rename(target)
            shutil.rmtree(old, ignore_errors=True)
    finally:
        if into != target:
            shutil.rmtree(into, ignore_errors=True)


def _write_batches(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    os.makedirs(folder, exist_ok=True)
    part = os.path.join(folder, f".{uuid.uuid4().hex}.part")
    for batch in batches:
        for name, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            name = name or "__HIVE_DEFAULT_PARTITION__"  # as Spark names a folder without a name
            if "/" in name or name in (".", ".."):
                raise ValueError(f"no name of a file: {name!r}")
            with open(part, "wb") as f:
                f.write((value or b"") + b"\n")
            os.replace(part, os.path.join(folder, name))
        yield pa.record_batch({"n": pa.array([batch.num_rows], pa.int64())})


def unfold_files(spark: SparkSession, path: str) -> None:
    """Turns each folder ``file=NAME`` with one part into the file NAME."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for part in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/file=*/part-*")) or []:
        parent = part.getPath().getParent()
        name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(parent.getName().removeprefix("file="))
        fs.rename(part.getPath(), jvm.org.apache.hadoop.fs.Path(folder, name))
        fs.delete(parent, True)


def write_tables(documents_path: str, **tables: DataFrame) -> None:
    """The flat tables as parquet, which is the form to work on; a sort by article lets readers skip row groups."""
    for name, rows in tables.items():
        rows.sortWithinPartitions("doc_id").write.mode("overwrite").parquet(f"{documents_path}/{name}")


def write_property_graph(triples: DataFrame, nodes: DataFrame, relations: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``nodes`` and ``edges`` tables of a property graph; ``overwrite`` is what clears the graph first."""
    graph.property_nodes(nodes).write.mode(mode).parquet(f"{path}/nodes")
    graph.property_edges(triples, relations).write.mode(mode).parquet(f"{path}/edges")
    graph.has_entity(nodes).write.mode(mode).parquet(f"{path}/has_entity")


def write_progress(done: DataFrame, path: str, key: str = "doc_id") -> None:
    """Appends the keys of finished records; repeated keys do no harm, readers take them once."""
    done.select(F.col(key).cast("string").alias("key")).filter("key is not null").distinct().write.mode("append").json(path)
