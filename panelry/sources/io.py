"""Table readers and writers, and the shared-folder hand-over between stages."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

CSV_OPTIONS = {"header": "true", "nullValue": "NA"}


def _format_of(path: str, fmt: str | None) -> str:
    if fmt:
        return fmt
    return "csv" if path.rstrip("/").lower().endswith((".csv", ".csv.gz")) else "parquet"


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: StructType | str | None = None,
) -> DataFrame:
    """Scan a CSV or parquet table.

    CSV has a header line and writes nulls as ``NA``; an empty field is null too. Give a schema for
    CSV: without one Spark reads the files twice to infer it.
    """
    kind = _format_of(path, fmt)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "csv":
        # With a schema, a header that names other columns is an error, not a silent shift.
        reader = reader.options(**CSV_OPTIONS)
        reader = reader.option("inferSchema", "true") if schema is None else reader.option("enforceSchema", "false")
    return reader.format(kind).load(path)


def write_table(
    df: DataFrame,
    path: str,
    fmt: str | None = None,
    partition_by: list[str] | None = None,
    mode: str = "overwrite",
) -> None:
    """Write a table as CSV (header, ``NA`` for null) or snappy parquet.

    Every task writes its own files, also under ``partition_by``, so one large partition value is
    not funnelled through one task.
    """
    kind = _format_of(path, fmt)
    writer = df.write.mode(mode).format(kind)
    writer = writer.options(**CSV_OPTIONS) if kind == "csv" else writer.option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` or the context's checkpoint folder.

    A temporary folder is made only on a local master, where one machine runs everything. The context
    checkpoints into the same folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        folder = tempfile.mkdtemp(prefix="panelry-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


#: Paths of this process in the shared folder, to be deleted when it ends.
_WRITTEN: list[str] = []


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder. It goes when the process ends, or earlier with ``clean_up``."""
    if not _WRITTEN:
        atexit.register(clean_up)
    path = f"{shared_folder(spark).rstrip('/')}/panelry-{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def clean_up() -> None:
    """Delete what this process wrote to the shared folder. DataFrames that still read it fail afterwards."""
    context = SparkContext._active_spark_context
    while _WRITTEN and context is not None:
        path = context._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage at a stage boundary that several consumers share, survives lost executors, and
    gives the optimizer the true size, so that it decides by size whether to broadcast the result.
    """
    path = shared_path(df.sparkSession, label)
    write_table(df, path, "parquet")
    return read_table(df.sparkSession, path, "parquet", df.schema)
