"""Clouds to and from Arrow: tables, readers of record batches, and the C interfaces they carry."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.shared import shared_folder


def reader(df: DataFrame, rows: int = 16_384) -> pa.RecordBatchReader:
    """Batches of at most `rows` rows, read one after the other from a table that executors write to the shared folder:
    the driver holds one batch, never the cloud."""
    to = f"{shared_folder(df.sparkSession)}/arrow-{uuid.uuid4().hex}"
    df.write.parquet(to)
    fs, path = pafs.FileSystem.from_uri(to if "://" in to or to.startswith("file:") else f"file://{to}")
    schema = to_arrow_schema(df.schema)
    parts = ds.dataset(path, format="parquet", filesystem=fs, schema=schema)
    return pa.RecordBatchReader.from_batches(schema, parts.to_batches(batch_size=rows))


def from_reader(spark: SparkSession, batches: pa.RecordBatchReader, rows: int = 1 << 20) -> DataFrame:
    """A cloud of batches, written to the shared folder about `rows` rows a file and read by executors."""
    to = f"{shared_folder(spark)}/arrow-{uuid.uuid4().hex}"
    fs, path = pafs.FileSystem.from_uri(to if "://" in to or to.startswith("file:") else f"file://{to}")
    ds.write_dataset(batches, path, format="parquet", filesystem=fs, max_rows_per_file=rows, max_rows_per_group=min(rows, 1 << 17))
    return spark.read.parquet(to) if list(ds.dataset(path, filesystem=fs).files) else spark.createDataFrame(pa.table({f.name: pa.array([], f.type) for f in batches.schema}))


def to_c(df: DataFrame, schema_at: int, array_at: int) -> None:
    """Exports a cloud that the driver can hold as one struct array of the C data interface."""
    table = df.toArrow().combine_chunks()
    batch = table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pydict({f.name: pa.array([], f.type) for f in table.schema}, schema=table.schema)
    batch._export_to_c(array_at, schema_at)


def from_c(spark: SparkSession, schema_at: int, array_at: int) -> DataFrame:
    """A cloud from one struct array of the C data interface."""
    return spark.createDataFrame(pa.Table.from_batches([pa.RecordBatch._import_from_c(array_at, schema_at)]))


def memory_sink(df: DataFrame, chunk: int = 16_384) -> list[pa.RecordBatch]:
    """The rows as a list of batches of at most `chunk` rows in the driver's memory: for small clouds."""
    return df.toArrow().to_batches(max_chunksize=chunk)
