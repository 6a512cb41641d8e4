"""Workbooks by their bytes: batches or streams of .xlsx files on any file system that Spark reads.

Files come through Spark's binaryFile source, one row a file, so a folder can be watched as a stream: each new workbook
is read once, with Spark's own bookkeeping of offsets. A file is one task's work and lies in its memory packed; its rows
are read one after another.

    stream_cells(spark, "s3a://inbox/").writeStream.format("parquet").option("checkpointLocation", ...).start(...)
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quadrille.sources.xlsx import CELLS, Workbook, cell_batches, chosen

FILES = "path string, modificationTime timestamp, length long, content binary"


def parse_workbooks(files: DataFrame, sheet: str | None = None, every: bool = False) -> DataFrame:
    """The cells of files (path, content): of the named sheet, of every one, or of the first one. Null and empty contents give none;
    a damaged file is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                if not content.is_valid or not len(content.as_buffer()):
                    continue
                book = Workbook(io.BytesIO(content.as_buffer()))
                for name, part in chosen(book.sheets, sheet or None, every):
                    yield from cell_batches((path, name, row, *cell) for row, cells in book.rows(part) for cell in cells)

    return files.select("path", "content").mapInArrow(run, CELLS)


def read_cells(spark: SparkSession, path: str, sheet: str | None = None, every: bool = False) -> DataFrame:
    return parse_workbooks(spark.read.format("binaryFile").option("pathGlobFilter", "*.xls[xm]").load(path), sheet, every)


def stream_cells(spark: SparkSession, folder: str, sheet: str | None = None, every: bool = False) -> DataFrame:
    """Cells of the workbooks that are in a folder, and of those that come."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.xls[xm]").load(folder)
    return parse_workbooks(files, sheet, every)
