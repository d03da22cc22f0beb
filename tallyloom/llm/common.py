"""Helpers shared by the corpus operators: input projection, splits, hand-over tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, shared_path
from ..sources.shared import materialized as written

__all__ = ["batches", "discard", "id_remainder", "shared_path", "slices", "table", "texts_of", "written"]

#: Texts per slice that a Python task works on at once, in characters.
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *keep: str) -> DataFrame:
    """Only the columns an operator needs; whatever else ``docs`` holds cannot clash with its own."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *keep)


def id_remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def slices(batch: pa.RecordBatch, column: str = "text", chars: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows whose texts together stay near ``chars``."""
    values, start, size = batch.column(column), 0, 0
    lengths = pc.utf8_length(values).to_pylist()
    for i, n in enumerate(lengths):
        size += n or 0
        if size >= chars:
            yield start, values.slice(start, i + 1 - start).to_pylist()
            start, size = i + 1, 0
    if start < len(lengths):
        yield start, values.slice(start).to_pylist()


def batches(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in rows if b.num_rows)
