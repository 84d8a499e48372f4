"""Helpers that several text operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of one Arrow batch that a task looks at together, in bytes.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text falls into one fold; a null key is hashed as empty."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == fold


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has about `limit` bytes of text, or one row.

    `text` is a column, or a field of a struct column as in `row.text`.
    """
    column, _, field = text.partition(".")
    for batch in batches:
        start, held = 0, 0
        texts = batch.column(column)
        for i, n in enumerate(pc.binary_length(texts.field(field) if field else texts).to_pylist()):
            if held and held + (n or 0) > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def give_back() -> None:
    """Returns to the machine what a task has freed: its worker waits for the next task and
    would keep it beside what that one needs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # there with glibc only
    if trim:
        trim(0)


def arrow_map(df: DataFrame, work: Callable, schema: str) -> DataFrame:
    """`mapInArrow` of a function from record batches to dictionaries of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        try:
            for columns in work(batches):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow
                )
        finally:
            give_back()

    return df.mapInArrow(run, schema)
