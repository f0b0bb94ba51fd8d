"""Helpers of the package: row keys, applying decisions to whole rows, reading tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, as the contracts spell it: a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows and bytes of a batch that a Python task gets at a time. Texts are long, and a task holds a few batches.
BATCH_ROWS, BATCH_BYTES = 1000, 8_000_000


def small_batches(spark: SparkSession) -> SparkSession:
    """Bound the batches that Python tasks of this session get; queries and pipeline stages call it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def giving_back(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """A task's function that hands its memory back when it is done.

    Python workers serve one task after another; what one has freed would otherwise stay theirs.
    """
    def task(batches: Iterable) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """A top-level column by its literal name, dots and back quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct. Nested away, they cannot clash with working columns."""
    return F.struct(*[quoted(name) for name in df.columns])


def row_key(df: DataFrame) -> Column:
    """128 bits over all columns of a row; rows that agree in every column share it.

    Maps cannot be hashed and are left out.
    """
    names = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    # A null leaves a hash unchanged, so the null flags are hashed as well.
    parts = [quoted(name) for name in names] + [quoted(name).isNull() for name in names]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(0x5EED), *parts).alias("b"))


def whole_text(column: str = "text") -> Column:
    return F.coalesce(quoted(column).cast("string"), F.lit(""))


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


_ARROW = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(),
          "boolean": pa.bool_()}


def as_arrow(ddl: str) -> pa.Schema:
    """The Arrow schema of ``"name type, ..."`` with flat types; works in tasks, where no session is."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in (field.split() for field in ddl.split(","))])


def ones(values: np.ndarray) -> np.ndarray:
    """Bits set in each unsigned 64-bit value."""
    return np.bitwise_count(values)
