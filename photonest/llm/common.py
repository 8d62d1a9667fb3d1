"""What the text operators share: reading tables and walking Arrow batches in bounded slices."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that Spark puts in one Arrow batch for the text operators; long documents then stay within memory.
BATCH_ROWS = 4000
#: Bytes of text that a kernel sees at once (one document at least).
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Parts in which the rows of one key meet the other side of a join.
SALT = 16


def salted_join(rows: DataFrame, small: DataFrame, key: str, spread: str) -> DataFrame:
    """``rows`` left-joined with ``small`` on ``key``, of which a third of all rows may share one value.

    Rows of a key are dealt by the hash of ``spread`` among ``SALT`` tasks; ``small``, a row a key, goes to each of them.
    It may grow with the input, so it is merged and never broadcast.
    """
    dealt = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).hint("merge")
    return rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALT)).cast("int")).join(dealt, [key, "__salt"], "left").drop("__salt")


def slices(batch: pa.RecordBatch, text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of at most ``limit`` text bytes, one row at least."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    start = 0
    while start < len(size):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null counts as empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def give_back() -> None:
    """Hand freed memory back to the system: an idle worker stays beside the executor's next stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_texts(
    df: DataFrame,
    kernel: Callable[[pa.RecordBatch], dict | None],
    schema: StructType,
    text: str = "text",
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Run ``kernel`` over bounded slices of ``df``; it returns the columns of ``schema`` by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(schema)
        for batch in batches:
            for part in slices(batch, text, limit):
                made = kernel(part)
                if made is not None:
                    yield pa.RecordBatch.from_arrays(
                        [x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for f, x in ((f, made[f.name]) for f in target)],
                        schema=target,
                    )
        give_back()

    return df.mapInArrow(run, schema)
