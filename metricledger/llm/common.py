"""What the operators share: written tables, Arrow rows, and splits by identifier."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricledger.session import new_table_path

#: Rows that a Python worker hands back at once.
OUT_ROWS = 4_096


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a new table in the folder of ``spark.checkpoint.dir``.

    The lineage ends there, so a lost executor repeats only what comes later.
    """
    spark = df.sparkSession
    path = new_table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_rows(docs: DataFrame, row: str) -> DataFrame:
    """The same rows with a number of their own, from a written table: read twice, a row has the same number, however ``docs`` was made."""
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")


#: Rows of identifiers (8 bytes each) up to which a table of them is sent to all tasks.
SENT_IDS = 1_000_000


def by_size(ids: DataFrame) -> DataFrame:
    """A written table of identifiers for a join: marked for broadcast if it is small, else left to the planner. Rows are the same."""
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """doc_id, text, y of at most ``limit`` labelled documents that are not held out, the first by a hash.

    Labels that are null, or contradict each other, are left out.
    """
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    y = y.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").drop("other")
    y = y.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return texts(docs).join(F.broadcast(y), "doc_id")  # at most ``limit`` rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the identifier and the text, under the names ``doc_id`` and ``text``; other columns cannot clash."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Views of a few rows each, so that few texts are Python objects at once."""
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    """glibc's call that hands free memory back; None with another C library."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return None


def handed_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same task; at its end memory that the allocators keep goes back to the system. Spark keeps a Python worker for later tasks,
    so what a large task leaves would lie beside those of the next steps."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if _trim():
            _trim()(0)

    return whole


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    for part in slices(batch):
        yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def batches_from(rows: Iterable[tuple], schema: pa.Schema, size: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def held_out(key: Column) -> Column:
    """One identifier in five: ``crc32`` of its decimal text, modulo 5, is 0. Null identifiers are held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def is_held_out(key: int | None) -> bool:
    return key is None or zlib.crc32(str(key).encode()) % 5 == 0


def parts_for(df_bytes: int, at_once: int) -> int:
    """How many blocks of about ``at_once`` bytes hold ``df_bytes``."""
    return max(1, -(-df_bytes // at_once))
