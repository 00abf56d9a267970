"""What the operators of this subpackage share: inputs, the shared folder, Arrow helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from meridian.sources.shared import discard, shared_dir, stored

__all__ = ["by_bytes", "column_bytes", "discard", "filter_text", "map_text", "shared_dir", "stored", "table", "tokens", "words"]

# Workers are reused by later stages: what a batch took goes back to the system, not into Arrow's own pool.
pa.set_memory_pool(pa.system_memory_pool())

#: Lower-cases A-Z and turns every byte outside [0-9a-z\x80-\xff] into a space. Bytes of
#: multi-byte UTF-8 characters are all over 0x7F, so working on bytes is working on characters.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Lower-cases A-Z.
LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(data: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z."""
    return data.translate(WORD_TABLE).split()


def tokens(data: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z (bytes.split() splits on just these)."""
    return data.translate(LOWER_TABLE).split()


def column_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [x if x is not None else b"" for x in column.cast(pa.large_binary()).to_pylist()]


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library, which has no such call
    _trim = int


def give_back() -> None:
    """Returns freed memory to the system: workers outlive their tasks."""
    _trim(0)


def by_bytes(batch: pa.RecordBatch, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about `limit` bytes at most, so that a batch of very long texts is worked on piece by piece. After the last one,
    freed memory goes back."""
    yield from _halves(batch, limit)
    give_back()


def _halves(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    if batch.nbytes <= limit or batch.num_rows <= 1:
        yield batch
        return
    half = batch.num_rows // 2
    yield from _halves(batch.slice(0, half), limit)
    yield from _halves(batch.slice(half), limit)


def arrow_batch(schema: pa.Schema, columns: dict[str, object]) -> pa.RecordBatch:
    arrays = []
    for f in schema:
        v = columns[f.name]
        arrays.append(v.cast(f.type) if isinstance(v, pa.Array) else pa.array(v, f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def map_text(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    schema: str,
    make: Callable[[], Callable[[pa.Array, list[bytes]], dict[str, object]]],
) -> DataFrame:
    """Maps batches of (id, text). `make` is called once a task and returns fn(id column, texts as UTF-8
    bytes) -> columns of `schema`, of any one length; if fn has a `done`, it is called at the task's end. Only these two
    columns are read, so that other columns can't clash with those of the result."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        try:
            for batch in batches:
                for part in by_bytes(batch):
                    yield arrow_batch(arrow, fn(part.column(0), column_bytes(part.column(1))))
        finally:
            getattr(fn, "done", lambda: None)()
            give_back()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def filter_text(docs: DataFrame, text_col: str, make: Callable[[], Callable[[list[bytes]], list[bool]]]) -> DataFrame:
    """The rows, with all their columns, for whose texts fn gives true. `make` is called once a task and returns fn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in by_bytes(batch):
                yield part.filter(pa.array(fn(column_bytes(part.column(part.schema.get_field_index(text_col)))), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
