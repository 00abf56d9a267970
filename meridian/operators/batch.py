"""Work a key whose failures are rows: one key that can't be done does not stop the others, and none is left out."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

SUCCEEDED, FAILED, REJECTED = "SUCCEEDED", "FAILED", "REJECTED"


class DomainError(ValueError):
    """What makes one key's work impossible: a code, and what it was about. Any other error is a fault of the program and fails the job."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code, self.detail = code, detail

    def __reduce__(self):
        return type(self), (self.code, self.detail)


def run_batch(tasks: DataFrame, key: str, work: Callable[[dict[str, Any]], dict[str, Any]], result: str, accept: Callable[[dict[str, Any]], bool] | None = None) -> DataFrame:
    """(key, outcome, value, code, detail, seconds): `work` takes a row of `tasks` and gives the fields of `result`, a DDL schema. A DomainError makes
    the row FAILED with its code; a value that `accept` does not take is REJECTED and kept. Each row of tasks gives one row, and
    as tasks are lost or run again whole, never two. Rows go to workers one key at a time and in batches, so that what a key needs is
    loaded by `work` itself."""
    value = StructType.fromDDL(result)
    schema = StructType([tasks.schema[key], StructField("value", value)])
    for f in StructType.fromDDL("outcome string, code string, detail string, seconds double"):
        schema.add(f)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                began, got, code, detail = time.monotonic(), None, None, None
                try:
                    got = work(row)
                    outcome = SUCCEEDED
                    if accept is not None and not accept(got):
                        outcome, code, detail = REJECTED, "rejected", "the result did not qualify"
                except DomainError as error:
                    outcome, code, detail = FAILED, error.code, error.detail
                out.append({key: row[key], "value": got, "outcome": outcome, "code": code, "detail": detail, "seconds": time.monotonic() - began})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return tasks.mapInArrow(run, schema)


def summary(report: DataFrame) -> DataFrame:
    """(outcome, code, keys): how many keys came to each end."""
    return report.groupBy("outcome", "code").count().withColumnRenamed("count", "keys")
