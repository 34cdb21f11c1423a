"""Arrow batches through Python, without pandas in between."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def map_columns(df: DataFrame, make: Callable[[], Callable[..., dict[str, list]]], schema: str, *extra: object) -> DataFrame:
    """Rows of `df` through a Python function, one Arrow batch at a time.

    `make()` runs once per task and gives a function that takes each column of a batch as a list and returns
    the output columns by name. Empty results give an empty batch.
    """
    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            if b.num_rows:
                got = f(*[c.to_pylist() for c in b.columns])
                yield pa.RecordBatch.from_arrays([pa.array(got[x.name], x.type) for x in out], schema=out)

    return df.mapInArrow(run, schema)
