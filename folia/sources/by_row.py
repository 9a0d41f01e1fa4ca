"""Functions over single rows in Python whose memory doesn't grow with the number of rows in a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

#: What is sent on at once: rows, and characters, bytes and items of arrays in them. A single row may be larger.
ROWS_A_BATCH, WEIGHT_A_BATCH = 2_000, 2_000_000


def _weight(values: Iterable) -> int:
    return sum(len(v) * (1 if isinstance(v, str | bytes) else 16) for v in values if isinstance(v, str | bytes | list))


def by_row(df: DataFrame, f: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that f makes of the values of each row. A batch stays as it came, outside of Python's objects: its rows
    are turned to Python one by one, and results go on in small batches. Maps are lists of pairs."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    def run(batches):
        for batch in batches:
            part, weight = [], 0
            for k in range(batch.num_rows):
                for row in f(*[column[k].as_py() for column in batch.columns]):
                    part.append(row)
                    weight += _weight(row)
                    if len(part) >= ROWS_A_BATCH or weight >= WEIGHT_A_BATCH:
                        yield packed(part)
                        part, weight = [], 0
            if part:
                yield packed(part)

    return df.mapInArrow(run, schema)
