"""Arrow-batched Python stages and numpy views of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from cohortlab.functions.shipping import ship

def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, object]], schema: str, slice_rows: int = 0) -> DataFrame:
    """Run `fn` (column lists -> column lists) over Arrow batches, `slice_rows` at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows or max(1, batch.num_rows)):
                part = batch.slice(at, slice_rows or None)
                out = fn({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    ship(df.sparkSession)
    types = [to_arrow_type(f.dataType) for f in _parse_datatype_string(schema).fields]
    return df.mapInArrow(run, schema)


def code_points(text: str) -> np.ndarray:
    """The text's code points as uint32."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
