"""Running state along sorted rows: one shuffle by key, one pass, one batch in memory.

For state machines whose next step depends on the last decision (grids, accepted
starts, job events), where a window function has no form and a folded array would hold
a whole key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = Callable[[pa.RecordBatch], pa.Array]


def along(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], make: Callable[[], Step], name: str, kind: str) -> DataFrame:
    """Adds ``name``. For each key ``make()`` gives a function that is called with the
    key's rows in order, slice by slice, and returns a value for each row of a slice.
    A null in a key is a key of its own; nulls come first in the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            told = batch.column(batch.schema.get_field_index("_key"))
            coded = told.dictionary_encode()
            marks = coded.indices.to_numpy(zero_copy_only=False)
            data = batch.drop_columns(["_key"])
            parts = []
            edges = [0, *(np.flatnonzero(marks[1:] != marks[:-1]) + 1).tolist(), len(marks)]
            for low, high in zip(edges, edges[1:]):
                key = told[low].as_py()
                if key != last:
                    last, step = key, make()
                parts.append(step(data.slice(low, high - low)))
            yield pa.RecordBatch.from_arrays([*data.columns, pa.concat_arrays(parts)], names=[*data.schema.names, name])

    marked = rows.withColumn("_key", F.to_json(F.struct(*[F.col(k) for k in keys])))
    ordered = marked.repartition("_key").sortWithinPartitions("_key", *order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return ordered.mapInArrow(run, f"{fields}, `{name}` {kind}")


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
