"""Python functions over the rows of a table, as an operator of its own that the optimiser neither copies nor merges."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Rows that a function gets at once; texts may be long.
ROWS = 64


def mapped(df: DataFrame, inputs: list[str], made: str, f: Callable[..., Iterable[tuple]]) -> DataFrame:
    """df without the columns ``inputs`` and with those of the schema ``made``, of which f makes a tuple for each row from lists of the inputs. Other columns pass as they are."""
    new = StructType.fromDDL(made)
    kept = [x for x in df.schema if x.name not in inputs]
    schema = StructType(kept + list(new))
    names, kept_names = [x.name for x in schema], [x.name for x in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [to_arrow_type(x.dataType) for x in new]
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                b = whole.slice(i, ROWS)
                rows = list(f(*[b.column(c).to_pylist() for c in inputs]))
                arrays = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([b.column(c) for c in kept_names] + arrays, names)

    return df.mapInArrow(run, schema)
