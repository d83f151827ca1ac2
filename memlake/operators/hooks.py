"""Models as hooks: made once in each Python worker, called on Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Models of this worker by the name of their hook.
_MADE: dict[str, Callable[[list], list]] = {}


@dataclass(frozen=True)
class Model:
    """``make()`` gives a function from a list of texts to a list of values of ``kind``."""

    make: Callable[[], Callable[[list], list]]
    kind: T.DataType
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


def _made(model: Model) -> Callable[[list], list]:
    if model.name not in _MADE:
        _MADE[model.name] = model.make()
    return _MADE[model.name]


def applied(rows: DataFrame, text: str, model: Model | Callable[[Column], Column], out: str) -> DataFrame:
    """Rows with the model's value of a text column; a plain column function works as well."""
    if not isinstance(model, Model):
        return rows.withColumn(out, model(F.col(text)))
    rows = rows.drop(out)
    schema, kind = T.StructType([*rows.schema.fields, T.StructField(out, model.kind)]), to_arrow_type(model.kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _made(model)(batch.column(text).to_pylist())
            if len(values) != batch.num_rows:
                raise ValueError(f"a model gave {len(values)} values for {batch.num_rows} texts")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, kind)], names=schema.names)

    return rows.mapInArrow(run, schema)
