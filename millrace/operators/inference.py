"""Where models meet tables: a model is loaded once a worker and sees Arrow batches; what it says is a table.

Models themselves, their weights and their training are outside.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DETECTIONS = "array<struct<label:string,score:double,box_xywh:array<double>>>"
SCORES = "array<double>"
POLYGONS = "array<array<double>>"
_loaded: dict[str, object] = {}


def apply_model(rows: DataFrame, inputs: list[str], load: Callable[[], object], predict: Callable[[object, dict[str, list]], list], out: str, kind: str, name: str) -> DataFrame:
    """rows with column out: predict(model, inputs of a batch), one value a row. load() is called once a worker and its
    model kept by `name` until another's is wanted. A row that is tried again is predicted again: predict must not depend on
    the batch."""
    schema = rows.withColumn(out, F.lit(None).cast(kind)).schema
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(schema[out].dataType)

    def run(batches):
        if name not in _loaded:
            _loaded.clear()
            _loaded[name] = load()
        for b in batches:
            said = predict(_loaded[name], {c: b.column(b.schema.get_field_index(c)).to_pylist() for c in inputs}) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, arrow)], names=[*b.schema.names, out])

    return rows.mapInArrow(run, schema)


def polygons_or_boxes(boxes: Column, polygons: Column) -> Column:
    """A segmenter's flat polygons by place, and the box's rectangle where it gave none of three points."""
    corner = lambda b: F.array(b[0], b[1], b[0] + b[2], b[1], b[0] + b[2], b[1] + b[3], b[0], b[1] + b[3])
    return F.transform(boxes, lambda b, i: F.when(F.coalesce(F.size(F.get(polygons, i)) >= 6, F.lit(False)), F.get(polygons, i)).otherwise(corner(b)))
