"""Frame functions: numpy kernels over array columns, applied batch by batch through Arrow.

A frame (spectrum or block of samples) is one row with array columns.  :func:`map_frames` stacks the
rows of an Arrow batch that have equal length into a matrix, so a kernel runs once for many rows, and
frames never need a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def _rows(column: pa.Array) -> list[np.ndarray | None]:
    values = column.flatten().to_numpy(zero_copy_only=False)
    out, at = [], 0
    for n in column.value_lengths().to_pylist():
        if n is None:
            out.append(None)
            continue
        out.append(values[at : at + n])
        at += n
    return out


def map_frames(df: DataFrame, kernel: Callable[..., Sequence], inputs: Sequence[str], outputs: str, keep: Sequence[str]) -> DataFrame:
    """Columns ``keep`` and what ``kernel`` makes of ``inputs``.

    ``kernel`` gets one matrix (rows, length) for each input and returns one value for each column of
    ``outputs`` (a DDL string): an array with a row for each frame, or a list of Python values.  Frames with
    a null or empty input have null outputs.
    """
    made = StructType.fromDDL(outputs)
    types = [to_arrow_type(f.dataType) for f in made.fields]
    kept = [df.schema[c] for c in keep]
    schema = StructType([*kept, *made.fields])
    names = schema.names

    def run(batches):
        for b in batches:
            columns = [_rows(b.column(len(keep) + k)) for k in range(len(inputs))]
            results: list[list] = [[None] * b.num_rows for _ in types]
            groups: dict[tuple, list[int]] = {}
            for r, row in enumerate(zip(*columns)):
                if all(x is not None and len(x) for x in row):
                    groups.setdefault(tuple(len(x) for x in row), []).append(r)
            for members in groups.values():
                made_here = kernel(*(np.stack([c[r] for r in members]).astype(float) for c in columns))
                for out, values in zip(results, made_here):
                    values = values.tolist() if isinstance(values, np.ndarray) else values
                    for r, v in zip(members, values):
                        out[r] = v
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(pa.array(v, t) for v, t in zip(results, types))], names=names)

    return df.select(*keep, *inputs).mapInArrow(run, schema)


def per_row(df: DataFrame, kernel: Callable[..., tuple], inputs: tuple[str, ...], outputs: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep``, ``outputs`` and ``error``: the kernel's values for each row, or nulls and the reason it gives in a ValueError.

    Array inputs come as numpy arrays; null inputs are an error.
    """
    made = StructType.fromDDL(f"{outputs}, error string")
    schema = StructType([*(df.schema[c] for c in keep), *made.fields])
    kinds, names = [to_arrow_type(f.dataType) for f in made.fields], schema.names

    def run(batches):
        for b in batches:
            rows = []
            for values in zip(*(b.column(len(keep) + k) for k in range(len(inputs)))):
                try:
                    if not all(v.is_valid for v in values):
                        raise ValueError("null input")
                    rows.append((*kernel(*(np.array(v.values) if isinstance(v, pa.ListScalar) else v.as_py() for v in values)), None))
                except ValueError as e:
                    rows.append((*[None] * (len(made) - 1), str(e)))
            columns = list(zip(*rows)) or [()] * len(made)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(pa.array(c, t) for c, t in zip(columns, kinds))], names=names)

    return df.select(*keep, *inputs).mapInArrow(run, schema)
