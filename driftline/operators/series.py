"""Series in Arrow batches: a task gets the rows of many series in order and works them off batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Gets the columns of some whole series and the rows where each begins and the last one ends; gives new columns by name,
#: and under the name None, where it gives it, which rows stay.
Work = Callable[[pa.Table, np.ndarray], dict]


def numbers(table: pa.Table, names: list[str]) -> np.ndarray:
    """Columns of a table as one matrix of doubles, nulls as NaN."""
    return np.stack([table.column(n).cast(pa.float64()).to_numpy() for n in names], axis=1)


def map_series(df: DataFrame, keys: list[str], order: list[str | Column], work: Work, new: list[T.StructField], drop: list[str] | None = None) -> DataFrame:
    """``df`` without ``drop`` and with the columns ``new`` that ``work`` makes of the series of ``keys``, each in ``order``.

    The number of partitions is given, so that AQE does not put small tables of much work into one task. Rows wait for the
    rest of their series, so a task holds a batch and the longest series.
    """
    kept = [f for f in df.schema.fields if f.name not in (drop or [])]
    schema = T.StructType([*kept, *new])
    kinds = {f.name: to_arrow_type(f.dataType) for f in new}

    def ready(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table.column("_series").to_numpy()
        starts = np.r_[0, np.flatnonzero(ids[1:] != ids[:-1]) + 1, len(ids)]
        made = work(table, starts)
        columns = [table.column(f.name) for f in kept] + [made[n] if isinstance(made[n], (pa.Array, pa.ChunkedArray)) else pa.array(made[n], kind, from_pandas=kind == pa.int32()) for n, kind in kinds.items()]
        out = pa.Table.from_arrays(columns, names=[f.name for f in schema.fields])
        if None in made:
            out = out.filter(pa.array(made[None]))
        yield from out.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(batch.schema.get_field_index("_series")).to_numpy()
            change = np.flatnonzero(ids[1:] != ids[:-1])
            ongoing = held and held[-1].column(batch.schema.get_field_index("_series"))[-1].as_py() == ids[0]
            if len(change) or not ongoing:
                cut = int(change[-1]) + 1 if len(change) else 0
                if cut:
                    held.append(batch.slice(0, cut))
                if held:
                    yield from ready(held)
                held, batch = [], batch.slice(cut)
            held.append(batch)
        if held:
            yield from ready(held)

    rows = df.withColumn("_series", F.xxhash64(*keys) if keys else F.lit(0).cast("long"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, *keys) if keys else rows.repartition(1)
    return rows.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
