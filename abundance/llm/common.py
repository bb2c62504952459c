"""Helpers shared by the operators: Arrow row mapping, a per-worker store and
the whitespace that separates words."""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Words are runs of characters outside this class (space, \t \n \v \f \r).
SPACE_CLASS = r"[ \t-\r]"
SLICE = 500  # rows that a row-wise function sees at a time


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_clashes(df: DataFrame, names) -> DataFrame:
    """Drop input columns whose names (any case) an operator is about to add."""
    low = {n.lower() for n in names}
    gone = [c for c in df.columns if c.lower() in low]
    return df.drop(*gone) if gone else df


def worker_store() -> dict:
    """A dict that lives as long as the Python worker, so that tables built
    from a broadcast are made once per worker and not once per task (functions
    of this package reach workers by value and have no lasting globals)."""
    return vars(sys).setdefault("_abundance_worker_store", {})


def map_rows(df: DataFrame, column: str, fields: list[T.StructField], make, group_bytes: int = 0) -> DataFrame:
    """Add ``fields`` computed from one column by a function on Arrow arrays.

    ``make()`` runs once per task and returns ``f(array) -> list of arrays``
    (one per field); an attribute ``f.done`` is called when the task ends. All other columns pass through; input columns that have
    the name of a new field are replaced. No shuffle. ``group_bytes``: ``f``
    sees batches joined up to about that size instead of small slices, for
    functions that cost much per call.
    """
    names = {f.name.lower() for f in fields}
    keep = [c for c in df.columns if c.lower() not in names]
    source = df.select(*keep, F.col(column).alias("__in")) if column not in keep else df.select(*keep)
    inner = column if column in keep else "__in"
    schema = T.StructType([f for f in source.schema.fields if f.name != "__in"] + fields)
    new = [f.name for f in fields]

    def run(batches):
        import pyarrow as pa

        f = make()

        def joined():
            some, size = [], 0
            for b in batches:
                some.append(b)
                size += b.nbytes
                if size >= group_bytes:
                    yield from pa.Table.from_batches(some).combine_chunks().to_batches()
                    some, size = [], 0
            if some:
                yield from pa.Table.from_batches(some).combine_chunks().to_batches()

        for whole in joined() if group_bytes else batches:
            step = max(whole.num_rows, 1) if group_bytes else SLICE  # small pieces bound the memory of inputs and results
            for k in range(0, whole.num_rows, step):
                b = whole.slice(k, step)
                out = f(b.column(b.schema.names.index(inner)))
                old = [(n, b.column(i)) for i, n in enumerate(b.schema.names) if n != "__in"]
                yield pa.RecordBatch.from_arrays([c for _, c in old] + list(out), names=[n for n, _ in old] + new)
        getattr(f, "done", bool)()

    return source.mapInArrow(run, schema)


def as_bytes(array) -> list:
    """An Arrow string column as Python bytes (None for null) without decoding."""
    import pyarrow as pa

    wide = pa.types.is_large_string(array.type)
    return array.cast(pa.large_binary() if wide else pa.binary()).to_pylist()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hashed_bucket(n: int, *cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def run_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Indices at which a new value begins in a sorted array."""
    if len(sorted_keys) == 0:
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
