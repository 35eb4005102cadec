"""What the training-data operators share: Arrow kernels over whole partitions and a per-process model cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from wfscan.session import ship_package, spread

_CACHE: dict = {}


def cached(key: str, build: Callable[[], object]) -> object:
    """One model per Python worker, whatever number of tasks it runs."""
    if key not in _CACHE:
        if len(_CACHE) > 16:
            _CACHE.clear()
        _CACHE[key] = build()
    return _CACHE[key]


def map_arrow(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply `kernel` to each Arrow batch; batches that give None are dropped."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = kernel(b)
            if out is not None and out.num_rows:
                yield out

    return spread(df).mapInArrow(run, schema)
