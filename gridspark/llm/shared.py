"""Models built once on the driver and unpacked once per Python worker."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import SparkSession


def broadcast_model(spark: SparkSession, model: Any) -> Callable[[], Any]:
    """A function that gives the model on an executor.

    It travels as bytes, as a broadcast value is otherwise pickled by reference to this package, which executors may not
    have. A worker keeps the last model it unpacked, so tasks that follow one another don't unpack it again.
    """
    sent, name = spark.sparkContext.broadcast(cloudpickle.dumps(model)), uuid.uuid4().hex

    def get() -> Any:
        import sys

        from pyspark import cloudpickle

        kept = sys.__dict__.setdefault("_gridspark_model", [None, None])
        if kept[0] != name:
            kept[:] = [name, cloudpickle.loads(sent.value)]
        return kept[1]

    return get
