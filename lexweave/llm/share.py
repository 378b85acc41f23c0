"""Objects of this package sent to all workers with their code."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import SparkSession


class Shared:
    """A broadcast object; unpickled once per task."""

    def __init__(self, broadcast) -> None:
        self._broadcast, self._held = broadcast, None

    def __getstate__(self):
        return {"_broadcast": self._broadcast, "_held": None}

    @property
    def value(self):
        if self._held is None:
            self._held = cloudpickle.loads(self._broadcast.value)
        return self._held


def share(spark: SparkSession, obj) -> Shared:
    """Broadcast an object whose class executors needn't have; its size must be bounded."""
    return Shared(spark.sparkContext.broadcast(cloudpickle.dumps(obj)))
