"""Models in broadcast variables, and tasks that leave no memory behind."""

from __future__ import annotations

import ctypes
import gc
import pickle

from pyspark import cloudpickle


def share(spark, model):
    """A function that gives a task the broadcast ``model``. Its class travels with it, so executors need not have this package."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    return lambda: pickle.loads(held.value)


def released(task):
    """``task`` (batches -> batches), whose worker gives free memory back to the system when it has ended.

    Spark reuses Python workers, and allocators keep what a large task freed; without this an executor's memory is the sum of its
    workers' largest tasks, stage after stage.
    """

    def run(batches):
        yield from task(batches)
        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return run
