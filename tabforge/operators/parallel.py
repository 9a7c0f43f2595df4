"""Independent Spark jobs side by side."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target

PARALLEL_JOBS = 4


def in_parallel(spark, function: Callable, items: Sequence) -> list:
    """Runs independent Spark jobs side by side, results in the order of ``items``."""
    with ThreadPoolExecutor(PARALLEL_JOBS) as pool:
        run = inheritable_thread_target(spark)(function)
        return list(pool.map(run, items))
