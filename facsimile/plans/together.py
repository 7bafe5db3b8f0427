"""Independent Spark jobs side by side."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def together(spark: SparkSession, **tasks: Callable) -> dict:
    """Run independent steps of a plan at once, so that small ones fill the gaps of large ones."""
    with ThreadPoolExecutor(max_workers=len(tasks)) as pool:
        running = {name: pool.submit(inheritable_thread_target(spark)(task)) for name, task in tasks.items()}
        return {name: future.result() for name, future in running.items()}
