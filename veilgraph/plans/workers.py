"""Letting Python workers import this library wherever the driver started."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def reach_package(spark: SparkSession) -> None:
    """Puts the library's folder on the workers' path for what is planned
    from now on. Where it is installed, this changes nothing."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def reaching(f: Callable) -> Callable:
    """f(spark, ...), with the package in the workers' reach."""

    @wraps(f)
    def call(spark: SparkSession, *args, **named):
        reach_package(spark)
        return f(spark, *args, **named)

    return call
