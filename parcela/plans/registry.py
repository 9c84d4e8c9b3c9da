"""``name -> query`` for every operator outside ``llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import changes, ingest, market, scanning, streams
from .market import flagship

__all__ = ["QUERIES", "flagship"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**market.QUERIES, **changes.QUERIES, **scanning.QUERIES, **ingest.QUERIES, **streams.QUERIES}
