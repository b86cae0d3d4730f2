"""All registered queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from agrispark.plans import (
    advice_queries, corpus_queries, message_queries, sequence_queries, store_queries, stream_queries, telemetry_queries,
)

FAMILIES = [telemetry_queries, advice_queries, sequence_queries, corpus_queries, message_queries, stream_queries, store_queries]


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for family in FAMILIES:
        out.update(family.QUERIES)
    return out
