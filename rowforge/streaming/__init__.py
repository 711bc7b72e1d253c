"""The same stages on streams: predicates, transforms and rules are Columns, so a stream takes them as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.text import json_lines
from ..operators.stages import Stages, staged


def stream_stages(df: DataFrame, stages: Stages) -> DataFrame:
    """A streaming DataFrame through filters, transforms and rules."""
    return staged(df, stages)[0]


def write_json(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Start a query that appends canonical JSON lines to a folder."""
    return json_lines(df).writeStream.format("text").option("checkpointLocation", checkpoint).outputMode("append").start(out)
