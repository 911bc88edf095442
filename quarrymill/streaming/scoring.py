"""Scoring streams: the fitted transform is a projection, so it needs no state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.preprocess import AutoPreprocessor


def transform_stream(preprocessor: AutoPreprocessor, stream: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return preprocessor.transform(stream, keep)


def write_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what the source has now, once, and ends; the checkpoint makes a repeated call go on from there."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
