"""Scoring of samples that arrive as a stream; stateless, so it needs no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pixelloom.operators.mlp import MLP, classified, score_blocks


def scored_stream(samples: DataFrame, model: MLP, data: str = "data") -> DataFrame:
    """A stream of samples with pred."""
    return classified(score_blocks(samples, model, data))


def write_scores(samples: DataFrame, model: MLP, path: str, checkpoint: str, data: str = "data") -> StreamingQuery:
    """Appends scored samples to Parquet files, each exactly once, and stops when the input at hand is done."""
    return scored_stream(samples, model, data).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
