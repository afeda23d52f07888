"""Frozen plans on streams: cleaning and preprocessing are projections and filters, so the same plan serves a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tabforge.operators import clean
from tabforge.operators.preprocess import Preprocessing


def prepared_stream(stream: DataFrame, plan: clean.CleanPlan | None = None, steps: Preprocessing | None = None) -> DataFrame:
    """stream put through a fitted cleaning plan and fitted transforms; no state is kept, late rows are treated like others."""
    out = stream if plan is None else clean.apply(stream, plan)
    return out if steps is None else steps.transform(out)


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Parquet files by an exactly-once sink; everything at hand is written, then the query ends."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
