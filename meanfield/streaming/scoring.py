"""Scoring of arriving vectors against fixed centroids (an extension: the engine itself clusters finite tables)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from meanfield.operators.assign import classify


def score_stream(stream: DataFrame, c: np.ndarray, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes (id, cid, d2) of a stream of (id, v) to Parquet; the assignment is stateless, so output is appended once."""
    return classify(stream, c).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
