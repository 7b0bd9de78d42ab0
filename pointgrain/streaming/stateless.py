"""The row-wise operators on streams. They hold no state, so they take a streaming DataFrame as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pointgrain.functions.expressions import view_forward, view_log_jacobian
from pointgrain.operators.contracts import reasons


def checked_features(stream: DataFrame, view: str = "slope") -> DataFrame:
    """Each state row with its broken checks, its view features and its log-Jacobian."""
    cells = {f"f_{n}": c for n, c in view_forward(view).items()}
    return stream.withColumns({"reasons": reasons(), **cells, "log_jacobian": view_log_jacobian(view, stream["pz"])})


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there to Parquet and stops; a restart goes on where the checkpoint says."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
