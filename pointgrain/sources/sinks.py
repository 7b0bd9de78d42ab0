"""Writers with provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointgrain.operators.profile import content_fingerprint
from pointgrain.sources.tables import CONTRACT_VERSION, STATE_COLUMNS


def write_subset(df: DataFrame, path: str, seed: int) -> None:
    """State rows as Parquet beside a manifest of one row: contract version, seed, row count and fingerprint."""
    df.write.parquet(f"{path}/rows")
    written = df.sparkSession.read.parquet(f"{path}/rows")
    manifest = content_fingerprint(written, STATE_COLUMNS).withColumns({"contract_version": F.lit(CONTRACT_VERSION), "seed": F.lit(seed)})
    manifest.coalesce(1).write.json(f"{path}/manifest")  # one row


def write_history(df: DataFrame, path: str) -> None:
    """Training history as JSON lines, one for each epoch."""
    df.write.json(path)
