"""The ratchet over a stream: each batch of findings is compared with the baseline as it stands then."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftline.operators.ratchet import new_findings, with_fingerprint


def watch(findings: DataFrame, baseline: Callable[[SparkSession], DataFrame], sink: str, checkpoint: str):
    """Start a query that appends new findings of a streaming DataFrame as Parquet below ``sink``, a folder for each batch.

    A batch that is repeated after a failure overwrites its own folder, so that results count once.
    """

    def handle(batch: DataFrame, number: int) -> None:
        new = new_findings(with_fingerprint(batch), baseline(batch.sparkSession))
        new.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return findings.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
