"""Review decisions as a stream into the ledger; the rules are the batch ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tasksieve.operators.ledger import ReviewLedger


class DecisionStream:
    """Stores each micro-batch as batch ``<name>-<n>`` of the ledger's one log, beside what ``record`` stores.

    A batch that is run again after a failure changes nothing, so every decision is stored once. An event delivered again in
    a later batch is recognized by its event_id in the ledger's index, whatever its other fields; with ``watermark``
    (say "1 day") the stream also drops repeats by bounded state, at the price of dropping events later than that.
    ``name`` must differ between streams with checkpoints of their own.
    """

    def __init__(self, ledger: ReviewLedger, checkpoint: str, watermark: str | None = None, name: str = "stream") -> None:
        self.ledger = ledger
        self.checkpoint = checkpoint
        self.watermark = watermark
        self.name = name

    def _store(self, batch: DataFrame, batch_id: int) -> None:
        # Read twice, for the ids' prefixes and for the rows.
        rows = batch.persist()
        try:
            self.ledger.store(rows, f"{self.name}-{batch_id}")
        finally:
            rows.unpersist()

    def start(self, decisions: DataFrame, available_now: bool = True, every: str = "1 minute") -> StreamingQuery:
        rows = decisions
        if self.watermark:
            rows = rows.withWatermark("created_at", self.watermark).dropDuplicatesWithinWatermark(["event_id"])
        trigger = {"availableNow": True} if available_now else {"processingTime": every}
        return (
            rows.writeStream.foreachBatch(self._store).option("checkpointLocation", self.checkpoint)
            .trigger(**trigger).start()
        )
