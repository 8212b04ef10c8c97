"""Keyed state machines on a stream: rollout control and stage-history legality.

These two need arbitrary state per key, which no built-in aggregate expresses. State is a few values per
model version, held in the RocksDB state store; Spark partitions and checkpoints it. A micro-batch is
ordered per key in memory, so bound it at the source (``maxFilesPerTrigger``, ``maxBytesPerTrigger``);
for whole histories use the batch forms, which split a hot key into blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from wardline.operators.evidence import STAGE_EDGES
from wardline.operators.release import SHARES

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROLLOUT_SCHEMA = "version string, seq long, stage string, canary_share double, rollback_reason string"
HISTORY_SCHEMA = "model string, seq long, stage string, previous_stage string, is_legal boolean"


class RolloutProcessor(StatefulProcessor):
    """Shadow, then each share in order; the first failed checkpoint rolls back and ends the rollout."""

    def __init__(self, shares: Sequence[float] = SHARES) -> None:
        self.shares = tuple(shares)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("rollout", "stage string, passed int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stage, passed = self.state.get() if self.state.exists() else ("SHADOW", 0)
        batch = pd.concat(list(rows)).sort_values("seq")
        out = []
        for row in batch.itertuples():
            if stage not in ("SHADOW", "CANARY"):
                break
            reason = None
            if not row.passed:
                stage, share, reason = "STAGING", 0.0, row.reason
            else:
                passed += 1
                done = passed > len(self.shares)
                stage, share = ("PRODUCTION", 1.0) if done else ("CANARY", self.shares[passed - 1])
            out.append((key[0], int(row.seq), stage, share, reason))
        self.state.update((stage, passed))
        names = [f.split()[0] for f in ROLLOUT_SCHEMA.split(", ")]
        yield pd.DataFrame(out, columns=names)

    def close(self) -> None:
        pass


class StageHistoryProcessor(StatefulProcessor):
    """Flags stage moves that follow no legal edge. Micro-batches arrive in order; rows are ordered inside."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("stage", "stage string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.state.get()[0] if self.state.exists() else None
        batch = pd.concat(list(rows)).sort_values("seq")
        out = []
        for row in batch.itertuples():
            legal = row.stage == "REGISTERED" if before is None else row.stage in STAGE_EDGES.get(before, [])
            out.append((key[0], int(row.seq), row.stage, before, bool(legal)))
            before = row.stage
        self.state.update((before,))
        names = [f.split()[0] for f in HISTORY_SCHEMA.split(", ")]
        yield pd.DataFrame(out, columns=names)

    def close(self) -> None:
        pass


def _schema(text: str) -> StructType:
    return StructType.fromDDL(text)


def rollout(checkpoints: DataFrame, shares: Sequence[float] = SHARES) -> DataFrame:
    """Stream of (version, seq, passed, reason) -> one row per accepted checkpoint."""
    return checkpoints.groupBy("version").transformWithStateInPandas(
        statefulProcessor=RolloutProcessor(shares), outputStructType=_schema(ROLLOUT_SCHEMA), outputMode="Append", timeMode="None"
    )


def stage_history(history: DataFrame) -> DataFrame:
    """Stream of (model, seq, stage) -> the same rows with the previous stage and its legality."""
    return history.groupBy("model").transformWithStateInPandas(
        statefulProcessor=StageHistoryProcessor(), outputStructType=_schema(HISTORY_SCHEMA), outputMode="Append", timeMode="None"
    )
