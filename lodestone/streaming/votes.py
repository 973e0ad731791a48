"""Reviews as they arrive: decision counts over a stream of votes, changed, repeated and late ones included."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestone.functions.text import map_decision

VOTES = "qa_id string, rater string, decision string, at timestamp"
#: transformWithState keeps its state in this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_votes(spark: SparkSession, folder: str, files_at_once: int = 16) -> DataFrame:
    """A stream of the JSON line files that come into folder."""
    return spark.readStream.schema(VOTES).option("maxFilesPerTrigger", files_at_once).json(folder)


class LastVote(StatefulProcessor):
    """The last vote of each rater on a record, by its own time. A new last vote with another decision takes the old one back."""

    def __init__(self, kept_ms: int):
        self.kept_ms = kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "decision string, at_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else None
        best = held
        for part in rows:
            for decision, at in zip(part["decision"], part["at_ms"]):
                if best is None or (at, decision) > (best[1], best[0]):
                    best = (decision, int(at))
        if best != held:
            self.last.update(best)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(best[1] + self.kept_ms)
        changes = [] if best == held or held and held[0] == best[0] else [(key[0], best[0], 1)] + ([(key[0], held[0], -1)] if held else [])
        yield pd.DataFrame(changes, columns=["qa_id", "decision", "n"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """No vote older than the last one can come any more: what is counted stays, and the state goes."""
        self.last.clear()
        yield pd.DataFrame([], columns=["qa_id", "decision", "n"])

    def close(self) -> None:
        pass


def decision_changes(votes: DataFrame, late_hours: int = 24, kept_hours: int = 24 * 30) -> DataFrame:
    """(qa_id, decision, n) of a stream of votes: n is 1 for a decision that becomes a rater's last one, and -1 for the one that it replaces.

    Votes out of order do not replace later ones; those late by more than late_hours are dropped; skips and unknown words
    do not count. A rater's vote can be changed for kept_hours of event time after it; then a timer drops the state. The
    session must keep state in RocksDB (STORE).
    """
    own = votes.withColumn("decision", map_decision(F.col("decision"))).where("decision NOT IN ('', 'skip') AND at IS NOT NULL").withWatermark("at", f"{late_hours} hours")
    own = own.select("qa_id", "rater", "decision", "at", F.unix_millis("at").alias("at_ms"))
    return own.groupBy("qa_id", "rater").transformWithStateInPandas(LastVote(kept_hours * 3_600_000), "qa_id string, decision string, n int", "Update", "EventTime")


def decision_counts(changes: DataFrame) -> DataFrame:
    """(qa_id, decision, n) of the changes so far, for decisions that any rater still holds."""
    return changes.groupBy("qa_id", "decision").agg(F.sum("n").alias("n")).where("n > 0")
