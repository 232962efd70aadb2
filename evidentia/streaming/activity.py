"""Structured Streaming twins of the timeline operators. On complete data they agree with the batch forms."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files that appear in a folder, at a bounded rate."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """subject_id, start, n: activity buckets; rows later than the watermark are left out."""
    return events.withWatermark("observed_at", late).groupBy(F.window("observed_at", size), "subject_id").agg(F.count(F.lit(1)).alias("n")).select("subject_id", F.col("window.start").alias("start"), "n")


def sliding(events: DataFrame, size: str = "7 days", every: str = "1 day", late: str = "1 day") -> DataFrame:
    return events.withWatermark("observed_at", late).groupBy(F.window("observed_at", size, every), "subject_id").agg(F.count(F.lit(1)).alias("n")).select("subject_id", F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return events.withWatermark("observed_at", late).groupBy(F.session_window("observed_at", gap), "subject_id").agg(F.count(F.lit(1)).alias("n")).select("subject_id", F.col("session_window.start").alias("start"), "n")


def confirmed_states(events: DataFrame, persist: int = 2) -> DataFrame:
    """subject_id, event_id, before, after: confirmed state changes of events that arrive in order within a subject.
    The state is the confirmed value and the values still waiting, persist - 1 at most and their ids."""
    kind = events.schema["event_id"].dataType.simpleString()
    subject = events.schema["subject_id"].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, waiting = json.loads(state.get[0]) if state.exists else (None, [])
        out = []
        rows = pd.concat(list(batches)).sort_values(["observed_at", "event_id"])
        for event, value in zip(rows["event_id"], rows["value"], strict=True):
            waiting.append([int(event), value])
            while len(waiting) >= persist or held is None:
                first, v = waiting.pop(0)
                if held is None:
                    held = v
                elif v != held and all(w == v for _, w in waiting[: persist - 1]):
                    out.append((key[0], first, held, v))
                    held = v
                if not waiting:
                    break
        state.update((json.dumps([held, waiting]),))
        yield pd.DataFrame(out, columns=["subject_id", "event_id", "before", "after"])

    return events.groupBy("subject_id").applyInPandasWithState(step, f"subject_id {subject}, event_id {kind}, before string, after string", "state string", "append", GroupStateTimeout.NoTimeout)


def live_snapshot(events: DataFrame, recompute: Callable[[DataFrame, int], None], every: str = "2 seconds", checkpoint: str | None = None) -> StreamingQuery:
    """Calls recompute for every micro-batch that brought something."""

    def push(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            recompute(batch, epoch)

    w: DataStreamWriter = events.writeStream.foreachBatch(push).trigger(processingTime=every)
    return (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
