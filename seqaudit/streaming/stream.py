"""Continuous intake: validation, outcome import, duplicate detection and an error monitor.

Every function takes a streaming DataFrame and returns either a streaming DataFrame or
a started query. Sinks written from ``foreachBatch`` use one folder per batch id, so a
batch that is retried after a failure replaces its own output.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.values import parse_float
from ..operators import campaigns, ingest


def start_validation(rows: DataFrame, accepted_path: str, rejected_path: str, checkpoint: str, **options) -> StreamingQuery:
    """Validate arriving rows into an accepted and a rejected table."""
    def write(batch: DataFrame, batch_id: int) -> None:
        judged = ingest.validate_rows(batch, **options).persist()
        ingest.accepted(judged).write.mode("overwrite").parquet(f"{accepted_path}/batch={batch_id}")
        judged.where("reason IS NOT NULL").write.mode("overwrite").parquet(f"{rejected_path}/batch={batch_id}")
        judged.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_outcome_import(outcomes: DataFrame, selections: DataFrame, rounds: DataFrame, store_path: str, rejected_path: str,
                         checkpoint: str) -> StreamingQuery:
    """Check arriving outcomes against the locked selections and keep the accepted versions.

    Accepted rows are appended per batch with their arrival order; ``current_outcomes``
    reads the last version per key, so an import never rewrites the stored table.
    """
    key = ["round_id", "candidate_id"]

    def write(batch: DataFrame, batch_id: int) -> None:
        judged = campaigns.outcome_problems(batch, selections, rounds, key).persist()
        good = judged.where("problem IS NULL").withColumn("measured_value", parse_float("measured_value"))
        good.drop("problem").write.mode("overwrite").parquet(f"{store_path}/batch={batch_id}")
        judged.where("problem IS NOT NULL").write.mode("overwrite").parquet(f"{rejected_path}/batch={batch_id}")
        judged.unpersist()

    return outcomes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_outcomes(store: DataFrame, order_col: str) -> DataFrame:
    """Last imported version of each (round, candidate, replicate)."""
    key = ["round_id", "candidate_id", "replicate"]
    rest = [c for c in store.columns if c not in key]
    newest = F.max_by(F.struct(*rest), F.struct("batch", order_col, *rest))
    return store.groupBy(*key).agg(newest.alias("r")).select(*key, *[f"r.{c}" for c in rest])


def distinct_sequences(rows: DataFrame, hash_col: str, time_col: str, delay: str) -> DataFrame:
    """First copy of each sequence; state older than the watermark is dropped."""
    return rows.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([hash_col])


class EarliestLabel(StatefulProcessor):
    """Compares the copies of a sequence with the label of its earliest copy, in event time.

    Arriving copies wait in a list until the watermark passes their time; they are then taken in
    the order (time, row id), whatever order or batch they came in. The first opens a span of
    ``keep_ms``; later copies inside it are reported, the first one behind it opens the next.
    Each access to the state is a call to the JVM: a span the watermark has passed already is neither
    stored nor given a timer, and lists and values are read without asking first whether they are there.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "at long, target string")
        self.waiting = handle.getListState("waiting", "at long, row_id long, target string")

    def handleInputRows(self, key, rows, timerValues):
        for pdf in rows:
            at = pdf["seen_at"].astype("datetime64[ms]").astype("int64").tolist()
            target = [None if pd.isna(t) else t for t in pdf["target"]]
            self.waiting.appendList(list(zip(at, pdf["row_id"].tolist(), target)))
            for time in set(at):
                self.handle.registerTimer(time)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.waiting.get()]
        due = sorted((r for r in held if r[0] <= passed), key=lambda r: (r[0], r[1], r[2] is not None, r[2] or ""))
        if due:
            rest = [r for r in held if r[0] > passed]
            self.waiting.put(rest) if rest else self.waiting.clear()
        stored = self.first.get()
        first = kept = tuple(stored) if stored is not None else None
        out = []
        for at, row_id, target in due:
            if first is None or at > first[0] + self.keep_ms:
                first = (at, target)
            else:
                out.append((key[0], row_id, target, target != first[1]))
        if first and passed > first[0] + self.keep_ms:
            if kept:
                self.first.clear()
        elif first != kept:
            self.first.update(first)
            self.handle.registerTimer(first[0] + self.keep_ms + 1)
        if out:
            yield pd.DataFrame(out, columns=["sequence_hash", "row_id", "target", "conflict"])

    def close(self) -> None:
        pass


def label_conflicts(rows: DataFrame, time_col: str, delay: str, keep_ms: int) -> DataFrame:
    """(sequence_hash, row_id, target, conflict) for every later copy of a sequence, in event time.

    A copy is judged once the watermark of ``time_col`` has passed it; rows that come later than
    ``delay`` are dropped by the watermark, and apart from these the result does not depend on how
    rows are cut into batches or ordered in them. The earliest label counts for ``keep_ms``.
    """
    if keep_ms <= 0:
        raise ValueError("the state needs an expiry")
    narrow = rows.select("sequence_hash", "row_id", F.col("target").cast("string").alias("target"), F.col(time_col).alias("seen_at"))
    return narrow.withWatermark("seen_at", delay).groupBy("sequence_hash").transformWithStateInPandas(
        EarliestLabel(keep_ms), "sequence_hash string, row_id long, target string, conflict boolean", "Append", "EventTime")


def error_monitor(rows: DataFrame, time_col: str, slice_col: str, error: Column, width: str, delay: str) -> DataFrame:
    """Count, mean absolute error and bias per tumbling window and slice."""
    e = F.col("e")
    return (
        rows.withColumn("e", error).withWatermark(time_col, delay).groupBy(F.window(time_col, width).alias("w"), slice_col)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"))
        .select(F.col("w.start").alias("start"), slice_col, "n", "mae", "bias"))
