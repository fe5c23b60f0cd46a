"""Incremental discovery: windows, cursors, first sightings, retries, quota, body indexing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import constants as K
from ..operators.retrieval import build_postings
from ..session import shared_folder
from ..sources.files import converted_bodies
from .runs import fold_batches, keep_batch, run_available

# ---- windows and cursors -------------------------------------------------------------------


def window_start(cursor: Column, now: Column) -> Column:
    """Where the next discovery begins: an hour before the cursor, at most a week back; without
    a cursor the source's default of three days."""
    back = lambda days=0, hours=0: F.make_dt_interval(F.lit(days), F.lit(hours))
    return F.when(cursor.isNull(), now - back(days=K.CURSOR_DEFAULT_DAYS)).otherwise(
        F.greatest(cursor - back(hours=K.CURSOR_OVERLAP_HOURS), now - back(days=K.CURSOR_MAX_DAYS))
    )


def advance_cursors(subscriptions: DataFrame, handled: DataFrame) -> DataFrame:
    """Cursor = latest publication among the *new* references, never backwards."""
    newest = (
        handled.where("claim = 'new'")
        .groupBy("subscription_id")
        .agg(F.max("published_at").alias("_newest"))
    )
    return (
        subscriptions.join(newest, "subscription_id", "left")
        .withColumn("cursor", F.greatest("cursor", "_newest"))
        .drop("_newest")
    )


# ---- first sightings -----------------------------------------------------------------------

REFERENCE = ["connector_id", "external_id"]


def first_sightings(stream: DataFrame, folder: str, checkpoint: str | None = None, every: int = 8) -> DataFrame:
    """Exact rule without a time bound: a reference counts once, however late it comes again.

    The state (key, first arrival, all sightings, first batch) lives in files and not in executors;
    see ``fold_batches`` for how it is compacted.
    """
    def shrink(batch: DataFrame, number: int) -> DataFrame:
        seen = batch.groupBy(*REFERENCE).agg(F.min("arrival").alias("arrival"), F.count("*").alias("sightings"))
        return seen.withColumn("first_batch", F.lit(number).cast("long"))

    merge = {"arrival": F.min, "sightings": F.sum, "first_batch": F.min}
    return fold_batches(stream.select(*REFERENCE, "arrival"), shrink, REFERENCE, merge, folder, checkpoint=checkpoint, every=every)


def running_cursors(stream: DataFrame, folder: str, checkpoint: str | None = None, every: int = 8) -> DataFrame:
    """Cursor of every subscription: the latest publication seen in any batch, never backwards.

    ``stream``: subscription_id, published_at of new references, in any order.
    """
    def shrink(batch: DataFrame, number: int) -> DataFrame:
        return batch.groupBy("subscription_id").agg(F.max("published_at").alias("cursor"))

    rows = stream.select("subscription_id", "published_at")
    return fold_batches(rows, shrink, ["subscription_id"], {"cursor": F.max}, folder, checkpoint=checkpoint, every=every)


def bounded_first_sightings(stream: DataFrame, at: str) -> DataFrame:
    """Bounded rule: state is dropped after the week the discovery window can reach back."""
    return stream.withWatermark(at, f"{K.CURSOR_MAX_DAYS} days").dropDuplicatesWithinWatermark(
        REFERENCE
    )


# ---- retries -------------------------------------------------------------------------------


def _outcome(streak: Column) -> list[Column]:
    """What the k-th failure in a row means; k = 0 is a success."""
    rounds = len(K.BACKOFF_SECONDS) + 1
    dead = (streak > 0) & (streak % rounds == 0)
    return [
        F.when(streak == 0, "run").when(dead, "dead_letter").otherwise("retry").alias("event"),
        (streak % rounds).cast("int").alias("attempt"),
        F.floor(streak / rounds).cast("int").alias("consecutive_failures"),
        (dead & (streak % (rounds * K.ALERT_EVERY) == 0)).alias("alert"),
    ]


def retry_states(log: DataFrame, carry: DataFrame | None = None) -> DataFrame:
    """State of the retry rule after every round, for a whole log at once.

    ``carry`` holds (subscription_id, streak) as earlier logs left it.

    The length of a failure streak is the distance to the last success. It is found per
    (subscription, day) first; one row per day then carries the last success forward, so a
    subscription with a third of all rounds is spread over its days.
    """
    placed = log.withColumn("_day", F.to_date("seen_at"))
    inside = W.partitionBy("subscription_id", "_day").orderBy("seen_at", "event_id")
    so_far = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = placed.withColumn("_pos", F.row_number().over(inside)).withColumn(
        "_last", F.max(F.when(~F.col("failed"), F.col("_pos"))).over(so_far)
    )
    days = placed.groupBy("subscription_id", "_day").agg(
        F.count("*").alias("_n"), F.max("_last").alias("_day_last")
    )
    earlier = W.partitionBy("subscription_id").orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        days.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .withColumn("_ok_before", F.max(F.col("_before") + F.col("_day_last")).over(earlier))
        .select("subscription_id", "_day", "_before", "_ok_before")
    )
    if carry is None:
        carried = carried.withColumn("_carry", F.lit(0))
    else:
        carried = carried.join(
            carry.select("subscription_id", F.col("streak").alias("_carry")), "subscription_id", "left"
        )
    # without a success so far the streak reaches back into the earlier logs
    streak = (
        F.col("_before")
        + F.col("_pos")
        - F.coalesce(F.col("_before") + F.col("_last"), F.col("_ok_before"), -F.col("_carry"), F.lit(0))
    )
    return (
        placed.join(carried, ["subscription_id", "_day"])
        .withColumn("streak", streak)
        .select(*log.columns, "streak", *_outcome(F.col("streak")))
    )


def next_run(event: Column, attempt: Column, at: Column, interval_hours: Column) -> Column:
    """After a success or a dead letter the regular interval, after a retry its back-off."""
    waits = F.array(*[F.lit(s) for s in K.BACKOFF_SECONDS])
    seconds = F.when(event == "retry", F.get(waits, attempt - 1)).otherwise(interval_hours * 3600)
    return at + F.make_dt_interval(secs=seconds)


def retry_stream(stream: DataFrame, folder: str, checkpoint: str | None = None) -> DataFrame:
    """The retry rule as a stream; batches come in time order.

    A batch is evaluated like a log, with the streaks the batch before left. Those are stored as a
    table per batch, so a subscription with a third of all rounds never meets in one task.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        read = lambda part, n: spark.read.parquet(f"{folder}/{part}/batch={n}")
        carry = read("carry", batch_id - 1) if batch_id > 0 else None
        keep_batch(retry_states(batch, carry), f"{folder}/states", batch_id)
        last = F.max_by("streak", F.struct("seen_at", "event_id")).alias("_last")
        left = read("states", batch_id).groupBy("subscription_id").agg(last)
        if carry is not None:
            left = left.join(carry, "subscription_id", "full_outer").withColumn(
                "_last", F.coalesce("_last", "streak")
            )
        keep_batch(left.select("subscription_id", F.col("_last").alias("streak")), f"{folder}/carry", batch_id)

    run_available(stream, handle, checkpoint=checkpoint)
    return stream.sparkSession.read.parquet(f"{folder}/states")


class RetryRule(StatefulProcessor):
    """Keeps one number per subscription: the failures in a row so far.

    The rounds one trigger brings for a subscription are ordered in memory, so the trigger bounds
    them (``files_per_batch``); :func:`retry_stream` has no such limit.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._streak = handle.getValueState("streak", "failures long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["seen_at", "event_id"])
        carried = self._streak.get()[0] if self._streak.exists() else 0
        place = np.arange(1, len(frame) + 1)
        last_success = np.maximum.accumulate(np.where(frame["failed"], -carried, place))
        frame["streak"] = place - last_success
        self._streak.update((int(frame["streak"].iloc[-1]),))
        yield frame[["event_id", "subscription_id", "streak"]]

    def close(self) -> None:
        pass


def stateful_retry_stream(
    stream: DataFrame, folder: str, checkpoint: str | None = None
) -> DataFrame:
    """The retry rule with keyed state instead of stored streaks, for short triggers."""
    spark = stream.sparkSession
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    states = stream.groupBy("subscription_id").transformWithStateInPandas(
        RetryRule(), "event_id long, subscription_id long, streak long", "Append", "None"
    )
    run_available(states, lambda batch, n: keep_batch(batch, folder, n), checkpoint=checkpoint)
    done = spark.read.parquet(folder)
    return done.select("event_id", "subscription_id", "streak", *_outcome(F.col("streak")))


# ---- quota ---------------------------------------------------------------------------------


def daily_quota(stream: DataFrame, at: str, downloads: str, folder: str, checkpoint: str | None = None) -> DataFrame:
    """Downloads per UTC day, however late they come: every batch adds its own sum per day."""

    def shrink(batch: DataFrame, number: int) -> DataFrame:
        days = batch.where(F.col(at).isNotNull()).groupBy(F.to_date(at).alias("day"))
        return days.agg(F.sum(downloads).alias("downloads"))

    return fold_batches(stream, shrink, ["day"], {"downloads": F.sum}, folder, checkpoint=checkpoint)


# ---- bodies to index -----------------------------------------------------------------------


def index_bodies(stream: DataFrame, folder: str, checkpoint: str | None = None) -> None:
    """Raw bodies (report_id, title, body, summary) -> gate, cleaning, postings, batch by batch.

    A batch stores the rejects, the reports it touched and their postings; nothing stored
    before is rewritten.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        gated = converted_bodies(batch, "body").drop("body")
        staged = shared_folder(batch.sparkSession, "cleaned")
        # cleaned once, read by three consumers
        gated.write.parquet(staged)
        rows = batch.sparkSession.read.parquet(staged)
        accepted = rows.where("error_code IS NULL")
        keep_batch(rows.where("error_code IS NOT NULL").select("report_id", "error_code", "chars_raw"), f"{folder}/rejects", batch_id)
        keep_batch(accepted.select("report_id", "chars_raw", "chars_cleaned"), f"{folder}/touched", batch_id)
        postings = build_postings(
            accepted.select(F.col("report_id").alias("id"), "title"),
            accepted.select("report_id", F.col("cleaned").alias("body")),
            accepted.select("report_id", "summary"),
        )
        keep_batch(postings.repartitionByRange("token", "report_id").sortWithinPartitions("token"), f"{folder}/postings", batch_id)

    run_available(stream, handle, checkpoint=checkpoint)


def current_postings(spark, folder: str) -> DataFrame:
    """Postings of the latest accepted body of every report."""
    newest = spark.read.parquet(f"{folder}/touched").groupBy("report_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{folder}/postings").join(newest, ["report_id", "batch"], "left_semi").drop("batch")
