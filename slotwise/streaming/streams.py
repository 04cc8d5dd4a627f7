"""Continuously kept results as Structured Streaming jobs.

Every job reads files as they arrive and stops when it has caught up (``availableNow``), so the
same job runs on a timer or, with another trigger, without end. Results written by
``foreachBatch`` go to a folder per batch that is replaced when the batch is repeated, which
makes each row count exactly once after a failure.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.clock import at
from ..operators.booking import CANCELLED_NOTICE, CONFIRMED_NOTICE
from .deltas import Levels

# Reservation states a state may change to; "" is a new reservation.
TRANSITIONS = {
    "": ("requested",),
    "requested": ("confirmed", "cancelled_by_user", "cancelled_by_shop"),
    "confirmed": ("completed", "cancelled_by_user", "cancelled_by_shop", "no_show"),
}
TERMINAL = ("completed", "cancelled_by_user", "cancelled_by_shop", "no_show")


def arriving(spark: SparkSession, folder: str, schema: StructType, moment: str, glob: str | None = None) -> DataFrame:
    """New files of a folder as a stream, with the event time as a zoned timestamp."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder).withColumn(moment, F.col(moment).cast("timestamp"))


# State grows with all ids that ever came, so it is kept on the executors' disks and not on their heap.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def start(spark: SparkSession, writer, checkpoint: str) -> StreamingQuery:
    """Start a stream that keeps its state as ``STATE`` says; a checkpoint that is there keeps the store that it has.

    A stream runs in a copy of the session's settings, so they are put back at once.
    """
    before = {key: spark.conf.get(key, None) for key in STATE}
    try:
        for key, value in STATE.items():
            spark.conf.set(key, value)
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


LEDGER_KEYS = "user_id LONG, moment TIMESTAMP_NTZ"
LEDGER_SUMS = "n LONG, total LONG, earned LONG, used LONG, pending LONG, usable LONG"


def ledger_deltas(ledger: DataFrame, sign: Column | None = None, closed: dt.datetime | None = None) -> DataFrame:
    """Ledger rows as changes of their user's sums, each with the moment from which it counts.

    Usable points are a difference array over time: plus where a row becomes usable, minus where it ends, so the
    balance at any moment is the sum of what lies before. What holds always has no moment. Moments up to
    ``closed`` are put there, too, where nobody will ask for a balance before that: per user one row is left for
    all that is over, and one for each moment to come.
    """
    amount, sign = F.coalesce("amount", F.lit(0)), F.lit(1) if sign is None else sign
    begins, ends, available = F.col("available_from"), F.col("expires_at"), F.col("status") == "available"
    counts = available & (begins.isNull() | ends.isNull() | (begins < ends))
    none = F.lit(0).cast("long")

    def change(moment: Column, usable: Column, **sums: Column) -> Column:
        if closed is not None:
            moment = F.when(moment > at(closed), moment)
        columns = {name: sums.get(name, none) for name in ("n", "total", "earned", "used", "pending")} | {"usable": usable}
        return F.struct(
            moment.cast("timestamp_ntz").alias("moment"),
            *[(F.coalesce(c, none) * sign).cast("long").alias(name) for name, c in columns.items()],
        )

    gained = F.when(amount > 0, amount)
    changes = F.array(
        change(
            F.lit(None), F.when(counts & begins.isNull(), amount), n=F.lit(1), total=F.when(available, gained), earned=gained,
            used=F.when(amount < 0, -amount), pending=F.when(F.col("status") == "pending", amount),
        ),
        F.when(counts & begins.isNotNull(), change(begins, amount)),
        F.when(counts & ends.isNotNull(), change(ends, -amount)),
    )
    return ledger.select("user_id", F.inline(F.array_compact(changes)))


def usable_sum(as_of: dt.datetime) -> Column:
    return F.coalesce(F.sum(F.when(F.col("moment").isNull() | (F.col("moment") <= at(as_of)), F.col("usable"))), F.lit(0))


def point_balance_deltas(ledger: DataFrame, target: str, checkpoint: str, closed: dt.datetime | None = None) -> StreamingQuery:
    """Point sums of each user from arriving ledger rows, kept in levels of deltas.

    This is money: a row counts however late it comes, and one sent again never counts twice, so all ids are kept
    as state, spread by id in the state store. With ``closed`` no balance before that moment can be asked for.
    """
    levels = Levels(ledger.sparkSession, target, LEDGER_KEYS, LEDGER_SUMS)

    def write(batch: DataFrame, number: int) -> None:
        levels.write(ledger_deltas(batch, closed=closed), number)

    return start(ledger.sparkSession, ledger.dropDuplicates(["id"]).writeStream.foreachBatch(write), checkpoint)


def point_balances_at(spark: SparkSession, target: str, as_of: dt.datetime) -> DataFrame:
    """Total and usable points of each user at a moment, from the kept sums."""
    return (
        Levels(spark, target, LEDGER_KEYS, LEDGER_SUMS).read().groupBy("user_id")
        .agg(F.sum("total").alias("total_points"), usable_sum(as_of).alias("available_points"), F.sum("n").alias("n"))
        .filter("n > 0").drop("n")
    )


EVENT_KEYS = "hour TIMESTAMP, event_type STRING"
EVENT_SUMS = "events LONG, value DOUBLE"


def event_counts(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Events per kind and hour, late ones included, kept in levels of deltas.

    No window is open or closed and the stream has no state: what a batch counted is added once.
    """
    levels = Levels(events.sparkSession, target, EVENT_KEYS, EVENT_SUMS)

    def write(batch: DataFrame, number: int) -> None:
        levels.write(batch.select(F.date_trunc("hour", "ts").alias("hour"), "event_type", F.lit(1).alias("events"), "value"), number)

    return start(events.sparkSession, events.writeStream.foreachBatch(write), checkpoint)


def event_counts_now(spark: SparkSession, target: str) -> DataFrame:
    """The count of every hour and kind."""
    return Levels(spark, target, EVENT_KEYS, EVENT_SUMS).read().groupBy("hour", "event_type").agg(
        F.sum("events").alias("events"), F.sum("value").alias("value")
    )


def status_log(changes: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Log of status changes with the state before each and whether the change is allowed.

    Changes: reservation_id, seq, new_status, changed_at. The states of open reservations are
    kept as a table that every batch reads and writes anew, so it holds open ones only; a last
    status ends the entry. Repeating batch ``n`` starts again from the table of ``n - 1``, so that
    one is kept and older ones are removed.
    """
    spark = changes.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        known = "reservation_id LONG, status STRING"
        before = (
            spark.read.schema(known).parquet(f"{target}/open/batch={number - 1}")
            if number > 0
            else spark.createDataFrame([], known)
        )
        judged = judge_changes(batch, before).persist()
        log = judged.select("reservation_id", F.inline("log"))
        log.write.mode("overwrite").parquet(f"{target}/log/batch={number}")
        untouched = before.join(judged.select("reservation_id"), "reservation_id", "left_anti")
        still_open = judged.filter(F.col("status") != "").select("reservation_id", "status")
        untouched.unionByName(still_open).write.mode("overwrite").parquet(f"{target}/open/batch={number}")
        judged.unpersist()
        _remove(spark, f"{target}/open/batch={number - 2}")

    return start(spark, changes.writeStream.foreachBatch(write), checkpoint)


def _remove(spark: SparkSession, folder: str) -> None:
    """Remove a folder in whatever file system it lies."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def judge_changes(changes: DataFrame, before: DataFrame) -> DataFrame:
    """Per reservation: its judged changes in order (``log``) and the state after them.

    The fold runs inside the JVM over the few changes of one reservation.
    """
    entry = "array<struct<seq:int,previous_status:string,new_status:string,accepted:boolean,changed_at:timestamp>>"
    queue = F.sort_array(F.collect_list(F.struct("changed_at", "seq", "new_status")))

    def allowed(state: Column, change: Column) -> Column:
        result = F.lit(False)
        for status, following in TRANSITIONS.items():
            result = result | ((state["status"] == status) & change["new_status"].isin(*following))
        return result

    def step(state: Column, change: Column) -> Column:
        ok = allowed(state, change)
        line = F.struct(
            change["seq"].cast("int").alias("seq"), state["status"].alias("previous_status"),
            change["new_status"].alias("new_status"), ok.alias("accepted"), change["changed_at"].alias("changed_at"),
        )
        after = F.when(ok, F.when(change["new_status"].isin(*TERMINAL), "").otherwise(change["new_status"])).otherwise(
            state["status"]
        )
        return F.struct(after.alias("status"), F.array_append(state["log"], line).cast(entry).alias("log"))

    return (
        changes.groupBy("reservation_id").agg(queue.alias("queue"))
        .join(before, "reservation_id", "left")
        .select(
            "reservation_id",
            F.aggregate(
                "queue",
                F.struct(F.coalesce("status", F.lit("")).alias("status"), F.array().cast(entry).alias("log")),
                step,
            ).alias("end"),
        )
        .select("reservation_id", "end.status", "end.log")
    )


def booking_notifications(
    actions: DataFrame, user_settings: DataFrame, target: str, checkpoint: str
) -> StreamingQuery:
    """Notices for confirmed and cancelled bookings to users who want them.

    Actions: id, reservation_id, user_id, action, created_at. Preferences are read as they stand
    when a batch runs. A late action is told like any other, one sent again only once.
    """
    wants = user_settings.filter(
        F.col("push_notifications_enabled") & F.col("reservation_notifications")
    ).select("user_id")
    confirmed = F.col("action") == "confirmed"
    notices = (
        actions.filter(F.col("action").isin("confirmed", "cancelled_by_shop"))
        .dropDuplicates(["id"])
        .join(wants, "user_id")
        .select(
            "user_id",
            F.when(confirmed, "reservation_confirmed").otherwise("reservation_cancelled").alias("notification_type"),
            F.when(confirmed, CONFIRMED_NOTICE[0]).otherwise(CANCELLED_NOTICE[0]).alias("title"),
            F.when(confirmed, CONFIRMED_NOTICE[1]).otherwise(CANCELLED_NOTICE[1]).alias("message"),
            F.lit("unread").alias("status"),
            F.col("reservation_id").alias("related_id"),
            "created_at",
        )
    )
    return start(actions.sparkSession, notices.writeStream.format("parquet").option("path", target).outputMode("append"), checkpoint)
