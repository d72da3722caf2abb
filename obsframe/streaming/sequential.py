"""Keyed ingest, stage completion with timers, and a model that learns batch by batch.

Every micro-batch writes what it adds under its own batch number and reads only lower numbers, so a
batch that is run again after a failure replaces its own output and nothing else.
"""

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from obsframe import layout as L
from obsframe.operators import staged as G
from obsframe.session import cut_lineage
from obsframe.sources.writers import new_rows

KEYS = ("entity_id", "obs_date")


# -- keyed store --------------------------------------------------------------


def month_of(date: str = "obs_date") -> Column:
    return F.date_format(date, "yyyy-MM")


def stored_rows(spark: SparkSession, store: str, schema, months: list[str] | None = None, before: int | None = None) -> DataFrame:
    """Rows of a keyed store; with months or a batch number, only those partitions are read."""
    rows = spark.read.schema(f"{schema_ddl(schema)}, obs_month string, batch int").parquet(store)
    if months is not None:
        rows = rows.where(F.col("obs_month").isin(months))
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    return rows


def schema_ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def keyed_ingest(stream: DataFrame, store: str, checkpoint: str, order: str = "obs_id", keys=KEYS, date: str = "obs_date") -> StreamingQuery:
    """Append the unseen keys of a stream to a store partitioned by month and batch.

    A stored key is never changed; of several rows of a new key in a batch the first by ``order``
    stays; rows with a null key column are left out. A batch looks for its keys only in the months
    that it touches, of which the calendar bounds the number, whatever the size of the store.
    ``checkpoint`` and ``store`` belong together.
    """
    schema = stream.schema

    def append(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropna(subset=list(keys))
        known = rows.limit(0)
        if epoch:
            months = [r[0] for r in rows.select(month_of(date)).distinct().collect()]
            known = stored_rows(spark, store, schema, months, epoch)
        fresh = new_rows(rows, known, order, keys).withColumns({"obs_month": month_of(date), "batch": F.lit(epoch)})
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("obs_month", "batch").parquet(store)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(append).start()


# -- stage completion ---------------------------------------------------------

COMPLETED = "entity_id int, obs_date date, head string, pair string, tail string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """State in the store that timers need, for queries that start inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    held = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(name) if held is None else spark.conf.set(name, held)


class Completion(StatefulProcessor):
    """Stages of an entity's dates that are not forgotten yet, and a timer for the first date to be forgotten."""

    def __init__(self, delay_ms: int) -> None:
        self.delay_ms = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "dates array<int>, heads array<string>, firsts array<string>, done array<boolean>, last array<long>")

    def held(self, watermark_ms: int) -> dict:
        """(head, pair_first, done, last) of each date; a date whose time is up is gone, even if its timer comes after the rows of this batch."""
        state = self.pending.get() if self.pending.exists() else ((),) * 5
        return {day: rest for day, *rest in zip(*state) if rest[3] + self.delay_ms > watermark_ms}

    def keep(self, dates: dict, watermark_ms: int, timed: bool) -> None:
        """Write the dates and set the timer; ``timed``: the state may have a timer already."""
        if timed:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
        if not dates:
            self.pending.clear()
            return
        self.pending.update((list(dates), *map(list, zip(*dates.values()))))
        first = min(last for *_, last in dates.values())
        self.handle.registerTimer(max(first + self.delay_ms, watermark_ms + 1))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark, timed = timerValues.getCurrentWatermarkInMs(), self.pending.exists()
        dates, out = self.held(watermark), []
        events = pd.concat(list(rows), ignore_index=True).sort_values(["event_time", "stage"], kind="stable")
        times = events["event_time"].astype("datetime64[ms]").astype("int64")
        opened = {day for day, (head, *_) in dates.items() if head is not None}
        columns = (events[c] for c in ("obs_date", "stage", "head", "pair_first", "pair_second", "tail"))
        for date, stage, head, pair_first, pair_second, tail, time in zip(*columns, times):
            day = None if pd.isna(date) else date.toordinal()
            row = dates.setdefault(day, [None, None, False, 0])
            row[3] = max(row[3], time)
            if row[2]:
                continue
            if stage == 1:  # a first stage that is sent again replaces the one that stands
                row[0], row[1] = head, pair_first
                opened.add(day)
            elif day in opened:
                row[2] = True
                out.append((key[0], date, row[0], row[1] + pair_second, tail))
        if out:
            yield pd.DataFrame(out, columns=["entity_id", "obs_date", "head", "pair", "tail"])
        self.keep(dates, watermark, timed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        self.keep(self.held(watermark), watermark, False)
        return iter(())

    def close(self) -> None:
        pass


def completed_stages(events: DataFrame, watermark: str = "30 days") -> DataFrame:
    """Full observations: stage 1 (head, first pair digit) joined with stage 2 (second digit, tail) of its key.

    ``events``: entity_id, obs_date, stage, head, pair_first, pair_second, tail, event_time, as a
    stream. A stage 1 that is sent again replaces the pending one; a stage 2 without a stage 1 before
    it is dropped; a completed key is final. A key is forgotten once the watermark passes its last
    event by the watermark's delay. The dates of an entity share one state, which holds those not
    forgotten yet, so that a batch turns to it once per entity and not per date. Start the query
    inside ``keyed_state``.
    """
    delay = int(pd.Timedelta(watermark).total_seconds() * 1000)
    return events.withWatermark("event_time", watermark).groupBy("entity_id").transformWithStateInPandas(
        Completion(delay), COMPLETED, "append", "EventTime"
    )


# -- sequential replay --------------------------------------------------------

SEEN = "entity_id int, seen_rows long, last_digits array<int>, last_date date"
LEARNT = "target string, moments array<double>"


def next_seen(rows: DataFrame, seen: DataFrame, depth: int = G.DEPTH) -> DataFrame:
    """Per entity: rows so far, digits of the last ``depth`` rows and the last date, after ``rows``."""
    digits = F.array(*L.POSITIONS)
    added = rows.groupBy("entity_id").agg(
        F.count("*").alias("n"), F.max("obs_date").alias("to"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("obs_date", digits.alias("d")))), lambda r: r["d"])).alias("digits"),
    )
    both = seen.join(added, "entity_id", "full")
    none = F.array().cast("array<int>")
    joined = F.concat(F.coalesce("last_digits", none), F.coalesce("digits", none))
    return both.select(
        "entity_id", (F.coalesce("seen_rows", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("seen_rows"),
        G.last_values(joined, depth * len(L.POSITIONS)).alias("last_digits"), F.coalesce("to", "last_date").alias("last_date"),
    )


def summed(parts: DataFrame) -> DataFrame:
    """Moments of each target over all parts; a part is one row per block of rows."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"target": pdf["target"].iloc[:1], "moments": [np.sum(np.stack(pdf["moments"].to_numpy()), axis=0)]})

    return parts.groupBy("target").applyInPandas(add, LEARNT)


def feedback_rows(scores: DataFrame) -> DataFrame:
    """Three rows per predicted observation: its first pair digit, its second, and the second with the tail."""
    pick = lambda c, t: F.max(F.when(F.col("target") == t, F.col(c)))
    text = lambda c, *ts: F.concat_ws("", *[pick(c, t).cast("string") for t in ts])
    value = lambda c, stage: {"PAIR_FIRST": text(c, "p4"), "PAIR_SECOND": text(c, "p5"), "STAGE_2": F.concat_ws(" ", text(c, "p5"), text(c, "p6", "p7", "p8"))}[stage]
    stages = ("PAIR_FIRST", "PAIR_SECOND", "STAGE_2")
    rows = scores.where(~F.col("warm_up")).groupBy(*KEYS).agg(
        F.array(*[F.struct(F.lit(s).alias("stage"), value("prediction", s).alias("predicted_value"), value("actual", s).alias("actual_value")) for s in stages]).alias("f")
    )
    return rows.select(*KEYS, F.inline("f")).withColumn("is_correct", F.col("predicted_value") == F.col("actual_value"))


def sequential_replay(stream: DataFrame, folder: str, rows_per_block: int = 50_000) -> StreamingQuery:
    """Predict each arriving observation before it is learnt, record feedback, then learn it.

    ``stream``: entity_id, obs_date and the eight digits; batches arrive in date order. A batch
    starts from the moments and the entities' last rows that batch - 1 wrote, predicts its rows in
    (date, entity) order, each from all before it, and writes feedback, new moments and new last
    rows under its own number. Rows of an entity that are not later than its last date, and further
    rows of one key, are known already and left out. The feedback equals that of one batch over all rows.
    """
    def state(spark: SparkSession, name: str, epoch: int, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{folder}/{name}/batch={epoch}") if epoch >= 0 else spark.createDataFrame([], schema)

    def learn(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        seen, learnt = state(spark, "seen", epoch - 1, SEEN), state(spark, "moments", epoch - 1, LEARNT)
        later = batch.dropDuplicates(list(KEYS)).join(seen.select("entity_id", "last_date"), "entity_id", "left")
        rows = cut_lineage(later.where(F.col("last_date").isNull() | (F.col("obs_date") > F.col("last_date"))).drop("last_date"))
        scores, totals = G.online_scores(G.online_rows(rows, seen.drop("last_date")), rows_per_block, learnt)
        feedback_rows(scores).write.mode("overwrite").parquet(f"{folder}/feedback/batch={epoch}")
        summed(totals.unionByName(learnt)).write.mode("overwrite").parquet(f"{folder}/moments/batch={epoch}")
        next_seen(rows, seen).write.mode("overwrite").parquet(f"{folder}/seen/batch={epoch}")

    return stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(learn).start()
