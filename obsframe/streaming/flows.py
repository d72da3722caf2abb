"""Incremental ingest, stage completion, prequential scoring, replay and periods."""

import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from obsframe import layout as L
from obsframe.operators.ranking import rank_symbols
from obsframe.operators.scans import history, prior
from obsframe.sources.writers import new_rows


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; a temporary one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="obsframe-stream-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over the available data into parquet and read it back.

    Each batch overwrites its own sub-folder, so a replayed batch leaves no
    duplicates; in complete mode the latest batch holds the whole result.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        part = "complete" if mode == "complete" else f"batch={epoch}"
        batch.write.mode("overwrite").parquet(f"{folder}/out/{part}")

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(f"{folder}/out/complete" if mode == "complete" else f"{folder}/out/batch=*")


def ingest(stream: DataFrame, stored: str, checkpoint: str, order: str = "obs_id", keys=("entity_id", "obs_date")):
    """Append unseen keys of a file stream to ``stored``; restarts resume from the checkpoint.

    Every batch owns one sub-folder and reads only the earlier ones, so a batch
    replayed after a failure rewrites the same rows.
    """
    spark = stream.sparkSession

    def append(batch: DataFrame, epoch: int) -> None:
        known = batch.limit(0)
        if epoch:
            earlier = [f"{stored}/batch={i}" for i in range(epoch)]
            known = spark.read.schema(batch.schema).parquet(*earlier)
        new_rows(batch, known, order, keys).write.mode("overwrite").parquet(f"{stored}/batch={epoch}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(append).start()


COMPLETED = "entity_id int, obs_date date, head string, pair string, tail string"


def complete_stages(events: DataFrame, watermark: str = "30 days") -> DataFrame:
    """Join stage 1 (head, first pair digit) with stage 2 (second digit, tail) per key.

    ``events``: entity_id, obs_date, stage, head, pair_first, pair_second, tail,
    event_time. A re-sent stage 1 replaces the pending one; a completed key is
    final; a key is forgotten once the watermark passes its last event by the
    watermark's own delay.
    """
    delay = int(pd.Timedelta(watermark).total_seconds() * 1000)

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        head, first, done, last = state.get if state.exists else (None, None, False, 0)
        for pdf in batches:
            for row in pdf.sort_values(["event_time", "stage"]).itertuples():
                last = max(last, int(row.event_time.timestamp() * 1000))
                if done:
                    continue
                if row.stage == 1:
                    head, first = row.head, row.pair_first
                elif head is not None:
                    done = True
                    yield pd.DataFrame(
                        [(key[0], key[1], head, first + row.pair_second, row.tail)],
                        columns=["entity_id", "obs_date", "head", "pair", "tail"],
                    )
        state.update((head, first, done, last))
        state.setTimeoutTimestamp(max(last + delay, state.getCurrentWatermarkMs() + 1))

    return (
        events.withWatermark("event_time", watermark).groupBy("entity_id", "obs_date")
        .applyInPandasWithState(step, COMPLETED, "head string, pair_first string, done boolean, last long", "append",
                                GroupStateTimeout.EventTimeTimeout)
    )


def prequential_scores(df: DataFrame, features=("p1", "p2", "p3"), target: str = "p4", warm_up: int = 12,
                       floor: float = 1e-3, ks=(1, 3, 5, 10), by=("entity_id",)) -> DataFrame:
    """Gaussian naive Bayes predicted from the rows before each row.

    Counts, sums and squares per class run along one window, so every row is
    scored with the state before it and no model object exists. ``by`` is the
    series the state belongs to.
    """
    w = prior(history(*by))
    y = F.col(target)
    cols = {"_n": F.count("*").over(w)}
    for d in range(L.DIGITS):
        cols[f"_n{d}"] = F.count_if(y == d).over(w)
        for f in features:
            v = F.when(y == d, F.col(f).cast("double"))
            cols[f"_s{d}_{f}"] = F.coalesce(F.sum(v).over(w), F.lit(0.0))
            cols[f"_q{d}_{f}"] = F.coalesce(F.sum(v * v).over(w), F.lit(0.0))
    step = df.select(*by, "obs_date", *features, target, *[c.alias(n) for n, c in cols.items()]).where(F.col("_n") >= warm_up)

    def log_score(d: int) -> Column:
        n = F.col(f"_n{d}").cast("double")
        out = F.ln(F.nullif(n, F.lit(0.0)) / F.col("_n"))
        for f in features:
            mean = F.col(f"_s{d}_{f}") / F.nullif(n, F.lit(0.0))
            var = F.greatest(F.col(f"_q{d}_{f}") / F.nullif(n, F.lit(0.0)) - mean * mean, F.lit(floor))
            part = -0.5 * (F.ln(var * 6.283185307179586) + (F.col(f) - mean) * (F.col(f) - mean) / var)
            out = out + F.coalesce(part, F.lit(0.0))
        return F.when(n > 0, out).otherwise(F.lit(-1e9))

    scored = step.select(*by, "obs_date", F.col(target).alias("target"), F.array(*[log_score(d) for d in range(L.DIGITS)]).alias("scores"))
    own = F.get("scores", F.col("target"))
    better = F.size(F.filter(F.transform("scores", lambda s, d: (s > own) | ((s == own) & (d < F.col("target")))), lambda b: b))
    out = scored.withColumn("rank", better + 1)
    return out.select(*by, "obs_date", "target", "rank", *[(F.col("rank") <= k).alias(f"hit_{k}") for k in ks])


def replay(stream: DataFrame, table: DataFrame, folder: str):
    """Score arriving rows with the last model table and append feedback rows.

    ``stream``: entity_id, obs_date, position, context, value; ``table`` is an
    order-1 transition table (at most ten contexts per position).
    """

    def score(batch: DataFrame, epoch: int) -> None:
        ranked = rank_symbols(
            batch.join(F.broadcast(table), ["position", "context"]), ["entity_id", "obs_date", "position", "value"], 3
        )
        hits = ranked.groupBy("entity_id", "obs_date", "position", "value").agg(
            F.max(F.when(F.col("symbol") == F.col("value"), F.col("rank"))).alias("actual_rank")
        )
        hits.write.mode("overwrite").parquet(f"{folder}/feedback/batch={epoch}")

    return stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(score).start()


def event_periods(events: DataFrame, days: int = 7, start: str = "0 days", watermark: str = "1 day") -> DataFrame:
    """Tumbling periods of event counts and values per type, batch or streaming."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", watermark)
    return rows.groupBy(F.window("ts", f"{days} days", startTime=start).alias("w"), "event_type").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")
    ).select(F.col("w.start").alias("period_start"), F.col("w.end").alias("period_end"), "event_type", "n", "total")
