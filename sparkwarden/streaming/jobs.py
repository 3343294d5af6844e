"""Streams between durable tables: raw batches to events and detections, and windowed counters.

Each micro-batch stores under its number: events that the store has not, dead letters and detections in a folder of
their own, which a repeated batch writes anew. Detections are made from the events stored under that number, so that a
batch that died after it stored them still makes its detections. One output folder belongs to one checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.operators.normalize import check_batches, explode_batches, normalize, split_valid
from sparkwarden.rules.evaluate import evaluate, hits, observed
from sparkwarden.rules.pack import Pack
from sparkwarden.session import SETTINGS
from sparkwarden.sources.ingest import store_events, stream_batches


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def run_events(spark: SparkSession, raw: str, base: str, pack_of: Callable[[], Pack], *, overlays: Callable[[], tuple] = lambda: (None, None)):
    """Raw batch files -> events, dead letters and detections under `base`; returns the query, which ends when all is read.

    A rule that fails on an event leaves a row in evaluation_errors and all other detections as they are; metrics hold what
    each micro-batch evaluated, observed as its outcomes were written.
    The pack and the overlays are asked for in every micro-batch, so a new version takes hold with the next one.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        good, bad = check_batches(batch)
        normalized = normalize(explode_batches(good).filter("payload is not null")).persist()
        events, rejected = split_valid(normalized)
        stored = store_events(events, f"{base}/events", str(batch_id))
        bad.unionByName(rejected).write.mode("overwrite").parquet(f"{base}/dead_letters/epoch={batch_id}")
        disabled, toggles = overlays()
        pack, place = pack_of(), f"epoch={batch_id}"
        outcomes, seen = observed(evaluate(stored, pack, disabled=disabled, toggles=toggles), f"detection-{batch_id}")
        outcomes.filter("matched or error").write.mode("overwrite").parquet(f"{base}/outcomes/{place}")
        told = spark.read.schema(outcomes.schema).parquet(f"{base}/outcomes/{place}")
        hits(told, pack).write.mode("overwrite").parquet(f"{base}/detections/{place}")
        told.filter("error").select("tenant_id", "event_id", "event_time", "rule_id").write.mode("overwrite").parquet(f"{base}/evaluation_errors/{place}")
        counts = spark.createDataFrame([("detection", k, v) for k, v in seen.get.items()], "stage string, outcome string, n long")
        counts.write.mode("overwrite").parquet(f"{base}/metrics/{place}")
        normalized.unpersist()

    return stream_batches(spark, raw).writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()


def drained(stream: DataFrame, mode: str, path: str) -> DataFrame:
    """What a stream gives until all that is there now is read. Each micro-batch writes a folder of its own, which a
    repeated batch writes anew."""
    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/epoch={batch_id}")

    spark = stream.sparkSession
    spark.conf.set(STATE_STORE, SETTINGS[STATE_STORE])  # stateful processors need it
    query = stream.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def first_of_each(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream without repeated events, with state only for as long as repeats may come."""
    return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["tenant_id", "doc_id"])


def rate_windows(events: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Accepted events by tenant in the last 60 seconds, each 6 seconds."""
    return events.withWatermark("event_time", delay).groupBy("tenant_id", F.window("event_time", "60 seconds", "6 seconds")).agg(F.count("*").alias("rate"))


def failure_windows(evaluations: DataFrame, delay: str = "5 minutes") -> DataFrame:
    """Failures of rules in sliding windows of 5 minutes, each 30 seconds."""
    grouped = evaluations.withWatermark("at", delay).groupBy("rule_id", F.window("at", "5 minutes", "30 seconds"))
    return grouped.agg(F.count("*").alias("evaluations"), F.sum(F.col("error").cast("int")).alias("errors"), F.size(F.collect_set(F.when(F.col("error"), F.col("tenant_id")))).alias("failing_tenants"))


def failing_windows(evaluations: DataFrame, delay: str = "5 minutes", *, fraction: float = 0.05, tenants: int = 3, least: int = 200) -> DataFrame:
    """Each rule once, when a window first puts it over all thresholds."""
    over = (F.col("evaluations") >= least) & (F.col("errors") >= fraction * F.col("evaluations")) & (F.col("failing_tenants") >= tenants)
    return failure_windows(evaluations, delay).filter(over).dropDuplicates(["rule_id"])


def session_alerts(hits: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Alerts of a stream of hits that come nearly in order: session windows of the dedup gap."""
    grouped = hits.withWatermark("event_time", delay).groupBy("tenant_id", "rule_id", "entity_key", F.session_window("event_time", "60 minutes"))
    return grouped.agg(F.count("*").alias("occurrence_count"), F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"))


def usage_windows(events: DataFrame, delay: str = "1 day") -> DataFrame:
    return events.withWatermark("event_time", delay).groupBy("tenant_id", F.window("event_time", "1 day")).agg(F.count("*").alias("events"))
