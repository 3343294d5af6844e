"""Sources and sinks: raw batches, stream envelopes, document store, dead letters, audit log, event buffer, seed tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwarden import schema
from sparkwarden.functions.text import clamp_payload, redact_json
from sparkwarden.operators.tenancy import UUID, month_of, tenant_or_platform
from sparkwarden.storage import written

MAX_BATCH_BYTES, MAX_BATCH_EVENTS = 5 * 1024 * 1024, 1000
MAX_AUDIT_BYTES = 16 * 1024
DELIVERY_ORDER = ("ingest_time", "batch_id", "ordinal")
STREAMS = ("raw", "normalized", "detections", "alerts", "asset.observations")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of raw batches."""
    return spark.read.schema(schema.RAW_BATCH).json(path)


def stream_batches(spark: SparkSession, path: str, max_files: int = 32) -> DataFrame:
    return spark.readStream.schema(schema.RAW_BATCH).option("maxFilesPerTrigger", max_files).json(path)


def admit_bodies(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """bodies(tenant_id, source_type, body, ...) -> (accepted with events, rejected with a code). An empty batch is accepted."""
    parsed = bodies.withColumn("_v", F.try_parse_json("body"))
    events = F.try_variant_get("_v", "$.events", "array<variant>")
    rows = parsed.withColumn("events", events)
    code = F.when(F.octet_length("body") > MAX_BATCH_BYTES, "BATCH_TOO_LARGE").when(F.col("events").isNull(), "BODY_MALFORMED").when(F.size("events") > MAX_BATCH_EVENTS, "TOO_MANY_EVENTS")
    # `_row` keeps the filters above, as pushed below they would read each body again for each use of its events.
    rows = rows.withColumn("code", code).drop("_v").withColumn("_row", F.monotonically_increasing_id())
    return rows.filter("code is null and _row >= 0").drop("code", "_row"), rows.filter("code is not null and _row >= 0").drop("_row")


def to_envelope(rows: DataFrame, payload: list[str]) -> DataFrame:
    """Stream messages: tenant, trace, and the payload as JSON without nulls."""
    return rows.select("tenant_id", "trace_id", F.to_json(F.struct(*payload)).alias("payload"))


def from_envelope(messages: DataFrame, payload_schema: str) -> tuple[DataFrame, DataFrame]:
    """(decoded, malformed): tenant ids must be UUIDs and payloads JSON of the schema."""
    typed = messages.withColumn("_p", F.from_json("payload", f"{payload_schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    good = F.coalesce(F.col("tenant_id").rlike(UUID), F.lit(False)) & F.col("_p").isNotNull() & F.col("_p._corrupt").isNull()
    bad = typed.filter(~good).select(tenant_or_platform(F.col("tenant_id")).alias("tenant_id"), F.lit("MALFORMED_PIPELINE_MESSAGE").alias("code"), clamp_payload(F.col("payload")).alias("raw_payload"))
    return typed.filter(good).select("tenant_id", "trace_id", "_p.*").drop("_corrupt"), bad


def store_events(events: DataFrame, path: str, epoch: str | None = None) -> DataFrame:
    """Append events that the store does not have, by tenant and month; returns the stored events of this epoch. Of
    events that repeat, the first is stored: by ingest time, batch and place, as far as the events have them.

    Each row names the epoch that stored it (by default a new one). A delivery that is made again under its epoch, after a
    crash for one, stores nothing twice and returns the same rows. Only the months that the batch writes to are read."""
    spark, epoch = events.sparkSession, epoch or uuid.uuid4().hex
    keyed = events.withColumn("month", month_of(F.col("event_time")))
    if order := [c for c in DELIVERY_ORDER if c in events.columns]:
        place = F.row_number().over(Window.partitionBy("tenant_id", "month", "doc_id").orderBy(*order))
        keyed = keyed.withColumn("_place", place).filter("_place = 1").drop("_place")
    else:
        keyed = keyed.dropDuplicates(["tenant_id", "month", "doc_id"])
    keyed = keyed.withColumn("epoch", F.lit(epoch))
    months = [r.month for r in keyed.select("month").distinct().collect()]  # a batch spans a few
    # With a schema of its own the month stays text: inferred, 2024.10 would be the number 2024.1.
    store = lambda: spark.read.schema(keyed.schema).parquet(path).filter(F.col("month").isin(months))
    try:
        stored = store().select("tenant_id", "month", "doc_id")
    except AnalysisException as missing:  # the first batch of all
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        keyed = keyed.join(stored, ["tenant_id", "month", "doc_id"], "left_anti")
    keyed.write.mode("append").partitionBy("tenant_id", "month").parquet(path)
    return store().filter(F.col("epoch") == epoch)


def by_ids(events: DataFrame, ids: DataFrame) -> DataFrame:
    """The events of given ids."""
    return events.join(ids, ["tenant_id", "event_id"], "left_semi")


def bodies_or_none(links: DataFrame, read: Callable[[], DataFrame]) -> DataFrame:
    """Linked events with their body; where the event store cannot be read, when it is opened or while it is, all links with
    null bodies. `read` gives events(tenant_id, event_id, body). The links are written first, so that a failure after
    that is the store's; one of the links themselves is raised."""
    links = written(links, "links")
    try:
        return written(links.join(read().select("tenant_id", "event_id", "body"), ["tenant_id", "event_id"], "left"), "bodies")
    except (PySparkException, Py4JJavaError, OSError):
        return links.withColumn("body", F.lit(None).cast("string"))


def append_dead_letters(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def audit_rows(rows: DataFrame, actor: Column, action_type: Column, target: Column, before: Column, after: Column, reason: Column, at: Column) -> DataFrame:
    """Audit entries, with secrets hidden; what is then over 16 KB, or no JSON object, is not logged but named as that."""
    rows = rows.select("tenant_id", actor.alias("actor"), action_type.alias("action_type"), target.alias("target"), before.alias("before"), after.alias("after"), reason.alias("reason_code"), at.alias("created_at"))
    for name in ("before", "after"):
        rows = rows.withColumn(f"_{name}", redact_json(F.col(name)))
    value = lambda c: F.when(F.octet_length(f"_{c}") > MAX_AUDIT_BYTES, F.lit('{"too_large":true}')).when(F.col(c).isNotNull() & F.col(f"_{c}").isNull(), F.lit('{"not_an_object":true}')).otherwise(F.col(f"_{c}"))
    return rows.withColumns({"before": value("before"), "after": value("after")}).drop("_before", "_after")


def read_buffer(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines `<20 digits> <json>` of a buffer's segments -> (events by class folder and segment with seq, corrupt lines)."""
    lines = spark.read.text(path).select("value", F.regexp_extract(F.input_file_name(), r"/([^/]+)/[^/]+$", 1).alias("class"), F.regexp_extract(F.input_file_name(), r"/([^/]+)$", 1).alias("segment"))
    body = F.substring("value", 22, 1 << 30)
    good = F.col("value").rlike(r"^[0-9]{20} \{") & F.try_parse_json(body).isNotNull()
    rows = lines.filter(good).select(F.substring("value", 1, 20).cast("bigint").alias("seq"), "class", "segment", body.alias("body"), F.octet_length("value").alias("bytes"))
    return rows, lines.filter(~good)


def plan_config(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(schema.PLAN_CONFIG, "plan_id string, key string, value string")


def platform_config(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(schema.PLATFORM_CONFIG.items()), "key string, value string")
