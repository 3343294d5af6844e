"""Raw batches to typed events: mapping, server-side envelope, validation into (events, dead letters).

Payloads arrive as VARIANT, so that scalars keep their types and no cast can fail a batch; whole numbers are also read
from numeric text. A batch is exploded once and every check is a column, so good and bad events come from one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.functions.text import byte_prefix, clamp_payload, document_id, semver
from sparkwarden.operators.tenancy import UUID, tenant_or_platform

SCHEMA_VERSION = "1.0.0"
# Classes with their own keys, enumerations and size limits.
CLASS_KEYS = {
    "process_activity": {"process", "parent", "user", "exit_code"},
    "network_activity": {"direction", "protocol", "src", "dst", "bytes_sent", "bytes_received", "process", "user"},
    "authentication": {"status", "logon_type", "user", "src_ip", "session_id", "failure_reason"},
    "generic": {"message", "category", "fields", "raw", "raw_truncated"},
}
COMMON_KEYS = {
    "event_id", "tenant_id", "schema_version", "event_class", "activity", "event_time", "time_inferred", "ingest_time", "source_type", "source_event_id",
    "batch_id", "source", "host", "severity_hint", "unmapped",
}
MAX_CMD_LINE = MAX_MESSAGE = MAX_RAW = 32 * 1024
MAX_UNMAPPED = MAX_FIELDS = 16 * 1024
ZONED = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*([Zz]|[+-]\d{2}:?\d{2})$"


#: Keys of the payload's objects that are read.
OBJECTS = {
    "host": ("hostname", "os_family", "os_name", "os_version", "ip", "mac"), "process": ("pid", "name", "exe_path", "cmd_line", "sha256", "created_time"),
    "parent": ("pid", "name", "exe_path"), "user": ("name", "domain", "uid"), "src": ("ip", "port"), "dst": ("ip", "port", "hostname"),
}
SCALARS = (
    "event_class", "activity", "event_time", "source_event_id", "severity_hint", "exit_code", "direction", "protocol", "bytes_sent", "bytes_received", "status",
    "logon_type", "src_ip", "session_id", "failure_reason", "category", "message", "msg", "log", "fields", "raw",
)


def text_of(v: Column) -> Column:
    """The value of a variant that is a string, else null."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def whole_of(v: Column) -> Column:
    """A whole number, also from numeric text or a number without fraction."""
    number = F.try_variant_get(v, "$", "string").try_cast("decimal(38,6)")
    return F.when((F.schema_of_variant(v) != "BOOLEAN") & (number == F.floor(number)), number.try_cast("bigint"))


def unpack(raw: DataFrame) -> DataFrame:
    """The payload's values as variants: one cast of the whole, then one of each inner object."""
    of = lambda v, keys: F.try_variant_get(v, "$", "struct<" + ",".join(f"{k}:variant" for k in keys) + ">")
    rows = raw.withColumn("_p", of(F.col("payload"), (*SCALARS, *OBJECTS))).withColumn("_json", F.to_json("payload"))
    rows = rows.withColumn("_kind", F.substring(F.schema_of_variant("payload"), 1, 6))
    return rows.select("*", *[of(F.col(f"_p.{name}"), keys).alias(f"_{name}") for name, keys in OBJECTS.items()])


def parse_time(text: Column) -> Column:
    """A time with a zone; one without is no time here."""
    return F.when(text.rlike(ZONED), F.try_to_timestamp(text))


def explode_batches(batches: DataFrame) -> DataFrame:
    """Raw batches to one row for each event, with its place in the batch."""
    return batches.select("tenant_id", "batch_id", "source_type", "ingest_time", "source", F.posexplode_outer("events").alias("ordinal", "payload"))


def normalize(raw: DataFrame) -> DataFrame:
    """explode_batches() rows to event columns, with `errors` (array of `place: message`) and `code` (null for good ones).

    `_row` keeps filters on `code` above this projection: pushed below, they would repeat all of its expressions."""
    raw = unpack(raw)
    top = lambda k: F.col(f"_p.{k}")
    inner = lambda o, k: text_of(F.col(f"_{o}.{k}")).alias(k)
    number = lambda o, k: whole_of(F.col(f"_{o}.{k}")).alias(k)
    texts = ("event_class", "activity", "event_time", "source_event_id", "severity_hint", "direction", "protocol", "status", "logon_type", "src_ip", "session_id", "failure_reason", "category", "message", "msg", "log")
    rows = raw.select(
        "tenant_id", "batch_id", "source_type", "ingest_time", "ordinal", "payload", "source", "_json", "_kind", top("fields").alias("fields"), F.to_json(top("raw")).alias("_raw"),
        *[text_of(top(k)).alias(f"t_{k}") for k in texts], *[whole_of(top(k)).alias(k) for k in ("exit_code", "bytes_sent", "bytes_received")],
        F.struct(F.lower(inner("host", "hostname")).alias("hostname"), *[inner("host", k) for k in OBJECTS["host"][1:5]], F.lower(inner("host", "mac")).alias("mac")).alias("host"),
        F.struct(number("process", "pid"), *[inner("process", k) for k in ("name", "exe_path", "cmd_line")], F.lower(inner("process", "sha256")).alias("sha256"), inner("process", "created_time")).alias("process"),
        F.struct(number("parent", "pid"), inner("parent", "name"), inner("parent", "exe_path")).alias("parent"), F.struct(*[inner("user", k) for k in OBJECTS["user"]]).alias("user"),
        *[F.struct(inner(o, "ip"), number(o, "port").cast("int").alias("port"), *([inner(o, "hostname")] if o == "dst" else [])).alias(o) for o in ("src", "dst")],
        F.try_variant_get("payload", "$", "map<string,variant>").alias("_map"),
    )
    c = F.col
    known = F.coalesce(c("t_event_class").isin(*CLASS_KEYS), F.lit(False))
    rows = rows.withColumn("_loose", (c("source_type") == "generic") & ~known).withColumn("event_class", F.when(c("_loose"), "generic").otherwise(c("t_event_class")))
    when = parse_time(c("t_event_time"))
    first_text = F.coalesce(*[F.when(F.length(f"t_{k}") > 0, c(f"t_{k}")) for k in ("message", "msg", "log")], "_json")
    own = F.coalesce(*[F.when(c("event_class") == k, F.array(*map(F.lit, sorted(keys | COMMON_KEYS)))) for k, keys in CLASS_KEYS.items()], F.array(*map(F.lit, sorted(COMMON_KEYS))))
    # Unknown keys keep their values as they are, beside what the payload already had as unmapped.
    extra = F.map_filter("_map", lambda k, v: ~F.array_contains(own, k) & v.isNotNull() & ~F.is_variant_null(v))
    before = F.coalesce(F.try_variant_get(F.element_at("_map", "unmapped"), "$", "map<string,variant>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>")))
    rows = rows.withColumn("_extra", extra)
    extra = F.map_concat(F.map_filter(before, lambda k, v: ~F.map_contains_key("_extra", k)), "_extra")
    raw_text = F.when(c("_loose"), c("_json")).otherwise(c("_raw"))
    cut = F.octet_length(raw_text) > MAX_RAW
    raw_kept = F.when(cut, F.to_json(F.struct(byte_prefix(raw_text, MAX_RAW - 64).alias("truncated_json")))).otherwise(raw_text)
    source = F.struct(*[c(f"source.{k}").alias(k) for k in ("device_id", "agent_version", "ingest_key_id", "vendor", "product")])
    made_id = F.when(c("source_type") == "generic", F.sha2(F.concat_ws(":", "batch_id", c("ordinal").cast("string")), 256))
    out = rows.select(
        "tenant_id", "batch_id", "source_type", "ingest_time", "ordinal", "payload", F.lit(SCHEMA_VERSION).alias("schema_version"), "event_class",
        F.coalesce("t_activity", F.when(c("_loose"), "log")).alias("activity"), F.coalesce(when, "ingest_time").alias("event_time"), when.isNull().alias("time_inferred"), source.alias("source"),
        F.coalesce("t_source_event_id", made_id).alias("source_event_id"), "host", c("t_severity_hint").alias("severity_hint"), F.when(~c("_loose") & (F.size(extra) > 0), F.to_json(extra)).alias("unmapped"),
        "process", "parent", "exit_code", "user", c("t_direction").alias("direction"), c("t_protocol").alias("protocol"), "src", "dst", "bytes_sent", "bytes_received",
        F.coalesce("t_status", F.when(c("t_activity") == "logon_failed", "failure")).alias("status"), *[c(f"t_{k}").alias(k) for k in ("logon_type", "src_ip", "session_id", "failure_reason")],
        F.when(c("event_class") == "generic", byte_prefix(first_text, MAX_MESSAGE)).alias("message"), c("t_category").alias("category"), "fields", raw_kept.alias("raw"),
        F.coalesce(cut, F.lit(False)).alias("raw_truncated"), (c("_kind") == "OBJECT").alias("_object"),
    )
    # The id of a stored event is that of its source's id within the tenant, so a second delivery has it too.
    scope = F.coalesce("source.device_id", "source.ingest_key_id", F.lit("-"))
    out = out.withColumn("doc_id", document_id(F.col("tenant_id"), scope, F.col("source_event_id"))).withColumn("event_id", F.col("doc_id"))
    out = out.withColumn("errors", validation_errors())
    code = F.when(~F.col("_object"), "EVENT_NOT_AN_OBJECT").when(F.col("event_class").isNull() | ~F.col("event_class").isin(*CLASS_KEYS), "UNKNOWN_EVENT_CLASS")
    return out.withColumn("code", code.when(F.size("errors") > 0, "SCHEMA_VALIDATION_FAILED")).drop("_object").withColumn("_row", F.monotonically_increasing_id())


def validation_errors() -> Column:
    """Array of up to 20 messages over the columns of a normalised event."""
    c = F.col
    of = lambda k: c("event_class") == k
    missing = lambda path: c(path).isNull()
    tcp_udp = c("protocol").isin("tcp", "udp")
    bad_port = lambda path: c(path).isNotNull() & ~c(path).between(0, 65535)
    agent, generic = c("source_type") == "agent", c("source_type") == "generic"
    checks = [
        ("schema_version", semver(c("schema_version")).isNull(), "not a semantic version"),
        ("unmapped", F.octet_length("unmapped") > MAX_UNMAPPED, "too large"),
        ("source_event_id", agent & missing("source_event_id"), "required for agents"),
        ("source_event_id", F.length("source_event_id") > 128, "too long"),
        ("host.hostname", agent & missing("host.hostname"), "required for agents"),
        ("host.hostname", F.length("host.hostname") > 253, "too long"),
        ("host.mac", c("host.mac").isNotNull() & ~c("host.mac").rlike(r"^([0-9a-f]{2}[:-]){5}[0-9a-f]{2}$"), "not a MAC address"),
        ("source", agent & missing("source.device_id"), "device_id is required for agents"),
        ("source", generic & missing("source.ingest_key_id"), "ingest_key_id is required for generic sources"),
        ("source", c("source.device_id").isNotNull() & c("source.ingest_key_id").isNotNull(), "has both device_id and ingest_key_id"),
        ("activity", missing("activity"), "required"),
        ("process", of("process_activity") & (missing("process.pid") | missing("process.name")), "pid and name are required"),
        ("process.cmd_line", of("process_activity") & (c("activity") == "process_launched") & missing("process.cmd_line"), "required at launch"),
        ("parent", of("process_activity") & (c("activity") == "process_launched") & (missing("parent.pid") | missing("parent.name")), "pid and name are required at launch"),
        ("process.cmd_line", F.octet_length("process.cmd_line") > MAX_CMD_LINE, "too long"),
        ("process.sha256", c("process.sha256").isNotNull() & ~c("process.sha256").rlike("^[0-9a-f]{64}$"), "not a sha256"),
        ("exit_code", c("exit_code").isNotNull() & (c("activity") != "process_terminated"), "only when a process ends"),
        ("src.ip", of("network_activity") & missing("src.ip"), "required"),
        ("dst.ip", of("network_activity") & missing("dst.ip"), "required"),
        ("direction", of("network_activity") & ~F.coalesce(c("direction").isin("inbound", "outbound", "lateral", "unknown"), F.lit(False)), "not a direction"),
        ("src.port", bad_port("src.port") | (of("network_activity") & tcp_udp & missing("src.port")), "port missing or out of range"),
        ("dst.port", bad_port("dst.port") | (of("network_activity") & tcp_udp & missing("dst.port")), "port missing or out of range"),
        ("bytes_sent", (c("bytes_sent").isNotNull() | c("bytes_received").isNotNull()) & (c("activity") != "connection_closed"), "only when a connection closes"),
        ("user.name", c("event_class").isin("process_activity", "authentication") & missing("user.name"), "required"),
        ("status", of("authentication") & missing("status"), "required"),
        ("status", (c("activity") == "logon_failed") & ((c("status") != "failure") | missing("failure_reason")), "a failed logon has status failure and a reason"),
        ("message", of("generic") & (F.length("message") < 1), "required"),
        ("fields", F.octet_length(F.to_json("fields")) > MAX_FIELDS, "too large"),
    ]
    messages = [F.when(F.coalesce(bad, F.lit(False)), F.lit(f"{place}: {text}")) for place, bad, text in checks]
    return F.slice(F.filter(F.array(*messages), lambda m: m.isNotNull()), 1, 20)


def split_valid(normalized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, dead letters) of normalize()."""
    good = normalized.filter(F.col("code").isNull() & (F.col("_row") >= 0)).drop("errors", "code", "payload", "_row")
    return good, dead_letters(normalized.filter(F.col("code").isNotNull() & (F.col("_row") >= 0)), "normalize", F.col("code"), F.array_join("errors", "; "), F.to_json("payload"))


def dead_letters(rows: DataFrame, stage: str, code: Column, detail: Column, payload: Column) -> DataFrame:
    """Rejected rows for the dead-letter table: payload cut to 64 KB, detail to 2000 characters."""
    return rows.select(
        tenant_or_platform(F.col("tenant_id")).alias("tenant_id"), F.lit(stage).alias("stage"), code.alias("code"), F.substring(detail, 1, 2000).alias("detail"),
        F.coalesce("source_type", F.lit("unknown")).alias("source_type"), clamp_payload(payload).alias("raw_payload"), F.col("ingest_time").alias("at"),
    )


def check_batches(batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(well-formed batches, dead letters): a batch has a tenant and an array of events."""
    good = F.coalesce(F.col("tenant_id").rlike(UUID), F.lit(False)) & F.col("events").isNotNull()
    bad = batches.filter(~good)
    return batches.filter(good), dead_letters(bad, "raw", F.lit("RAW_BATCH_MALFORMED"), F.lit("tenant or events missing"), F.to_json("events"))


def first_deliveries(events: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The first event of each (tenant, month, doc_id) that is not stored yet; order: ingest time, batch, place."""
    keyed = events.withColumn("month", F.date_format("event_time", "yyyy.MM"))
    order = Window.partitionBy("tenant_id", "month", "doc_id").orderBy("ingest_time", "batch_id", "ordinal")
    fresh = keyed.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    return fresh if stored is None else fresh.join(stored.select("tenant_id", "month", "doc_id"), ["tenant_id", "month", "doc_id"], "left_anti")


def observations(events: DataFrame) -> DataFrame:
    """What events tell about computers: one row for each event with a host name."""
    return events.filter(F.col("host.hostname").isNotNull()).select(
        "tenant_id", F.col("event_time").alias("observed_at"), F.when(F.col("source_type") == "agent", "agent").otherwise("log_ingest").alias("source"),
        "host.hostname", "host.os_family", "host.os_name", "host.os_version", "host.ip", "host.mac", "source.device_id", "source.agent_version",
    )


def enrolment_observations(enrolments: DataFrame) -> DataFrame:
    """What agents tell about their computers as they enrol, in the form of observations()."""
    return enrolments.select(
        "tenant_id", F.col("enrolled_at").alias("observed_at"), F.lit("agent").alias("source"), "host.hostname", "host.os_family", "host.os_name", "host.os_version", "host.ip", "host.mac",
        "device_id", "agent_version",
    )
