"""Raw events for tests."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def simulate(spark: SparkSession, n: int, tenant_id: str, seed: int = 1, start: str = "2026-01-01 00:00:00") -> DataFrame:
    """n raw events as JSON, the same for the same seed: 55 % process, 35 % network, 10 % logon; each 40th is an attack."""
    roll = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(100))
    attack = F.col("id") % 40 == 39
    host = F.concat(F.lit("ws-"), F.lpad(F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(50)).cast("string"), 2, "0"))
    user = F.concat(F.lit("user"), F.pmod(F.xxhash64(F.lit(seed + 2), "id"), F.lit(80)).cast("string"))
    at = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(start)) + F.col("id") * 5), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    base = [F.concat(F.lit("sim-"), F.col("id").cast("string")).alias("source_event_id"), at.alias("event_time"), F.struct(host.alias("hostname"), F.lit("windows").alias("os_family")).alias("host"), F.struct(user.alias("name")).alias("user")]
    parent = F.struct(F.lit(4).alias("pid"), F.lit("explorer.exe").alias("name"))
    process = F.struct(
        F.lit("process_activity").alias("event_class"), F.lit("process_launched").alias("activity"), *base,
        F.struct((F.col("id") % 9000 + 100).alias("pid"), F.when(attack, "powershell.exe").otherwise("notepad.exe").alias("name"), F.lit("C:\\Windows").alias("exe_path"), F.when(attack, "powershell.exe -enc SQBFAFgA").otherwise("notepad.exe a.txt").alias("cmd_line")).alias("process"), parent.alias("parent"))
    network = F.struct(
        F.lit("network_activity").alias("event_class"), F.lit("connection_opened").alias("activity"), *base, F.lit("outbound").alias("direction"), F.lit("tcp").alias("protocol"),
        F.struct(F.lit("10.0.0.5").alias("ip"), F.lit(50000).alias("port")).alias("src"), F.struct(F.when(attack, "203.0.113.9").otherwise("10.0.0.9").alias("ip"), F.when(attack, 4444).otherwise(443).alias("port")).alias("dst"))
    logon = F.struct(
        F.lit("authentication").alias("event_class"), F.when(attack, "logon_failed").otherwise("logon").alias("activity"), *base, F.when(attack, "failure").otherwise("success").alias("status"),
        F.lit("interactive").alias("logon_type"), F.when(attack, "account_locked").alias("failure_reason"))
    body = F.when(roll < 55, F.to_json(process)).when(roll < 90, F.to_json(network)).otherwise(F.to_json(logon))
    return spark.range(n).select(F.lit(tenant_id).alias("tenant_id"), "id", body.alias("body"))


def batches_of(simulated: DataFrame, size: int = 100, device: str = "dev-1") -> DataFrame:
    """Simulated events as raw batches of an agent."""
    grouped = simulated.withColumn("_b", F.floor(F.col("id") / size)).groupBy("tenant_id", "_b").agg(F.array_sort(F.collect_list(F.struct("id", "body"))).alias("rows"), F.max("id").alias("_last"))
    source = F.struct(F.lit(device).alias("device_id"), F.lit("1.0.0").alias("agent_version"), *[F.lit(None).cast("string").alias(k) for k in ("ingest_key_id", "vendor", "product")])
    return grouped.select(
        "tenant_id", F.concat(F.lit("trace-"), F.col("_b").cast("string")).alias("trace_id"), F.concat(F.lit("batch-"), F.col("_b").cast("string")).alias("batch_id"), F.lit("agent").alias("source_type"),
        F.timestamp_seconds(F.lit(1_767_225_600) + F.col("_last") * 5).alias("ingest_time"), source.alias("source"), F.transform("rows", lambda r: F.parse_json(r["body"])).alias("events"))
