"""Entitlements, retention, purges and other jobs over dimension snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.schema import purge_order

# Plan keys that are not entitlements, and the default retention.
META_KEYS = ("trial_duration_days",)
DEFAULT_RETENTION_DAYS, AUDIT_FLOOR_DAYS = 30, 365


def entitlements(tenants: DataFrame, plan_config: DataFrame, overrides: DataFrame, as_of) -> DataFrame:
    """A tenant's entitlements: its plan's values, with its unexpired overrides in their place -> tenant_id, key, value."""
    plan = tenants.join(plan_config, "plan_id").filter(~F.col("key").isin(*META_KEYS)).select("tenant_id", "key", F.col("value").alias("_plan"))
    live = overrides.filter(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(as_of))).select("tenant_id", "key", F.col("value").alias("_own"))
    return plan.join(live, ["tenant_id", "key"], "full").select("tenant_id", "key", F.coalesce("_own", "_plan").alias("value"))


def entitlement_maps(values: DataFrame) -> DataFrame:
    return values.groupBy("tenant_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("entitlements"))


def retention_days(tenants: DataFrame, plan_config: DataFrame, overrides: DataFrame) -> DataFrame:
    """Days kept: the tenant's override, else its plan's value, else the default."""
    of = lambda df, keys, name: df.filter("key = 'retention_days'").select(*keys, F.col("value").cast("int").alias(name))
    rows = tenants.join(of(overrides, ["tenant_id"], "_own"), "tenant_id", "left").join(of(plan_config, ["plan_id"], "_plan"), "plan_id", "left")
    return rows.select("tenant_id", F.coalesce("_own", "_plan", F.lit(DEFAULT_RETENTION_DAYS)).alias("days"))


def expired_partitions(partitions: DataFrame, days: DataFrame, as_of) -> DataFrame:
    """partitions(tenant_id, month as yyyy.MM) whose last moment is more than the tenant's days ago; other names are kept."""
    end = F.add_months(F.try_to_timestamp(F.concat("month", F.lit(".01")), F.lit("yyyy.MM.dd")).cast("date"), 1)
    named = F.col("month").rlike(r"^\d{4}\.(0[1-9]|1[0-2])$")
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(end.cast("timestamp"))
    return partitions.filter(named).join(days, "tenant_id").filter(age > F.col("days") * 86_400).select("tenant_id", "month")


def older_than(rows: DataFrame, at: str, as_of, days: int) -> DataFrame:
    """What a time-based deletion keeps."""
    return rows.filter(F.col(at) >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days"))


def purge_audit(audit: DataFrame, as_of, days: int) -> DataFrame:
    if days < AUDIT_FLOOR_DAYS:
        raise ValueError(f"audit rows are kept {AUDIT_FLOOR_DAYS} days at least")
    return older_than(audit, "created_at", as_of, days)


def freeze_expired_trials(tenants: DataFrame, as_of) -> DataFrame:
    late = (F.col("plan_id") == "trial") & (F.col("status") == "active") & (F.col("trial_expires_at") < F.lit(as_of).cast("timestamp"))
    return tenants.withColumn("status", F.when(late, "frozen").otherwise(F.col("status")))


def change_plan(tenants: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tenants, audit rows): changes(tenant_id, plan_id, actor, at). Leaving a trial ends its expiry and its freeze."""
    to = changes.select("tenant_id", F.col("plan_id").alias("_plan"), "actor", "at")
    rows = tenants.join(to, "tenant_id", "left")
    leaves = F.col("_plan").isNotNull() & (F.col("plan_id") == "trial") & (F.col("_plan") != "trial")
    audit = rows.filter("_plan is not null").select("tenant_id", "actor", F.lit("plan_changed").alias("action_type"), F.to_json(F.struct("plan_id", "status")).alias("before"), F.to_json(F.struct(F.col("_plan").alias("plan_id"), F.when(leaves & (F.col("status") == "frozen"), "active").otherwise(F.col("status")).alias("status"))).alias("after"), F.col("at").alias("created_at"))
    after = rows.withColumn("trial_expires_at", F.when(~leaves | F.col("_plan").isNull(), F.col("trial_expires_at")))
    after = after.withColumn("status", F.when(leaves & (F.col("status") == "frozen"), "active").otherwise(F.col("status"))).withColumn("plan_id", F.coalesce("_plan", "plan_id"))
    return after.drop("_plan", "actor", "at"), audit


def provision(tenants: DataFrame, known: DataFrame, settings: dict[str, str]) -> DataFrame:
    """Settings rows (tenant_id, key, value) that new tenants still lack; a second call finds nothing to add."""
    pairs = [F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in sorted(settings.items())]
    rows = tenants.select("tenant_id").distinct().select("tenant_id", F.explode(F.array(*pairs)).alias("_s")).select("tenant_id", "_s.*")
    return rows.join(known.select("tenant_id", "key"), ["tenant_id", "key"], "left_anti")


def tenant_gate(status: Column, abuse_frozen: Column) -> Column:
    """Why a tenant's data is refused, or null."""
    return F.when(abuse_frozen, "TENANT_ABUSE_FROZEN").when(status == "frozen", "TENANT_FROZEN").when(status == "purged", "TENANT_PURGED").when(status != "active", "TENANT_NOT_ACTIVE")


def credential_valid(credentials: DataFrame, as_of, overlap_hours: int = 24) -> DataFrame:
    """Credentials that hold: unused and unexpired, or the previous one within the overlap after its renewal."""
    now = F.lit(as_of).cast("timestamp")
    current = F.col("used_at").isNull() & (F.col("expires_at") > now)
    overlap = F.col("renewed_at").isNotNull() & (now <= F.col("renewed_at") + F.expr(f"interval {overlap_hours} hours"))
    return credentials.filter(current | overlap)


def classify_signups(signups: DataFrame, disposable: DataFrame, threshold: int = 5) -> DataFrame:
    """signups(id, email, ip, at) with verdict: disposable domain, too many from an address within the hour, or ok."""
    domain = F.lower(F.substring_index("email", "@", -1))
    rows = signups.withColumn("_domain", domain).join(disposable.select(F.lower("domain").alias("_domain"), F.lit(True).alias("_bad")), "_domain", "left")
    recent = F.count("*").over(Window.partitionBy("ip").orderBy(F.unix_timestamp("at")).rangeBetween(-3599, 0))
    return rows.withColumn("verdict", F.when(F.col("_bad"), "disposable_domain").when(recent > threshold, "velocity").otherwise("ok")).drop("_domain", "_bad")


def registry_gaps(tables: DataFrame, registry: DataFrame) -> DataFrame:
    """Tables with tenant data that no purge covers."""
    return tables.join(registry, ["table_schema", "table_name"], "left_anti")


def purge_plan(registry: DataFrame) -> list[str]:
    return purge_order([r.table_name for r in registry.select("table_name").collect()])  # a few dozen tables


def purge_tenant(table: DataFrame, tenant_id: str, retain: Column | None = None) -> DataFrame:
    """What is left of a table: other tenants' rows, and those that must be retained."""
    keep = F.col("tenant_id") != tenant_id
    return table.filter(keep if retain is None else keep | retain)


def latest_toggle(toggles: DataFrame) -> DataFrame:
    return toggles.groupBy("tenant_id", "rule_id").agg(F.max_by("enabled", F.struct("updated_at", "enabled")).alias("enabled"))


def rule_catalog(rules: DataFrame, disabled: DataFrame, toggles: DataFrame, tenant_id: str) -> DataFrame:
    """The rules a tenant sees: with why one is off for all, and whether it is on for it."""
    own = toggles.filter(F.col("tenant_id") == tenant_id).select("rule_id", F.col("enabled").alias("_own"))
    rows = rules.join(disabled.select("rule_id", F.lit(True).alias("runtime_disabled")), "rule_id", "left").join(own, "rule_id", "left")
    off = F.coalesce("runtime_disabled", F.lit(False))
    return rows.withColumn("runtime_disabled", off).withColumn("enabled", ~off & F.coalesce("_own", F.lit(True))).drop("_own").orderBy("rule_id")


def with_technique_text(rows: DataFrame, techniques: DataFrame) -> DataFrame:
    """rows(technique_id) with description, name and url; a sub-technique without a text of its own has its parent's."""
    parent = F.substring_index("technique_id", ".", 1)
    own = techniques.select(F.col("technique_id").alias("_own"), F.struct("name", "description", "url").alias("_o"))
    above = techniques.select(F.col("technique_id").alias("_parent"), F.struct("name", "description", "url").alias("_p"))
    joined = rows.join(own, F.col("technique_id") == F.col("_own"), "left").join(above, parent == F.col("_parent"), "left")
    return joined.withColumn("text", F.coalesce("_o", "_p")).drop("_own", "_o", "_parent", "_p")


def onboarding(events: DataFrame) -> DataFrame:
    """When each tenant's first event came."""
    return events.groupBy("tenant_id").agg(F.min("ingest_time").alias("first_event_at"))
