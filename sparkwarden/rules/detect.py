"""Detection: all rules of a pack in one scan of the events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.operators.tenancy import month_of
from sparkwarden.rules.compile import Resolver, TypedResolver
from sparkwarden.rules.pack import Pack


def hits_of(pack: Pack, resolver: Resolver, event_class: Column, schema_version: Column) -> Column:
    """Array of the hits of an event: a struct for each rule that applies and matches. Rules are tried by class, so an
    event is only tested against those of its own."""
    none = None
    for name in sorted({r.event_class for r in pack.rules}):
        hits = []
        for r in pack.of(name):
            user = resolver.text("user.name") if "user.name" in r.entity else None
            hit = F.struct(
                F.lit(r.id).alias("rule_id"), F.lit(r.version).alias("rule_version"), F.lit(r.title).alias("title"), F.lit(r.severity).alias("severity"),
                F.array(*map(F.lit, r.techniques)).alias("mitre_technique_ids"), r.entity_key(resolver).alias("entity_key"),
                (user if user is not None else F.lit(None).cast("string")).alias("entity_user"),
            )
            hits.append(F.when(r.gate(event_class, schema_version) & r.matches(resolver), hit))
        of_class = F.filter(F.array(*hits), lambda h: h.isNotNull())
        none = F.when(event_class == name, of_class) if none is None else none.when(event_class == name, of_class)
    return none if none is not None else F.array()


def detect(events: DataFrame, pack: Pack, *, disabled: DataFrame | None = None, toggles: DataFrame | None = None) -> DataFrame:
    """Hits of typed events, one row for each rule and event.

    disabled(rule_id): rules switched off for all; toggles(tenant_id, rule_id, enabled): a tenant's own choice. Both are
    small overlays, joined after the explode.
    """
    resolver = TypedResolver(events.schema)
    hits = hits_of(pack, resolver, F.col("event_class"), F.col("schema_version"))
    host = resolver.text("host.hostname")
    out = events.select(
        "tenant_id", "event_id", "event_time", F.explode(hits).alias("hit"), (host if host is not None else F.lit(None).cast("string")).alias("entity_hostname"),
    ).select(
        "tenant_id", "event_id", "event_time", "hit.*", "entity_hostname",
        F.concat(F.lit("events-v1-"), F.col("tenant_id"), F.lit("-"), month_of(F.col("event_time"))).alias("es_index"), F.lit(pack.version).alias("pack_version"),
    )
    return enabled(out, disabled, toggles)


def enabled(hits: DataFrame, disabled: DataFrame | None, toggles: DataFrame | None, default: bool = True) -> DataFrame:
    """Hits of rules that are neither disabled nor toggled off by their tenant."""
    if disabled is not None:
        hits = hits.join(disabled.select("rule_id"), "rule_id", "left_anti")
    if toggles is not None:
        keys = toggles.select("tenant_id", "rule_id", F.col("enabled").alias("_enabled"))
        hits = hits.join(keys, ["tenant_id", "rule_id"], "left").filter(F.coalesce("_enabled", F.lit(default))).drop("_enabled")
    return hits
