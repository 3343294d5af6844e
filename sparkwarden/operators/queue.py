"""The query surface: filters, sort orders, keyset pages, nested views."""

from __future__ import annotations

import base64
import json
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwarden.functions.text import like_literal, trim_json, trimmed

DEFAULT_PAGE, MAX_PAGE = 50, 200
# The order of each sort name; True is ascending.
ALERT_SORTS = {
    "-priority": (("priority_score", False), ("last_seen", False), ("alert_id", True)),
    "priority": (("priority_score", True), ("last_seen", False), ("alert_id", True)),
    "-last_seen": (("last_seen", False), ("alert_id", True)),
    "last_seen": (("last_seen", True), ("alert_id", True)),
}
ASSET_SORT = (("last_seen", False), ("asset_id", True))
AUDIT_SORT = (("created_at", False), ("id", False))
RULE_SORT = (("rule_id", True),)


def after(order, cursor: dict) -> Column:
    """Rows that come after a cursor's row: on the first key that differs, further along."""
    tests = []
    for k, (name, ascending) in enumerate(order):
        same = [F.col(n) == F.lit(cursor[n]) for n, _ in order[:k]]
        further = F.col(name) > F.lit(cursor[name]) if ascending else F.col(name) < F.lit(cursor[name])
        tests.append(reduce(and_, [*same, further]))
    return reduce(or_, tests)


def keyset_page(df: DataFrame, order, *, limit: int = DEFAULT_PAGE, cursor: dict | None = None) -> DataFrame:
    """One row more than a page, so that the caller sees whether another follows; a top-k, not a sort of everything."""
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be from 1 to {MAX_PAGE}")
    rows = df if cursor is None else df.filter(after(order, cursor))
    return rows.orderBy(*[F.col(n).asc() if up else F.col(n).desc() for n, up in order]).limit(limit + 1)


def encode_cursor(row: dict) -> str:
    return base64.urlsafe_b64encode(json.dumps(row, sort_keys=True, default=str).encode()).decode().rstrip("=")


def decode_cursor(text: str) -> dict:
    try:
        return json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    except ValueError as bad:
        raise ValueError("not a cursor") from bad


def alert_filter(*, state=None, severity=None, ai_severity=None, rule_id=None, host=None, group_id=None, since=None, until=None) -> Column:
    """Conjunction of the given filters; lists are alternatives, times are inclusive at both ends."""
    tests = [F.col(c).isin(list(v)) for c, v in (("state", state), ("severity", severity), ("ai_severity", ai_severity)) if v]
    tests += [F.col(c) == v for c, v in (("rule_id", rule_id), ("group_id", group_id)) if v is not None]
    if host is not None:
        tests.append(F.lower("entity_hostname") == host.lower())
    if since is not None:
        tests.append(F.col("last_seen") >= F.lit(since))
    if until is not None:
        tests.append(F.col("last_seen") <= F.lit(until))
    return reduce(and_, tests) if tests else F.lit(True)


def asset_filter(*, source=None, agent_status=None, billable_since=None, q=None) -> Column:
    tests = [F.col("state") == "active"]
    if source is not None:
        tests.append(F.array_contains("sources", source))
    if agent_status is not None:
        tests.append(F.col("agent_status") == agent_status)
    if billable_since is not None:
        tests.append(F.col("last_seen") >= F.lit(billable_since))
    if q:
        tests.append(F.col("hostname").ilike(f"%{like_literal(q)}%"))
    return reduce(and_, tests)


def audit_filter(*, actor=None, action_type=None, since=None, until=None) -> Column:
    tests = [F.col(c) == v for c, v in (("actor", actor), ("action_type", action_type)) if v is not None]
    tests += [F.col("created_at") >= F.lit(since)] * (since is not None) + [F.col("created_at") <= F.lit(until)] * (until is not None)
    return reduce(and_, tests) if tests else F.lit(True)


def list_alerts(alerts: DataFrame, *, sort: str = "-priority", limit: int = DEFAULT_PAGE, cursor: dict | None = None, **filters) -> tuple[DataFrame, DataFrame]:
    """(page, total): the total counts all rows of the filters, whatever the cursor."""
    rows = alerts.filter(alert_filter(**filters))
    return keyset_page(rows, ALERT_SORTS[sort], limit=limit, cursor=cursor), rows.agg(F.count("*").alias("total"))


def false_positives(alerts: DataFrame, start, end, *, rule_id: str | None = None, tenant_id: str | None = None) -> DataFrame:
    """Alerts closed as false positives from start to end, both included, for those who write rules."""
    tests = [F.col("close_reason") == "false_positive", F.col("closed_at").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))]
    tests += [F.col(c) == v for c, v in (("rule_id", rule_id), ("tenant_id", tenant_id)) if v is not None]
    names = ("tenant_id", "alert_id", "rule_id", "entity_hostname", "entity_user", "close_reason", "close_comment", "closed_at", "priority_inputs")
    return alerts.filter(reduce(and_, tests)).select(*[c for c in names if c in alerts.columns]).orderBy("tenant_id", "closed_at", "alert_id")


def with_event_refs(alerts: DataFrame, links: DataFrame) -> DataFrame:
    """Each alert with its sorted event ids."""
    refs = links.groupBy("tenant_id", "alert_id").agg(F.sort_array(F.collect_list("event_id")).alias("event_refs"))
    return alerts.join(refs, ["tenant_id", "alert_id"], "left").withColumn("event_refs", F.coalesce("event_refs", F.array().cast("array<string>")))


def event_bodies(links: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found bodies, missing ids) of linked events."""
    return links.join(events, ["tenant_id", "event_id"]), links.join(events, ["tenant_id", "event_id"], "left_anti").select("tenant_id", "event_id")


def siblings(alerts: DataFrame, alert_id: str) -> DataFrame:
    group = alerts.filter(F.col("alert_id") == alert_id).select("tenant_id", "group_id")
    return alerts.join(group, ["tenant_id", "group_id"], "left_semi").filter(F.col("alert_id") != alert_id)


def alert_view(alerts: DataFrame) -> DataFrame:
    """Nested form of alerts."""
    return alerts.select(
        "alert_id", "state", F.struct(F.col("rule_id").alias("id"), F.col("rule_version").alias("version"), "title", "severity").alias("rule"),
        F.struct(F.col("entity_hostname").alias("hostname"), F.col("entity_user").alias("user")).alias("entity"), "occurrence_count", "first_seen", "last_seen", "priority_score",
    )


def context_document(alerts: DataFrame, links: DataFrame, events: DataFrame, most: int = 5, most_chars: int = 512) -> DataFrame:
    """tenant_id, alert_id, context: those of with_context()."""
    return with_context(alerts, links, events, most, most_chars).select("tenant_id", "alert_id", "context")


def with_context(alerts: DataFrame, links: DataFrame, events: DataFrame, most: int = 5, most_chars: int = 512) -> DataFrame:
    """alerts with `context`: compact JSON of each alert and, in it, of its first events (the earliest `most` links;
    missing bodies are left out). events(tenant_id, event_id, body): bodies are structs, or JSON text. They are trimmed,
    so raw data does not get there. Columns that alerts lack are null."""
    def of(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in alerts.columns else F.lit(None).cast(kind)

    stamp = lambda c: F.date_format(of(c, "timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSSxxx").alias(c)
    about = F.struct(
        of("title").alias("rule_title"), of("severity").alias("rule_severity"), F.coalesce(of("mitre_technique_ids", "array<string>"), F.array().cast("array<string>")).alias("mitre_technique_ids"),
        F.struct(of("entity_hostname").alias("hostname"), of("entity_user").alias("user")).alias("entity"), of("occurrence_count", "int").alias("occurrence_count"), stamp("first_seen"), stamp("last_seen"))
    first = links.select("tenant_id", "alert_id", "event_id", F.row_number().over(Window.partitionBy("tenant_id", "alert_id").orderBy("created_at", "event_id")).alias("_n")).filter(F.col("_n") <= most)
    kind = events.schema["body"].dataType
    body = F.to_json(trimmed(F.col("body"), kind, most_chars)) if isinstance(kind, T.StructType) else trim_json(F.col("body"), most_chars)
    found = first.join(events.select("tenant_id", "event_id", "body"), ["tenant_id", "event_id"]).select("tenant_id", "alert_id", F.struct("_n", body.alias("_body")).alias("_b"))
    told = found.groupBy("tenant_id", "alert_id").agg(F.array_sort(F.collect_list("_b")).alias("_b"))
    bodies = F.concat_ws(",", F.transform("_b", lambda b: b["_body"]))
    context = F.concat(F.lit('{"alert":'), F.to_json(about, {"ignoreNullFields": "false"}), F.lit(',"events":['), bodies, F.lit("]}"))
    return alerts.join(told, ["tenant_id", "alert_id"], "left").withColumn("context", context).drop("_b")
