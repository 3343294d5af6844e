"""Evaluation of a pack with its outcomes: a rule that fails on an event is told as that, and neither the event's other
rules nor the rule's other events are touched.

All is one scan without a shuffle but for the tenants' switches. The outcomes feed operators.usage.failing_rules; counts of
them come from an observation in the same pass (`observed`), not from a second scan.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sparkwarden.operators.tenancy import month_of
from sparkwarden.rules.compile import TypedResolver
from sparkwarden.rules.pack import Pack

MAX_ERROR = 1000


def attempt(text: Column) -> Column:
    """A text, or null where working it out raises an error; a null text becomes empty. The error is caught by the try form
    of a conversion around it, so the row stays in generated code."""
    return F.try_to_binary(F.coalesce(text, F.lit("")), F.lit("utf-8")).cast("string")


def switched_on(events: DataFrame, pack: Pack, disabled: DataFrame | None, toggles: DataFrame | None) -> tuple[DataFrame, Pack]:
    """Events with `_off`, the rules that their tenant has switched off, and the pack without those disabled for all. Both
    are cut to the pack's rules first, which bounds them."""
    ids = [r.id for r in pack.rules]
    if disabled is not None:
        gone = {r.rule_id for r in disabled.filter(F.col("rule_id").isin(ids)).select("rule_id").distinct().collect()}
        pack = Pack(pack.version, [r for r in pack.rules if r.id not in gone], pack.errors, pack.hash)
    if toggles is None:
        return events.withColumn("_off", F.array().cast("array<string>")), pack
    off = toggles.filter(~F.col("enabled") & F.col("rule_id").isin(ids)).groupBy("tenant_id").agg(F.collect_set("rule_id").alias("_off"))
    return events.join(off, "tenant_id", "left").withColumn("_off", F.coalesce("_off", F.array().cast("array<string>"))), pack


def evaluate(events: DataFrame, pack: Pack, *, disabled: DataFrame | None = None, toggles: DataFrame | None = None) -> DataFrame:
    """One row for each event and each rule that applies to it and is on: tenant_id, event_id, event_time, rule_id, matched,
    error, entity_key and the event's user (null unless matched), entity_hostname. A rule that is off is not tried, so it cannot fail.

    A failure in making the entity key of a match is the rule's failure too. Events that no rule applies to give no row;
    without a rule that is on there are no rows."""
    events, pack = switched_on(events, pack, disabled, toggles)
    resolver = TypedResolver(events.schema)
    text = lambda path: F.lit(None).cast("string") if resolver.text(path) is None else resolver.text(path)
    tried = F.array().cast("array<struct<rule_id: string, said: string>>")
    for of in sorted({r.event_class for r in pack.rules}):
        by_rule = []
        for r in pack.of(of):
            # Match and key are worked out in one: empty, `=` for a match without a key, or `=` twice and the key.
            said = F.when(r.matches(resolver), F.coalesce(F.concat(F.lit("=="), r.entity_key(resolver)), F.lit("=")))
            on = r.gate(F.col("event_class"), F.col("schema_version")) & ~F.array_contains("_off", r.id)
            by_rule.append(F.when(on, F.struct(F.lit(r.id).alias("rule_id"), attempt(said).alias("said"))))
        tried = F.when(F.col("event_class") == of, F.array(*by_rule)).otherwise(tried)
    # The outer form, as the plain one would add a filter on the array's size that works all rules out a second time.
    rows = events.select("tenant_id", "event_id", "event_time", text("host.hostname").alias("entity_hostname"), text("user.name").alias("_user"), tried.alias("_tried"))
    rows = rows.withColumn("_o", F.explode_outer("_tried")).filter("_o is not null")
    matched = F.coalesce(F.col("_o.said") != "", F.lit(False))
    key = F.when(F.startswith(F.col("_o.said"), F.lit("==")), F.substr(F.col("_o.said"), F.lit(3)))
    return rows.select("tenant_id", "event_id", "event_time", "_o.rule_id", matched.alias("matched"), F.col("_o.said").isNull().alias("error"), key.alias("entity_key"), F.when(matched, F.col("_user")).alias("_user"), "entity_hostname")


def hits(outcomes: DataFrame, pack: Pack) -> DataFrame:
    """The matches among outcomes, as detect() gives them: what a rule says of itself is joined from the pack, which is as
    long as the pack has rules and therefore broadcast."""
    rules = [(r.id, r.version, r.title, r.severity, list(r.techniques), "user.name" in r.entity) for r in pack.rules]
    own = outcomes.sparkSession.createDataFrame(rules, "rule_id string, rule_version string, title string, severity string, mitre_technique_ids array<string>, _names_user boolean")
    index = F.concat(F.lit("events-v1-"), F.col("tenant_id"), F.lit("-"), month_of(F.col("event_time")))
    return outcomes.filter("matched").join(F.broadcast(own), "rule_id").select(
        "tenant_id", "event_id", "event_time", "rule_id", "rule_version", "title", "severity", "mitre_technique_ids", "entity_key",
        F.when(F.col("_names_user"), F.col("_user")).alias("entity_user"), "entity_hostname", index.alias("es_index"), F.lit(pack.version).alias("pack_version"),
    )


def observed(outcomes: DataFrame, name: str = "detection") -> tuple[DataFrame, Observation]:
    """Outcomes, with an observation that holds evaluated, hits, errors once an action has read all of them."""
    seen = Observation(name)
    count = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias
    return outcomes.observe(seen, F.count(F.lit(1)).alias("evaluated"), count("matched")("hits"), count("error")("errors")), seen


def explain_errors(events: DataFrame, outcomes: DataFrame, pack: Pack) -> dict[str, str]:
    """What each failing rule said, on the first event that it failed on. One small job for each failing rule; rules that
    fail are as many as the pack's at most."""
    first = F.min_by(F.struct("tenant_id", "event_id"), F.struct("event_time", "tenant_id", "event_id")).alias("at")
    resolver, rules, told = TypedResolver(events.schema), {r.id: r for r in pack.rules}, {}
    for row in outcomes.filter("error").groupBy("rule_id").agg(first).collect():
        r = rules[row.rule_id]
        one = events.filter((F.col("tenant_id") == row.at.tenant_id) & (F.col("event_id") == row.at.event_id) & (F.col("event_class") == r.event_class))
        try:
            one.select(F.when(r.matches(resolver), F.length(r.entity_key(resolver)))).collect()
            told[r.id] = "did not fail when tried again"
        except (PySparkException, Py4JJavaError) as cause:
            told[r.id] = f"{type(cause).__name__}: {str(cause).splitlines()[0]}"[:MAX_ERROR]
    return told
