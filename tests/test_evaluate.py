"""Outcomes of evaluation: isolation of rules that fail, switches, counts by observation, what a failing rule says."""

from dataclasses import fields
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkwarden.operators.usage import failing_rules
from sparkwarden.rules import evaluate
from sparkwarden.rules.compile import Rule
from sparkwarden.rules.content import leaf
from sparkwarden.rules.detect import detect
from sparkwarden.rules.pack import Pack, build_pack

T0 = datetime(2026, 7, 8)
SCHEMA = "tenant_id string, event_id string, event_time timestamp, event_class string, schema_version string, host struct<hostname: string>, user struct<name: string>, dst struct<port: int>, bytes_sent long"
DOC = {"id": "sent", "version": "1.0.0", "title": "Sent", "description": "Bytes sent", "false_positives": [], "references": [], "severity": "low", "event_class": "network_activity", "min_schema_version": "1.0.0", "mitre_technique_ids": ["T1041"], "entity": ["host.hostname", "user.name"]}


class Raising(Rule):
    def matches(self, resolver):
        return F.lit(10) / F.col("dst.port") > 1


class RaisingKey(Rule):
    def entity_key(self, resolver):
        return F.raise_error(F.concat(F.lit("no key for "), F.col("event_id"))).cast("string")


def like(kind, rule, name):
    return kind(**{f.name: getattr(rule, f.name) for f in fields(rule)} | {"id": name})


@pytest.fixture
def pack():
    pack = build_pack("1.0.0", [DOC | {"detection": {"condition": leaf("bytes_sent", "gte", 5)}}])
    healthy = pack.rules[0]
    return Pack("1.0.0", [like(Raising, healthy, "ratio"), healthy, like(RaisingKey, healthy, "key")])


def events(spark, rows):
    full = [(t, e, T0 + timedelta(seconds=k), c, v, ("H",), (u,), (p,), b) for k, (t, e, c, v, u, p, b) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


NET = "network_activity"
ROWS = [("a", "1", NET, "1.0.0", "U", 0, 9), ("a", "2", NET, "1.0.0", None, 5, 9), ("b", "3", NET, "1.2.0", "U", None, 1), ("b", "4", NET, "2.0.0", "U", 0, 9), ("b", "5", None, "1.0.0", "U", 0, 9), ("b", "6", "generic", None, "U", 0, 9)]


def test_a_failing_rule_leaves_other_hits_and_other_events_untouched(spark, pack):
    e = events(spark, ROWS)
    out = evaluate.evaluate(e, pack)
    got = {(r.event_id, r.rule_id): (r.matched, r.error) for r in out.collect()}
    assert got == {
        ("1", "ratio"): (False, True), ("1", "sent"): (True, False), ("1", "key"): (False, True),
        ("2", "ratio"): (True, False), ("2", "sent"): (True, False), ("2", "key"): (False, True),
        ("3", "ratio"): (False, False), ("3", "sent"): (False, False), ("3", "key"): (False, False),
    }
    healthy = Pack("1.0.0", [r for r in pack.rules if r.id == "sent"])
    columns = detect(e, healthy).columns
    mine = evaluate.hits(out, pack).filter("rule_id = 'sent'")
    assert mine.columns == columns and sorted(mine.collect()) == sorted(detect(e, healthy).collect())


def test_rules_that_are_off_are_not_tried(spark, pack):
    e = events(spark, ROWS)
    disabled = spark.createDataFrame([("key",), ("unknown",), (None,)], "rule_id string")
    toggles = spark.createDataFrame([("a", "ratio", False), ("a", "ratio", False), ("b", "sent", True), (None, "sent", False)], "tenant_id string, rule_id string, enabled boolean")
    got = {(r.event_id, r.rule_id): r.error for r in evaluate.evaluate(e, pack, disabled=disabled, toggles=toggles).collect()}
    assert got == {("1", "sent"): False, ("2", "sent"): False, ("3", "ratio"): False, ("3", "sent"): False}
    everything = spark.createDataFrame([(r.id,) for r in pack.rules], "rule_id string")
    assert evaluate.evaluate(e, pack, disabled=everything).isEmpty()
    assert evaluate.evaluate(e.limit(0), pack).isEmpty()


def test_counts_come_from_the_same_scan(spark, pack, tmp_path):
    out, seen = evaluate.observed(evaluate.evaluate(events(spark, ROWS), pack))
    out.filter("matched").write.parquet(str(tmp_path / "hits"))
    assert seen.get == {"evaluated": 9, "hits": 3, "errors": 3}
    out, seen = evaluate.observed(evaluate.evaluate(events(spark, ROWS).limit(0), pack), "none")
    out.write.parquet(str(tmp_path / "none"))
    assert seen.get == {"evaluated": 0, "hits": 0, "errors": 0}


def test_failing_rules_say_why(spark, pack):
    e = events(spark, ROWS)
    told = evaluate.explain_errors(e, evaluate.evaluate(e, pack), pack)
    assert set(told) == {"ratio", "key"} and "DIVIDE_BY_ZERO" in told["ratio"] and "no key for 1" in told["key"]


def test_one_tenant_alone_never_switches_a_rule_off(spark, pack):
    one = [("a", str(k), NET, "1.0.0", "U", 0, 1) for k in range(60)]
    def decided(rows):
        out = evaluate.evaluate(events(spark, rows), pack).select("rule_id", "tenant_id", F.col("event_time").alias("at"), F.col("event_id").alias("id"), "error")
        return failing_rules(out, least=30).collect()
    assert decided(one) == []
    [d] = decided([*one, ("b", "60", NET, "1.0.0", "U", 0, 1), ("c", "61", NET, "1.0.0", "U", 0, 1)])
    assert (d.rule_id, d.tenants_affected, d.samples) == ("ratio", 3, 62)


def test_outcomes_are_one_scan_in_generated_code(spark, pack):
    e = events(spark, ROWS)
    plan = evaluate.evaluate(e, pack)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Generate explode") == 1 and "*(1) Generate" in plan
    assert plan.count("raise_error") == 1 and plan.count("tryeval") == 3  # no rule is worked out twice
