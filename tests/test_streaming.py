"""Streams: exact alert state in arrival order, correlation, assets, and the event job from files to detections."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkwarden.rules.content import RULES
from sparkwarden.rules.pack import build_pack
from sparkwarden.streaming import jobs, processors
from tests import simulator
from tests.test_events import LOG, TENANT, observed

T0 = datetime(2026, 7, 8, 10, 0, 0)
HIT = "tenant_id string, rule_id string, entity_key string, kind string, event_id string, event_time timestamp, title string, severity string, entity_hostname string, arrival long"


def drain(spark, path, schema, build, name, out_schema_cols):
    """Run a stateful stream over JSON files, one file a micro-batch."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(path / "in"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # with timers by the clock, they would never end
    q = build(source).writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    return spark.table(name).select(*out_schema_cols).collect()


def write_batches(path, batches):
    (path / "in").mkdir(parents=True)
    for k, rows in enumerate(batches):
        file = path / "in" / f"{k}.json"
        file.write_text("\n".join(json.dumps(r, default=lambda t: t.strftime("%Y-%m-%dT%H:%M:%S.%fZ")) for r in rows))
        os.utime(file, (1_700_000_000 + k, 1_700_000_000 + k))  # files are read by age


def test_alerts_in_arrival_order(spark, tmp_path):
    def h(minutes, event, n, kind="hit"):
        return {"tenant_id": "t", "rule_id": "r", "entity_key": "e", "kind": kind, "event_id": event, "event_time": T0 + timedelta(minutes=minutes), "title": "x", "severity": "high", "entity_hostname": "h", "arrival": n}
    batches = [[h(0, "1", 1), h(60, "2", 2)], [h(60, "2", 3), h(-120, "3", 4)], [h(121, "4", 5)], [h(130, "", 6, "close"), h(131, "5", 7)]]
    write_batches(tmp_path, batches)
    rows = drain(spark, tmp_path, HIT, processors.alert_changes, "alerts_stream", ["alert_id", "change", "event_id", "occurrence_count", "first_seen", "last_seen"])
    got = [(r.change, r.event_id, r.occurrence_count) for r in rows]
    assert got == [("opened", "1", 1), ("updated", "2", 2), ("updated", "3", 3), ("closed", None, 3), ("opened", "4", 1), ("closed", None, 1), ("opened", "5", 1)]
    assert rows[2].last_seen == T0 + timedelta(minutes=60) and rows[2].first_seen == T0 and len({r.alert_id for r in rows}) == 3


def test_correlation_in_arrival_order(spark, tmp_path):
    def c(rule, alert, minutes, n, change="opened"):
        return {"tenant_id": "t", "rule_id": rule, "alert_id": alert, "change": change, "last_seen": T0 + timedelta(minutes=minutes), "entity_hostname": "h", "arrival": n}
    write_batches(tmp_path, [[c("r1", "a", 0, 1)], [c("r1", "b", 5, 2), c("r2", "c", 20, 3)], [c("r3", "d", 100, 4), c("r2", "e", 45, 5)]])
    schema = "tenant_id string, rule_id string, alert_id string, change string, last_seen timestamp, entity_hostname string, arrival long"
    rows = drain(spark, tmp_path, schema, processors.correlated, "groups_stream", ["alert_id", "group_id"])
    assert {"a", "b", "c"} <= {r.alert_id for r in rows} and len({r.group_id for r in rows if r.alert_id in "abc"}) == 1


def test_assets_keep_state_between_batches(spark, tmp_path):
    rows = [observed(1, hostname="A", os_family="linux", device_id="d1", source="agent"), observed(2, 1, hostname="a", os_family="linux", mac="AA"), observed(3, 2, mac="aa")]
    write_batches(tmp_path, [[r] for r in rows])
    got = {r.seq: r for r in drain(spark, tmp_path, LOG, processors.asset_bindings, "assets_stream", ["seq", "asset_id", "created"])}
    assert got[1].created and not got[2].created and len({r.asset_id for r in got.values()}) == 1


def test_event_job_from_files_to_detections(spark, tmp_path):
    raw, base = str(tmp_path / "raw"), str(tmp_path / "out")
    batches = simulator.batches_of(simulator.simulate(spark, 200, TENANT), 50)
    batches.coalesce(1).write.json(raw)
    pack = build_pack("1.0.0", RULES)
    for _ in range(2):  # the second run starts from the checkpoint and finds nothing new
        q = jobs.run_events(spark, raw, base, lambda: pack)
        assert q.awaitTermination(300) and q.exception() is None
    assert spark.read.parquet(f"{base}/events").count() == 200
    batches.coalesce(1).write.mode("append").json(raw)  # delivered again
    jobs.run_events(spark, raw, base, lambda: pack).awaitTermination(300)
    assert spark.read.parquet(f"{base}/events").count() == 200
    hits = spark.read.parquet(f"{base}/detections")
    counts = {r.outcome: r.n for r in spark.read.parquet(f"{base}/metrics").groupBy("outcome").agg(F.sum("n").alias("n")).collect()}
    assert counts["hits"] == 5 and counts["errors"] == 0 and counts["evaluated"] > 200 and spark.read.parquet(f"{base}/evaluation_errors").isEmpty()
    assert hits.count() == 5 and hits.select("event_id").distinct().count() == 5


def test_a_batch_that_died_after_its_events_makes_its_detections(spark, tmp_path, monkeypatch):
    raw, base = str(tmp_path / "raw"), str(tmp_path / "out")
    simulator.batches_of(simulator.simulate(spark, 200, TENANT, start="2026-10-01 00:00:00"), 50).coalesce(1).write.json(raw)
    pack = build_pack("1.0.0", RULES)

    def dies(*_, **__):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(jobs, "evaluate", dies)
        with pytest.raises(Exception, match="lost"):
            jobs.run_events(spark, raw, base, lambda: pack).awaitTermination(300)
    assert spark.read.parquet(f"{base}/events").count() == 200
    q = jobs.run_events(spark, raw, base, lambda: pack)
    assert q.awaitTermination(300) and q.exception() is None
    assert spark.read.parquet(f"{base}/events").count() == 200 and spark.read.parquet(f"{base}/detections").count() == 5


def test_windowed_streams(spark, tmp_path):
    rows = [{"tenant_id": "t", "rule_id": "r", "entity_key": "e", "event_time": T0 + timedelta(minutes=m), "at": T0 + timedelta(minutes=m), "doc_id": str(m // 2), "error": m % 2 == 0} for m in (0, 1, 2, 30, 400, 401)]
    write_batches(tmp_path, [rows, [rows[0] | {"event_time": T0 + timedelta(days=5), "at": T0 + timedelta(days=5), "doc_id": "z"}]])
    schema = "tenant_id string, rule_id string, entity_key string, event_time timestamp, at timestamp, doc_id string, error boolean"
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = {}
    for name, build in (("rates", jobs.rate_windows), ("sessions_w", jobs.session_alerts), ("usage_w", jobs.usage_windows), ("failures_w", jobs.failure_windows), ("failing_w", lambda e: jobs.failing_windows(e, fraction=0.5, tenants=1, least=1)), ("firsts", jobs.first_of_each)):
        q = build(source()).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        out[name] = spark.table(name)
    assert sorted(r.occurrence_count for r in out["sessions_w"].collect()) == [2, 4] and out["usage_w"].agg(F.sum("events")).first()[0] == 6
    assert out["firsts"].count() == 5 and out["rates"].count() > 0 and out["failures_w"].filter("errors > 0").count() > 0 and [r.rule_id for r in out["failing_w"].collect()] == ["r"]
