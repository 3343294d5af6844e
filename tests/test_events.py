"""Normalising, alerts, assets, scoring, text checks and the query surface."""

import hashlib
import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sparkwarden import schema
from sparkwarden.functions import scoring, summary, text
from sparkwarden.operators import admin, alerts, assets, normalize, queue, triage, usage
from sparkwarden.sources import ingest

T0 = datetime(2026, 7, 8, 10, 0, 0)
TENANT = "00000000-0000-4000-8000-000000000001"
AGENT = {"device_id": "d1", "agent_version": "1", "ingest_key_id": None, "vendor": None, "product": None}
KEY = AGENT | {"device_id": None, "ingest_key_id": "k1"}


def raw(spark, payloads, source_type="agent", source=AGENT):
    rows = [(TENANT, "b1", source_type, T0, tuple(source.values()), k, json.dumps(p)) for k, p in enumerate(payloads)]
    return spark.createDataFrame(rows, f"tenant_id string, batch_id string, source_type string, ingest_time timestamp, source {schema.SOURCE}, ordinal int, p string").withColumn("payload", F.parse_json("p")).drop("p")


LAUNCH = {"event_class": "process_activity", "activity": "process_launched", "source_event_id": "s1", "event_time": "2026-07-08T09:00:00Z", "host": {"hostname": "WS-1", "mac": "AA:BB:CC:00:11:22"}, "user": {"name": "sam"}, "process": {"pid": "12", "name": "a.exe", "cmd_line": "a"}, "parent": {"pid": 1.0, "name": "b.exe"}}


def but(**more):
    return LAUNCH | more


MATRIX = [
    (LAUNCH, None), (but(process={"pid": True, "name": "a", "cmd_line": "a"}), "process: pid and name"), (but(process={"pid": 1.5, "name": "a", "cmd_line": "a"}), "process: pid and name"), (but(process={"pid": 1, "name": 7, "cmd_line": "a"}), "process: pid and name"),
    (but(process={"pid": 1, "name": "a"}), "process.cmd_line"), (but(parent=None), "parent"), (but(user={}), "user.name"), (but(host={}), "host.hostname"), (but(source_event_id=None), "source_event_id"), (but(exit_code=1), "exit_code"),
    (but(process={"pid": 1, "name": "a", "cmd_line": "a", "sha256": "zz"}), "process.sha256"), (but(host={"hostname": "x", "mac": "zz"}), "host.mac"), (but(event_class="nope"), ""),
    ({"event_class": "network_activity", "activity": "connection_opened", "source_event_id": "n", "host": {"hostname": "h"}, "direction": "outbound", "protocol": "tcp", "src": {"ip": "1.1.1.1", "port": 1}, "dst": {"ip": "2.2.2.2", "port": 70000}}, "dst.port"),
    ({"event_class": "network_activity", "activity": "connection_opened", "source_event_id": "n", "host": {"hostname": "h"}, "direction": "outbound", "protocol": "icmp", "src": {"ip": "1.1.1.1"}, "dst": {"ip": "2.2.2.2"}, "bytes_sent": 4}, "bytes_sent"),
    ({"event_class": "authentication", "activity": "logon_failed", "source_event_id": "n", "host": {"hostname": "h"}, "user": {"name": "u"}}, "status"),
    ({"event_class": "authentication", "activity": "logon_failed", "source_event_id": "n", "host": {"hostname": "h"}, "user": {"name": "u"}, "failure_reason": "bad_password"}, None),
]


def test_validation_matrix(spark):
    got = {r.ordinal: r for r in normalize.normalize(raw(spark, [p for p, _ in MATRIX])).collect()}
    for k, (_, place) in enumerate(MATRIX):
        assert (got[k].code is None) == (place is None), (k, got[k].errors)
        assert place is None or place == "" or any(e.startswith(place) for e in got[k].errors), (k, got[k].errors)
    assert got[12].code == "UNKNOWN_EVENT_CLASS"
    r = got[0]
    assert (r.process.pid, r.parent.pid, r.host.hostname, r.host.mac, r.event_time, r.time_inferred) == (12, 1, "ws-1", "aa:bb:cc:00:11:22", datetime(2026, 7, 8, 9), False)


def test_generic_mapping_and_identity(spark):
    payloads = [{"msg": "hello", "odd": 1, "source_event_id": "x"}, {"level": 3}, ["no object"], {"event_class": "generic", "activity": "log", "message": "m", "raw": {"a": "é" * 40_000}, "strange": [1]}, {"msg": "again", "source_event_id": "x"}]
    good, bad = normalize.split_valid(normalize.normalize(raw(spark, payloads, "generic", KEY)))
    rows = {r.ordinal: r for r in good.collect()}
    assert rows[0].message == "hello" and rows[1].message == '{"level":3}' and rows[0].event_class == "generic" and rows[0].time_inferred
    assert rows[3].raw_truncated and len(rows[3].raw.encode()) <= 32 * 1024 and json.loads(rows[3].raw)["truncated_json"] and json.loads(rows[3].unmapped) == {"strange": [1]}
    assert [r.code for r in bad.collect()] == ["EVENT_NOT_AN_OBJECT"]
    assert rows[0].doc_id == rows[4].doc_id
    stored = good.filter("ordinal = 1").withColumn("month", F.lit("2026.07"))
    assert sorted(r.ordinal for r in normalize.first_deliveries(good, stored).collect()) == [0, 3]


def test_batches_and_envelopes(spark):
    bodies = spark.createDataFrame([("ok", '{"events":[{"a":1},{"b":2}]}'), ("empty", '{"events":[]}'), ("bad", "nope"), ("list", "[1]"), ("many", json.dumps({"events": [{}] * 1001}))], "tenant_id string, body string")
    good, rejected = ingest.admit_bodies(bodies)
    assert {r.tenant_id for r in good.collect()} == {"ok", "empty"} and {r.tenant_id: r.code for r in rejected.collect()} == {"bad": "BODY_MALFORMED", "list": "BODY_MALFORMED", "many": "TOO_MANY_EVENTS"}
    sent = ingest.to_envelope(spark.createDataFrame([(TENANT, "t", 1, None)], "tenant_id string, trace_id string, a int, b string"), ["a", "b"])
    assert sent.first().payload == '{"a":1}'
    messages = sent.union(spark.createDataFrame([("x", "t", "{}"), (TENANT, "t", "{oops")], sent.schema))
    decoded, malformed = ingest.from_envelope(messages, "a int, b string")
    assert [r.a for r in decoded.collect()] == [1] and malformed.count() == 2


def hit(rule, minutes, event_id, host="h1", entity="e1", severity="high"):
    return ("t1", rule, entity, event_id, T0 + timedelta(minutes=minutes), rule, severity, "1", host, None)


HITS = "tenant_id string, rule_id string, entity_key string, event_id string, event_time timestamp, title string, severity string, rule_version string, entity_hostname string, entity_user string"


def test_alerts_by_session(spark):
    rows = [hit("r1", 0, "1"), hit("r1", 60, "2"), hit("r1", 60, "2"), hit("r1", 120 + 1 / 60_000_000, "3"), hit("r2", 10, "4"), hit("r3", 240, "5")]
    df = spark.createDataFrame(rows, HITS)
    known = spark.createDataFrame([("t1", "a1", "H1", "healthy", T0, "active"), ("t1", "a2", "h1", "offline", T0 - timedelta(1), "active")], "tenant_id string, asset_id string, hostname string, agent_status string, last_seen timestamp, state string")
    got = {(r.rule_id, r.session): r for r in alerts.alerts(df, known).collect()}
    assert {k: r.occurrence_count for k, r in got.items()} == {("r1", 1): 2, ("r1", 2): 1, ("r2", 1): 1, ("r3", 1): 1}
    assert got["r1", 1].state == "closed" and got["r1", 1].close_reason == "resolved" and got["r1", 2].state == "new"
    assert got["r2", 1].priority_score == 68 and got["r2", 1].priority_inputs.agent_status == "healthy"
    assert {r.priority_score for r in alerts.alerts(df).filter("rule_id = 'r2'").collect()} == {70}
    groups = alerts.correlation_groups(alerts.alerts(df), alerts.alert_events(df)).collect()
    assert {g.alert_id for g in groups} == {got["r1", 1].alert_id, got["r2", 1].alert_id} and len({g.group_id for g in groups}) == 1


def test_action_log(spark):
    a = spark.createDataFrame([("t1", "a", "new", None), ("t1", "b", "new", None)], "tenant_id string, alert_id string, state string, close_reason string")
    log = [("a", "reopen", None), ("a", "acknowledge", None), ("a", "close", "noise"), ("a", "acknowledge", None), ("a", "reopen", None)]
    actions = spark.createDataFrame([(i, x, r, "me", T0, k) for k, (i, x, r) in enumerate(log)], "alert_id string, action string, reason string, actor string, at timestamp, seq long")
    after, history = alerts.apply_actions(a, actions)
    assert {r.alert_id: (r.state, r.close_reason) for r in after.collect()} == {"a": ("new", None), "b": ("new", None)}
    assert [(r.from_state, r.to_state, r.outcome) for r in history.orderBy("seq").collect()] == [("new", None, "conflict"), ("new", "acknowledged", "ok"), ("acknowledged", "closed", "ok"), ("closed", None, "conflict"), ("closed", "new", "ok")]


VECTORS = [
    ("low", None, 1, "healthy", 26), ("medium", None, 1, "none", 49), ("medium", "high", 3, "healthy", 61), ("high", "medium", 1, "healthy", 57), ("high", "high", 7, "offline", 80), ("critical", None, 1, "healthy", 85),
    ("critical", "critical", 25, "offline", 100), ("critical", "low", 2, "none", 83), ("low", "critical", 20, "revoked", 70), ("medium", "medium", 5, "enrolled", 54), ("high", "low", 1, "healthy", 57), ("medium", "low", 1, "healthy", 36),
]


def test_score_vectors_and_properties(spark):
    df = spark.createDataFrame(VECTORS, "r string, ai string, n int, st string, want int")
    score = scoring.priority(F.col("r"), F.col("ai"), F.col("n"), F.col("st"))
    assert [x for x in df.withColumn("got", score).collect() if x.got != x.want] == []
    values = lambda name, vs: spark.createDataFrame([(v,) for v in vs], name)
    grid = values("r string", scoring.SEVERITIES).join(values("ai string", [None, *scoring.SEVERITIES]), how="cross").join(values("n int", [1, 2, 4, 5, 19, 20, 1000]), how="cross").join(values("st string", list(scoring.ASSET_POINTS)), how="cross")
    rows = grid.withColumn("s", score).withColumn("e", scoring.effective_severity(F.col("r"), F.col("ai"))).collect()
    tier = scoring.SEVERITIES.index
    assert len(rows) == 700 and all(0 <= x.s <= 100 for x in rows) and all(tier(x.e) >= tier(x.r) - 1 for x in rows)
    by = {(x.r, x.ai, x.n, x.st): x.s for x in rows}
    assert all(by[r, ai, 20, st] >= by[r, ai, 5, st] >= by[r, ai, 1, st] for r, ai, _, st in by)


def observed(seq, minutes=0, source="log_ingest", tenant="t1", **more):
    base = dict.fromkeys(("hostname", "os_family", "os_name", "os_version", "ip", "mac", "device_id", "action", "asset_ids", "identities"))
    return base | {"tenant_id": tenant, "seq": seq, "observed_at": T0 + timedelta(minutes=minutes), "source": source} | more


LOG = "tenant_id string, seq long, observed_at timestamp, source string, hostname string, os_family string, os_name string, os_version string, ip string, mac string, device_id string, action string, asset_ids array<string>, identities array<string>"


def log_frame(spark, rows):
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in LOG.split(", ")) for r in rows], LOG)


def test_asset_identity(spark):
    rows = [
        observed(1, hostname="A", os_family="linux", device_id="d1", source="agent"), observed(2, 1, hostname="a", os_family="linux", mac="AA"), observed(3, 2, hostname="a", os_family="linux", device_id="d2", source="agent"),
        observed(4, 3, mac="aa"), observed(5), observed(6, device_id="d2"), observed(7, hostname="A", os_family="linux", tenant="t2"),
    ]
    got = {r.seq: r for r in assets.resolve(log_frame(spark, rows)).collect()}
    assert got[1].asset_id == got[2].asset_id == got[4].asset_id and got[3].asset_id == got[6].asset_id != got[1].asset_id and got[7].asset_id not in (got[1].asset_id, got[3].asset_id) and 5 not in got
    assert [got[k].matched_rule for k in (2, 4, 6)] == ["hostname_os", "mac_exact", "device_id_exact"] and got[2].bound == ["mac:aa"] and got[3].created
    one, two = got[1].asset_id, got[3].asset_id
    rows += [observed(8, action="merge", asset_ids=[one, two]), observed(9, device_id="d2"), observed(10, action="split", asset_ids=[one], identities=["device_id:d2"]), observed(11, device_id="d2", hostname="a", os_family="linux")]
    again = {r.seq: r for r in assets.resolve(log_frame(spark, rows)).collect()}
    assert again[9].asset_id == one and again[11].asset_id == again[10].asset_id not in (one, two)
    final = {r.asset_id: r for r in assets.assets(log_frame(spark, rows)).collect()}
    assert final[two].state == "merged" and final[one].sources == ["agent", "log_ingest"] and final[again[10].asset_id].dedup_rule == "manual_split"


GOOD = "What happened: sam ran an odd tool on fin-laptop-07.\nWhy it matters: Someone may be using this computer.\nDo this next: Ask sam whether this was them."
SUMMARIES = [
    (GOOD, None), ("one line", "structure"), (GOOD.replace("Why it matters", "Why"), "structure"), (GOOD + " word" * 120, "length"), (GOOD + "!", "format"), (GOOD.replace("odd", "**odd**"), "format"), (GOOD.replace("odd", "odd \U0001F600"), "format: emoji"),
    (GOOD.replace("odd", "Lateral Movement"), "jargon"), (GOOD.replace("odd", "phishing"), "jargon: 'phishing'"), (GOOD.replace("odd tool", "phishing trick"), None), (GOOD.replace("fin-laptop-07", "web-server-9"), "entity"), (GOOD.replace("odd", "m.rivera"), "entity"),
    (GOOD.replace("odd", "a" * 45), "content"), (GOOD.replace("Someone", "The host"), "jargon"),
]


def test_summary_checks(spark):
    df = spark.createDataFrame([(k, s) for k, (s, _) in enumerate(SUMMARIES)], "k int, s string")
    rows = df.select("k", summary.summary_errors(F.col("s"), F.lit("fin-laptop-07"), F.lit("sam")).alias("e"), summary.parse_lines(F.col("s")).alias("p")).collect()
    for r in rows:
        want = SUMMARIES[r.k][1]
        assert (not r.e) if want is None else any(e.startswith(want) for e in r.e), (r.k, r.e)
    assert rows[0].p.happened == "sam ran an odd tool on fin-laptop-07." and rows[1].p is None
    fake = spark.range(1).select(summary.fake_summary(F.lit("h"), F.lit("u"), F.lit(3), F.lit(T0)).alias("s")).select("s", summary.summary_errors(F.col("s"), F.lit("h"), F.lit("u")).alias("e")).first()
    assert fake.e == []
    answers = spark.createDataFrame([('```json\n{"summary":"s","ai_severity":"HIGH"}\n```',), ('{"summary":"","ai_severity":"low"}',), ("none",), ('x {"summary":"s","ai_severity":"odd"}',)], "a string")
    assert [r.r and tuple(r.r) for r in answers.select(summary.read_answer(F.col("a")).alias("r")).collect()] == [("s", "high"), None, None, None]


def test_text_functions(spark):
    words = ["Straße", "ΣΊΣΥΦΟΣ", "ſ", "ı", "İ", "ß", "ŉ", "Ꭰ", "ꭰ", "plain ASCII"]
    got = [r.f for r in spark.createDataFrame([(w,) for w in words], "w string").select(text.fold(F.col("w")).alias("f")).collect()]
    assert got == [w.casefold() for w in words]
    s = "aé€😀" * 5
    for n in range(0, 30):
        cut = spark.createDataFrame([(s,)], "s string").select(text.byte_prefix(F.col("s"), n)).first()[0] if n % 7 == 0 else None
        assert cut is None or cut == s.encode()[:n].decode("utf-8", "ignore")
    doc = json.dumps({"a": {"Password": 'x"y', "n": 1}, "api_key": None, "monkey": "m", "list": [{"token": 5}]})
    out = json.loads(spark.createDataFrame([(doc,)], "d string").select(text.redact_json(F.col("d"))).first()[0])
    assert out == {"a": {"Password": "[REDACTED]", "n": 1}, "api_key": "[REDACTED]", "monkey": "m", "list": [{"token": "[REDACTED]"}]}
    m = spark.sql("select map('user_key', 'v', 'keyed', 'w') as m").select(text.redact_map(F.col("m"))).first()[0]
    assert m == {"user_key": "[REDACTED]", "keyed": "w"}


def test_pages_walk_through_everything(spark):
    df = spark.range(0, 23).select(F.col("id").alias("alert_id"), (F.col("id") % 3).alias("priority_score"), (F.col("id") % 5).alias("last_seen"))
    for name, order in queue.ALERT_SORTS.items():
        seen, cursor = [], None
        while True:
            page = queue.keyset_page(df, order, limit=7, cursor=cursor).collect()
            seen += [r.alert_id for r in page[:7]]
            if len(page) <= 7:
                break
            cursor = queue.decode_cursor(queue.encode_cursor(page[6].asDict()))
        assert sorted(seen) == list(range(23)), name
    with pytest.raises(ValueError):
        queue.keyset_page(df, order, limit=201)
    with pytest.raises(ValueError):
        queue.decode_cursor("%%%")


def test_jobs(spark):
    tenants = spark.createDataFrame([("t1", "trial", "active", T0 - timedelta(1)), ("t2", "core", "active", None), ("t3", "trial", "frozen", T0 - timedelta(9))], "tenant_id string, plan_id string, status string, trial_expires_at timestamp")
    assert {r.tenant_id: r.status for r in admin.freeze_expired_trials(tenants, T0).collect()} == {"t1": "frozen", "t2": "active", "t3": "frozen"}
    after, audit = admin.change_plan(tenants, spark.createDataFrame([("t3", "pro", "op", T0)], "tenant_id string, plan_id string, actor string, at timestamp"))
    row = {r.tenant_id: r for r in after.collect()}["t3"]
    assert (row.plan_id, row.status, row.trial_expires_at) == ("pro", "active", None) and json.loads(audit.first().after) == {"plan_id": "pro", "status": "active"}
    parts = spark.createDataFrame([("t", "2026.03"), ("t", "2026.06"), ("t", "2026.07"), ("t", "garbage")], "tenant_id string, month string")
    expired = lambda n: {r.month for r in admin.expired_partitions(parts, spark.createDataFrame([("t", n)], "tenant_id string, days int"), T0).collect()}
    assert expired(14) == {"2026.03"} and expired(1) == {"2026.03", "2026.06"}
    with pytest.raises(ValueError):
        admin.purge_audit(parts, T0, 30)
    assert schema.purge_order(["alerts", "new_table", "alert_events"]) == ["new_table", "alert_events", "alerts"]
    config = ingest.plan_config(spark)
    values = admin.entitlement_maps(admin.entitlements(tenants, config, spark.createDataFrame([("t2", "endpoint_cap", "7", None)], "tenant_id string, key string, value string, expires_at timestamp"), T0))
    got = {r.tenant_id: r.entitlements for r in values.collect()}
    assert got["t2"]["endpoint_cap"] == "7" and got["t1"]["endpoint_cap"] == "100" and "trial_duration_days" not in got["t1"] and ingest.platform_config(spark).count() == 19
    gates = spark.createDataFrame([("active", False), ("active", True), ("frozen", False), ("purged", False), ("odd", False)], "s string, f boolean").select(admin.tenant_gate(F.col("s"), F.col("f"))).collect()
    assert [g[0] for g in gates] == [None, "TENANT_ABUSE_FROZEN", "TENANT_FROZEN", "TENANT_PURGED", "TENANT_NOT_ACTIVE"]


def test_buffer_and_audit(spark, tmp_path):
    for name, lines in (("network", ["%020d {\"a\":1}" % 3, "%020d {\"a\":" % 4]), ("auth", ["%020d {\"b\":2}" % 1, "torn"])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "000.log").write_text("\n".join(lines) + "\n")
    rows, bad = ingest.read_buffer(spark, str(tmp_path / "*"))
    assert [(r.seq, r["class"]) for r in usage.merged_in_order(rows).collect()] == [(1, "auth"), (3, "network")] and bad.count() == 2
    log = ingest.audit_rows(spark.range(1).withColumn("tenant_id", F.lit("t")), F.lit("me"), F.lit("x"), F.lit("y"), F.lit('{"token":"a"}'), F.lit('{"v":"' + "z" * 20_000 + '"}'), F.lit(None).cast("string"), F.lit(T0)).first()
    assert log.before == '{"token":"[REDACTED]"}' and log.after == '{"too_large":true}'
    assert {r.segment for r in rows.collect()} == {"000.log"}


def test_triage_tries_twice_and_keeps_to_the_budget(spark):
    rows = [(f"t{k % 2}", f"a{k}", "r", "title", "high", 1, T0 + timedelta(minutes=k), "fin-laptop-07", "sam", "none") for k in range(4)]
    df = spark.createDataFrame(rows, "tenant_id string, alert_id string, rule_id string, title string, severity string, occurrence_count int, last_seen timestamp, entity_hostname string, entity_user string, agent_status string")
    links = spark.createDataFrame([("t0", "a0", "e1", T0)], "tenant_id string, alert_id string, event_id string, created_at timestamp")
    bodies = spark.createDataFrame([("t0", "e1", "{}")], "tenant_id string, event_id string, body string")
    bad = lambda context: F.lit("not json")
    lower = lambda context: F.to_json(F.struct(F.lit(GOOD).alias("summary"), F.lit("low").alias("ai_severity")))
    said = lambda **k: {r.alert_id: r.outcome for r in triage.triage(df, links, bodies, **k).collect()}
    assert set(said().values()) == {"ok"} and set(said(scorer=bad).values()) == {"invalid"} and set(said(scorer=bad, again=lower).values()) == {"ok"}
    assert said(daily_tokens=1) == {"a0": "ok", "a1": "ok", "a2": "over_budget", "a3": "over_budget"}
    done = {r.alert_id: r for r in triage.apply_triage(df, triage.triage(df, links, bodies, scorer=lower)).collect()}
    assert done["a0"].priority_score == 59 and done["a0"].summary == GOOD and done["a0"].priority_inputs.ai_effective == "medium"


def test_triage_charges_what_tries_cost(spark):
    """In and out of every try; a second try only where the first failed; nothing for what is skipped."""
    rows = [("t", f"a{k}", "r", "title", "high", 1, T0 + timedelta(minutes=k), "fin-laptop-07", "sam", "none") for k in range(5)]
    df = spark.createDataFrame(rows, "tenant_id string, alert_id string, rule_id string, title string, severity string, occurrence_count int, last_seen timestamp, entity_hostname string, entity_user string, agent_status string")
    links = spark.createDataFrame([], "tenant_id string, alert_id string, event_id string, created_at timestamp")
    bodies = spark.createDataFrame([], "tenant_id string, event_id string, body string")
    good = F.to_json(F.struct(F.lit(GOOD).alias("summary"), F.lit("low").alias("ai_severity")))
    first = lambda context: F.when(F.col("alert_id") == "a1", F.lit("not json")).otherwise(good)
    asked = lambda context: F.when(context.isNotNull(), good)
    got = {r.alert_id: r for r in triage.triage(df, links, bodies, scorer=first, again=asked).collect()}
    assert all(r.outcome == "ok" for r in got.values()) and 2 * got["a0"].tokens_in < got["a1"].tokens_in < 2 * got["a0"].tokens_in + 40 and got["a1"].tokens_out > got["a0"].tokens_out
    cost = {k: r.tokens_in + r.tokens_out for k, r in got.items()}
    for cap, n in ((cost["a0"], 1), (cost["a0"] + 1, 2), (cost["a0"] + cost["a1"], 2), (cost["a0"] + cost["a1"] + 1, 3)):
        said = {r.alert_id: r for r in triage.triage(df, links, bodies, scorer=first, again=asked, daily_tokens=cap).collect()}
        assert [said[f"a{k}"].outcome for k in range(5)] == ["ok"] * n + ["over_budget"] * (5 - n) and all(said[f"a{k}"].tokens_in == 0 for k in range(n, 5))


def test_correlation_joins_what_another_rule_showed_lately(spark):
    def one(rule, alert, first, last, host="h"):
        return ("t", host, "al_" + alert, rule, alert, 1, T0 + timedelta(minutes=first), T0 + timedelta(minutes=last))
    schema = "tenant_id string, entity_hostname string, alert_id string, rule_id string, entity_key string, session int, first_seen timestamp, last_seen timestamp"

    def groups(rows, between=()):
        """Hits of an alert: its first, its last, and those of `between`(alert, minute)."""
        df = spark.createDataFrame(rows, schema)
        seen = {("t", r[2], f"{r[2]}-{at}", at) for r in rows for at in (r[6], r[7])} | {("t", "al_" + a, f"{a}-{m}", T0 + timedelta(minutes=m)) for a, m in between}
        links = spark.createDataFrame(sorted(seen), "tenant_id string, alert_id string, event_id string, created_at timestamp")
        return {r.alert_id[3:]: (r.group_id, r.opens) for r in alerts.correlation_groups(df, links).collect()}

    got = groups([one("r1", "A", 0, 0), one("r1", "B", 20, 20), one("r2", "C", 45, 45)])
    assert set(got) == {"B", "C"} and got["B"][0] == got["C"][0] and got["C"][1] and not got["B"][1]
    got = groups([one("r1", "A", 0, 0), one("r2", "B", 30, 30), one("r2", "C", 61, 61), one("r1", "D", 200, 200), one("r2", "E", 200, 200, "g")])
    assert set(got) == {"A", "B"}
    # A's hits at 0 and 55 minutes: at minute 45 it was last seen 45 minutes ago, whatever came later.
    assert groups([one("r1", "A", 0, 55), one("r2", "B", 45, 45)]) == {} and set(groups([one("r1", "A", 0, 55), one("r2", "B", 45, 45)], [("A", 15)])) == {"A", "B"}
    rng = random.Random(4)
    rows, between = [], []
    for k in range(400):
        first = rng.randrange(9000)
        last = first + rng.choice([0, 0, 5, 70, 130])
        rows.append(one(f"r{rng.randrange(4)}", f"{k:03d}", first, last, f"h{rng.randrange(3)}"))
        between += [(f"{k:03d}", rng.randint(first, last)) for _ in range(rng.randrange(4))]
    when = {r[4]: [r[6], r[7]] + [T0 + timedelta(minutes=m) for a, m in between if a == r[4]] for r in rows}
    expected, window = {}, timedelta(minutes=30)
    for host in ("h0", "h1", "h2"):
        seen = []
        for r in sorted((r for r in rows if r[1] == host), key=lambda r: (r[6], r[3], r[4])):
            upto = {o[4]: max(t for t in when[o[4]] if t <= r[6]) for o in seen}
            others = sorted((o for o in seen if o[3] != r[3] and upto[o[4]] >= r[6] - window), key=lambda o: (upto[o[4]], o[2]), reverse=True)
            if others:
                group = next((expected[o[4]][0] for o in others if o[4] in expected), None)
                expected |= {o[4]: (group or "cg_" + r[4], False) for o in others if o[4] not in expected} | {r[4]: (group or "cg_" + r[4], group is None)}
            seen.append(r)
    assert groups(rows, between) == expected and len({g for g, _ in expected.values()}) > 20


def test_context_holds_trimmed_events(spark):
    """Raw data, at any depth, does not get there; both forms of a body give the same."""
    about = spark.createDataFrame([("t", "a", "Title", "high", 2, "h", None)], "tenant_id string, alert_id string, title string, severity string, occurrence_count int, entity_hostname string, entity_user string")
    links = spark.createDataFrame([("t", "a", f"e{k}", T0 + timedelta(minutes=k)) for k in range(7)], "tenant_id string, alert_id string, event_id string, created_at timestamp")
    one = lambda k: {"message": "hé\u0001llo", "raw": "secret", "process": {"cmd_line": "x y" * 500, "unmapped": {"a": "secret"}, "pids": list(range(20)), "blob": "QQ" * 64}, "notes": {"source": "secret", "k": str(k)}, "tenant_id": "t"}
    kind = "struct<message:string,raw:string,process:struct<cmd_line:string,unmapped:map<string,string>,pids:array<int>,blob:string>,notes:map<string,string>,tenant_id:string>"
    typed = spark.createDataFrame([("t", f"e{k}", one(k)) for k in (0, 2, 4, 6)], f"tenant_id string, event_id string, body {kind}")
    plain = spark.createDataFrame([("t", f"e{k}", json.dumps(one(k))) for k in (0, 2, 4, 6)] + [("t", "e1", "[1]"), ("t", "e3", None)], "tenant_id string, event_id string, body string")
    first = json.loads(queue.context_document(about, links, typed).first().context)
    assert first == json.loads(queue.context_document(about, links, plain).first().context)
    assert first["alert"] == {"rule_title": "Title", "rule_severity": "high", "mitre_technique_ids": [], "entity": {"hostname": "h", "user": None}, "occurrence_count": 2, "first_seen": None, "last_seen": None}
    assert [e["notes"] for e in first["events"]] == [{"k": "0"}, {"k": "2"}, {"k": "4"}] and "secret" not in str(first)
    body = first["events"][0]
    assert set(body) == {"message", "process", "notes"} and body["message"] == "hé llo" and body["process"]["pids"] == list(range(16)) and body["process"]["blob"] == "[blob-removed]"
    assert len(body["process"]["cmd_line"]) == 512 + len("…[truncated]")
    empty = queue.context_document(about, links.limit(0), plain.limit(0)).first().context
    assert json.loads(empty)["events"] == []


def test_redaction_walks_all_shapes(spark):
    deep = "1"
    for _ in range(23):
        deep = '{"a":' + deep + "}"
    docs = ['{"pass\\u0077ord":{"value":"x"},"tokens":["a"],"api_keys":[1],"keyboard":{"x":"é"}}', '[{"token":1}]', "nothing", None, deep]
    got = [r[0] for r in spark.createDataFrame([(d,) for d in docs], "d string").select(text.redact_json(F.col("d"))).collect()]
    assert json.loads(got[0]) == {"password": "[REDACTED]", "tokens": "[REDACTED]", "api_keys": "[REDACTED]", "keyboard": {"x": "é"}}
    assert got[1:4] == [None] * 3 and got[4].count("{") == 21 and "[REDACTED]" in got[4]


def test_unmapped_is_merged(spark):
    payload = '{"event_class":"authentication","activity":"logon","status":"success","user":{"name":"u"},"event_time":"2024-01-05T10:00:00Z","unmapped":{"prior":true,"extra":0},"extra":{"n":1},"void":null}'
    source = "named_struct('device_id', cast(null as string), 'agent_version', cast(null as string), 'ingest_key_id', 'k', 'vendor', cast(null as string), 'product', cast(null as string))"
    raw = spark.sql(f"select '{TENANT}' as tenant_id, 'b' as batch_id, 'generic' as source_type, timestamp'2024-01-05' as ingest_time, {source} as source, 0 as ordinal, parse_json('{payload}') as payload")
    assert json.loads(normalize.normalize(raw).first().unmapped) == {"prior": True, "extra": {"n": 1}}


def test_ulids_sort_by_time(spark):
    rows = [(T0 + timedelta(milliseconds=k * 37), f"s{k}") for k in range(200)]
    ids = [r[0] for r in spark.createDataFrame(rows, "at timestamp, s string").select(text.ulid(F.col("at"), F.col("s"))).collect()]
    assert ids == sorted(ids) and len(set(ids)) == 200 and {len(i) for i in ids} == {26} and set("".join(ids)) <= set(text.CROCKFORD)
    alphabet = text.CROCKFORD
    value = 0
    for c in ids[3]:
        value = value * 32 + alphabet.index(c)
    assert value >> 80 == int(rows[3][0].replace(tzinfo=rows[3][0].tzinfo or timezone.utc).timestamp() * 1000) and value & ((1 << 80) - 1) == int(hashlib.sha256(b"s3").hexdigest()[:20], 16)


def test_correlation_makes_no_more_than_its_pairs_and_shuffles_none_of_them(spark):
    """Two rules with 300 alerts each on one host: 60,000 pairs and more, while what is shuffled are alerts and hits."""
    rows = [hit(rule, m / 10, f"{rule}-{k}-{m}", entity=f"e{k}") for rule in ("r1", "r2") for k in range(300) for m in (k, k + 3, k + 100)]
    df = spark.createDataFrame(rows, HITS)
    when = {}
    for _, rule, entity, _, at, *_ in rows:
        when.setdefault((rule, entity), []).append(at)
    expected = {}
    for a, own in when.items():
        for b, seen in when.items():
            last = max((t for t in seen if t <= min(own)), default=None)
            if a[0] != b[0] and last and last >= min(own) - timedelta(minutes=30):
                expected[a, b] = last
    pairs = alerts.candidates(alerts.alerts(df), alerts.alert_events(df), carry=("entity_key",))
    got = [((r.rule_id, r.entity_key), (r.other_rule, r.other_entity_key), r.other_last) for r in pairs.collect()]
    assert len(got) == len(expected) > 40_000 and {(a, b): t for a, b, t in got} == expected
    plan = lambda q: q._jdf.queryExecution().optimizedPlan().toString()
    above = plan(pairs).split("(entity_hostname#")[0]  # all that is done after the join on tenant, host and slot
    assert above.count("Join") == 1 and "Aggregate" not in above and "Window" not in above
    assert "NOT (rule_id#" not in plan(alerts.correlation_groups(alerts.alerts(df), alerts.alert_events(df)))  # no pairs


def test_correlation_finds_hits_within_long_runs(spark):
    """Many hits of one alert in a slot: the last one before another alert opens is found among them, and over the slot's end."""
    df = spark.createDataFrame([hit("r1", k / 10, f"a{k}") for k in range(400)] + [hit("r2", m, f"b{m}", entity=f"x{m}") for m in (0, 0.05, 3.25, 29.95, 30, 39.9, 69.9, 69.95)], HITS)
    pairs = alerts.candidates(alerts.alerts(df), alerts.alert_events(df), carry=("entity_key",)).filter("rule_id = 'r2'")
    got = {r.entity_key[1:]: round((r.other_last - T0).total_seconds() / 6) for r in pairs.collect()}
    assert got == {"0": 0, "0.05": 0, "3.25": 32, "29.95": 299, "30": 300, "39.9": 399, "69.9": 399}


def test_summary_checks_tell_what_their_patterns_tell(spark):
    """Whatever is looked for first: banned terms in every form, with odd neighbours and case, next to and within each other."""
    import itertools
    import re
    forms = """lateral movement|c2|command and control|command-and-control|beacon|beaconing|beacons|callback|callbacks|exfiltration|exfiltrated|persistence|privilege escalation|
        credential dumping|credential access|brute force|brute-forcing|payload|payloads|dropper|droppers|implants|rat|rats|reverse shell|shell access|obfuscated|encoded|process injection|
        living off the land|lolbin|lolbins|enumerates|recon|discovery|ioc|iocs|indicator|indicators|threat actor|threat actors|adversary|adversaries|ttp|ttps|endpoint|endpoints|host|hosts|
        compromised|mitigate|remediation|exploits|zero-day|zero days|cve-2024|process|command|shell|rating|hosting|encodedx|c25|reverse shell access|credential host|phishing|phishing tricks"""
    forms = [f.strip() for f in forms.split("|")]
    around = ["{}", "{}.", "x{}", "({})", "-{}", "é{}", "{}é", "_{}", "{}\n", "a {}, {} b", "™{}", "K{}", "İ{}", "1{}", "sam {}?"]
    texts = [a.format(f, f) for f in forms for a in around] + [a.format(f.upper(), f.title()) for f in forms for a in around[:6]] + [f"{a} {b}" for a, b in itertools.product(forms[::3], forms[::2])]
    texts += ["w " * n for n in (119, 120, 121, 122)] + ["a b " * 70, "x" * 31, "x" * 39, "x" * 40, "see " + "A" * 40 + ".", "ab" * 16, "ab " * 16, "✨ ok", "\U0001f600", "fin-laptop-08 and fin-laptop-07", "bob.smith", "Bob.smith", "a.b", "a. b"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, s string")
    for r in df.select("k", "s", summary.summary_errors(F.col("s"), F.lit("fin-laptop-07"), F.lit("sam")).alias("e"), F.array(*[F.col("s").rlike(f"(?i){p}") for p in summary.JARGON.values()]).alias("j"), F.col("s").rlike(summary.EMOJI).alias("emoji"), F.col("s").rlike(summary.BLOB_LIKE).alias("blob"), F.expr(r"exists(split(s, '[.?]'), x -> x rlike '(?i)\\bphishing\\b' and not x rlike '(?i)\\btrick')").alias("p"), F.regexp_extract_all("s", F.lit(summary.HOST_LIKE), F.lit(0)).alias("h"), F.regexp_extract_all("s", F.lit(summary.USER_LIKE), F.lit(0)).alias("u")).collect():
        assert [e for e in r.e if "banned term" in e] == [f"jargon: banned term ({n})" for n, found in zip(summary.JARGON, r.j) if found], r.s
        assert (any("emoji" in e for e in r.e), any("blob" in e for e in r.e), any("gloss" in e for e in r.e)) == (r.emoji, r.blob, r.p), r.s
        assert sum(e.startswith("entity:") for e in r.e) == sum(t not in ("fin-laptop-07", "sam") for t in r.h + r.u), r.s
        assert any(e.startswith("length:") for e in r.e) == (len([w for w in re.split(r"[ \t\n\x0b\f\r]+", r.s) if w]) > 120), r.s
    answers = ["", "no", "{}", '{"summary":"s","ai_severity":"LOW"}', '```json\n{"summary":"s","ai_severity":"low"}\n```', 'so: {"summary":"s","ai_severity":"low"} yes', '{"summary":" ","ai_severity":"low"}', '{"summary":"s","ai_severity":"x"}', '{"summary":"s"', None]
    got = spark.createDataFrame([(k, a) for k, a in enumerate(answers)], "k int, a string").select("k", summary.read_answer(F.col("a")).alias("r"))
    assert {r.k: r.r and tuple(r.r) for r in got.collect()} == {k: ("s", "low") if k in (3, 4, 5) else None for k in range(len(answers))}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_correlation_asks_of_pairs_what_generated_code_can_tell(spark):
    """Of many hits in a slot, some at one time and at that of an opening; the join and all above it have no lambda."""
    rng = random.Random(5)
    rows = [hit(rule, m, f"{rule}-{e}-{k}", entity=f"{rule}{e}") for rule in ("r1", "r2", "r3") for e in range(6) for k, m in enumerate(sorted(rng.choice(range(400)) / 4 + (80 * e if k > 60 else 0) for k in range(90)))]
    df = spark.createDataFrame(rows, HITS)
    own = {}
    for a in alerts.sessions(df, alerts.KEY, "event_time", ["event_id"]).collect():
        own.setdefault((a.rule_id, a.entity_key, a.session), []).append(a.event_time)
    expected = {}
    for a, seen in own.items():
        for b, others in own.items():
            last = max((t for t in others if t <= min(seen)), default=None)
            if a[0] != b[0] and last and last >= min(seen) - timedelta(minutes=30):
                expected[a, b] = last
    pairs = alerts.candidates(alerts.alerts(df), alerts.alert_events(df), carry=("entity_key", "session"))
    got = [((r.rule_id, r.entity_key, r.session), (r.other_rule, r.other_entity_key, r.other_session), r.other_last) for r in pairs.collect()]
    assert len(got) == len(expected) > 50 and {(a, b): t for a, b, t in got} == expected
    lines = pairs._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("lambda" in line for line in lines[:next(k for k, line in enumerate(lines) if "Join" in line) + 1])
