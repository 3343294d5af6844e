"""State that ends, timers, retries, snapshots, and identity by component against a plain replay."""

import random
import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from sparkwarden.operators import assets, usage
from sparkwarden.operators.components import components
from sparkwarden.sources.ingest import bodies_or_none, store_events
from sparkwarden.sources.snapshots import Snapshot, SourceUnavailable, admit
from sparkwarden.streaming import jobs, processors, retry
from tests.test_events import LOG, log_frame, observed
from tests.test_streaming import HIT, T0, write_batches

BEAT = "tenant_id string, device_id string, kind string, at timestamp"


def test_components(spark):
    rng = random.Random(2)
    links = [(f"n{a}", f"n{b}") for a, b in ((rng.randrange(200), rng.randrange(200)) for _ in range(150))] + [(f"p{k}", f"p{k + 1}") for k in range(100, 160)] + [("z", "z")]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u string, v string")).collect()}
    assert got == {n: find(n) for n in parent}


def test_identity_by_component_equals_a_replay_of_each_tenant(spark):
    rng, rows = random.Random(4), []
    pick = lambda stem, n: rng.choice([None, f"{stem}{rng.randrange(n)}"])
    states, want = {t: assets.Resolver(t) for t in ("t0", "t1")}, {}
    for seq in range(300):
        tenant = rng.choice(["t0", "t1"])
        state = states[tenant]
        active = [i for i, a in state.assets.items() if a["state"] == "active"]
        if seq > 60 and rng.random() < 0.1:
            some = rng.sample(active, 2)
            if rng.random() < 0.5:
                row = observed(seq, action="merge", tenant=tenant, asset_ids=some)
            else:
                row = observed(seq, action="split", tenant=tenant, asset_ids=some[:1], identities=[":".join(k) for k in state.owned[some[0]][:1]] + ["mac:m1"])
        else:
            row = observed(seq, rng.randrange(99), tenant=tenant, source=rng.choice(["agent", "log_ingest"]), hostname=pick("H", 60), os_family="linux", device_id=pick("d", 30), mac=pick("M", 40))
            if rng.random() < 0.5:
                row["hostname"] = row["mac"] = None
        rows.append(row)
        if done := state.apply(row):
            want[seq] = (done["asset_id"], done["matched_rule"], done["created"], sorted(done["bound"]))
    final = {r[1]: r for state in states.values() for r in state.rows()}
    df = log_frame(spark, rows)
    assert {r.seq: (r.asset_id, r.matched_rule, r.created, sorted(r.bound)) for r in assets.resolve(df).collect()} == want
    assert any(v[1] == "manual_merge" for v in want.values()) and any(v[1] == "manual_split" for v in want.values())
    got = {r.asset_id: tuple(r) for r in assets.assets(df).collect()}
    assert {k: v[:-3] for k, v in got.items()} == {k: v[:-3] for k, v in final.items()} and {k: v[-1] for k, v in got.items()} == {k: v[-1] for k, v in final.items()}
    parts = assets.with_component(df).groupBy("tenant_id").agg(F.count_distinct("component").alias("n")).collect()
    assert all(r.n > 1 for r in parts)


def test_a_merge_joins_components(spark):
    rows = [observed(1, device_id="a"), observed(2, device_id="b"), observed(3, mac="free")]
    one, two = (assets.Resolver("t1").new_id({"seq": s}) for s in (1, 2))
    rows.append(observed(4, action="merge", asset_ids=[two, one]))
    rows.append(observed(5, device_id="a"))
    got = {r.seq: r.asset_id for r in assets.resolve(log_frame(spark, rows)).collect()}
    assert got[5] == two and {r.seq: r.component for r in assets.with_component(log_frame(spark, rows)).collect()}[3] not in {r.component for r in assets.with_component(log_frame(spark, rows)).filter("seq <> 3").collect()}
    assert assets.resolve(log_frame(spark, rows).limit(0)).count() == 0


def run_stream(spark, path, schema, build, name, idle=False):
    """Run over what is in path/in now; returns (rows of this run, rows of state at its end). idle: batches without rows
    run too, as timers in event time need at the end; with timers by the clock, they would never end."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(idle).lower())
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(path / "in"))
    out, q = [], None

    def step(batch, _):
        out.extend(batch.collect())

    q = build(source).writeStream.foreachBatch(step).outputMode("update").option("checkpointLocation", str(path / name)).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    return out, sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"])


def test_assets_in_a_stream_equal_the_batch(spark, tmp_path):
    """Merges and splits over keyed states, a row a micro-batch."""
    ids = [assets.Resolver("t1").new_id({"seq": s}) for s in (0, 1)]
    rows = [observed(0, hostname="A", os_family="linux", device_id="d1"), observed(1, 1, device_id="d2", mac="AA"), observed(2, action="merge", asset_ids=ids), observed(3, 2, mac="aa"), observed(4, action="split", asset_ids=ids[:1], identities=["device_id:d2"]), observed(5, 3, device_id="d2", mac="aa")]
    write_batches(tmp_path, [rows[:1], rows[1:3], rows[3:5], rows[5:]])
    got, _ = run_stream(spark, tmp_path, LOG, processors.asset_bindings, "cp")
    assert {r.seq: tuple(r) for r in got} == {r.seq: tuple(r) for r in assets.resolve(log_frame(spark, rows)).collect()} and len(got) == 6


def test_state_of_alerts_and_groups_ends(spark, tmp_path):
    def hit(key, event, n, minutes=0):
        return {"tenant_id": "t", "rule_id": "r", "entity_key": key, "kind": "hit", "event_id": event, "event_time": T0 + timedelta(minutes=minutes), "title": "x", "severity": "high", "entity_hostname": "h", "arrival": n}
    write_batches(tmp_path, [[hit(f"e{k}", f"{k}-{i}", k) for k in range(30) for i in range(5)]])
    build = lambda rows: processors.alert_changes(rows, timedelta(seconds=6))
    opened, before = run_stream(spark, tmp_path, HIT, build, "cp")
    assert len(opened) == 150 and before >= 150
    time.sleep(7)
    (tmp_path / "in" / "z.json").write_text((tmp_path / "in" / "0.json").read_text().splitlines()[0].replace("e0", "new"))
    later, after = run_stream(spark, tmp_path, HIT, build, "cp")
    assert sorted(r.change for r in later) == ["expired"] * 30 + ["opened"] and after < before / 5
    assert {r.alert_id for r in later if r.change == "expired"} == {r.alert_id for r in opened}


def test_state_of_correlation_ends(spark, tmp_path):
    def c(rule, alert, minutes, n, change="opened"):
        return {"tenant_id": "t", "rule_id": rule, "alert_id": alert, "change": change, "last_seen": T0 + timedelta(minutes=minutes), "entity_hostname": "h", "arrival": n}
    schema = "tenant_id string, rule_id string, alert_id string, change string, last_seen timestamp, entity_hostname string, arrival long"
    rows = [c("r1", f"a{k}", 40 * k, k) for k in range(20)] + [c("r1", "a0", 25, 30, "updated"), c("r2", "late", 50, 31), c("r3", "a1", 45, 32, "closed"), c("r2", "none", 75, 33)]
    write_batches(tmp_path, [rows])
    build = lambda rows: processors.correlated(rows, timedelta(seconds=6))
    got, before = run_stream(spark, tmp_path, schema, build, "cp")
    # At 50 the alerts seen since 20 are a0 (updated at 25), a1 (40) and all later ones, which came before it.
    assert {"late", "a0", "a1"} <= {r.alert_id for r in got} and len({r.group_id for r in got}) == 1
    time.sleep(7)
    (tmp_path / "in" / "z.json").write_text((tmp_path / "in" / "0.json").read_text().splitlines()[0].replace('"r1"', '"r9"'))
    later, after = run_stream(spark, tmp_path, schema, build, "cp")
    assert later == [] and after <= 2 < before


@pytest.mark.parametrize("cut", [2, 7])
def test_agents_go_offline_and_come_back(spark, tmp_path, cut):
    def beat(device, seconds, kind="heartbeat"):
        return {"tenant_id": "t", "device_id": device, "kind": kind, "at": T0 + timedelta(seconds=seconds)}
    rows = [beat("a", 0), beat("a", 60), beat("b", 70), beat("b", 80, "revoke"), beat("a", 240), beat("a", 421), beat("b", 500), beat("c", 900)]
    write_batches(tmp_path, [rows[k : k + cut] for k in range(0, len(rows), cut)])
    got, _ = run_stream(spark, tmp_path, BEAT, lambda r: processors.agent_status(r, 180, "0 seconds"), "cp", idle=True)
    at = lambda s: T0 + timedelta(seconds=s)
    assert sorted((r.device_id, r.at, r.status) for r in got) == [("a", at(0), "healthy"), ("a", at(420), "offline"), ("a", at(421), "healthy"), ("a", at(601), "offline"), ("b", at(70), "healthy"), ("b", at(80), "revoked"), ("c", at(900), "healthy")]


def test_agents_go_offline_by_the_clock(spark, tmp_path):
    beat = {"tenant_id": "t", "device_id": "a", "kind": "heartbeat", "at": T0}
    write_batches(tmp_path, [[beat]])
    build = lambda r: processors.agent_status(r, 3)
    assert [r.status for r in run_stream(spark, tmp_path, BEAT, build, "cp")[0]] == ["healthy"]
    time.sleep(4)
    (tmp_path / "in" / "z.json").write_text((tmp_path / "in" / "0.json").read_text().replace('"a"', '"b"'))
    assert {(r.device_id, r.status) for r in run_stream(spark, tmp_path, BEAT, build, "cp")[0]} == {("a", "offline"), ("b", "healthy")}


def test_first_event_is_told_once(spark, tmp_path):
    row = lambda t, m: {"tenant_id": t, "ingest_time": T0 + timedelta(minutes=m)}
    write_batches(tmp_path, [[row("a", 3), row("a", 1)], [row("a", 0), row("b", 5)]])
    got, _ = run_stream(spark, tmp_path, "tenant_id string, ingest_time timestamp", processors.first_seen, "cp")
    assert sorted((r.tenant_id, r.first_event_at) for r in got) == [("a", T0 + timedelta(minutes=1)), ("b", T0 + timedelta(minutes=5))]


ROWS = "id long, text string"


def test_one_bad_row_of_a_thousand(spark, tmp_path):
    """It is tried five times, then a dead letter; the others are done at once."""
    rows, clock = [(k, "bad" if k == 617 else "good") for k in range(1000)], [1000.0]
    spark.createDataFrame(rows, ROWS).repartition(4).write.json(str(tmp_path / "in"))
    fails = F.when(F.col("text") == "bad", F.raise_error("cannot handle").cast("string")).otherwise(F.upper("text"))
    stream = spark.readStream.schema(ROWS).json(str(tmp_path / "in"))
    r = retry.Retries(spark, stream.schema, lambda df: df.select("id", fails.alias("text")), str(tmp_path / "base"), idle_s=60, clock=lambda: clock[0])
    assert retry.run_with_retries(stream, r, str(tmp_path / "cp")).awaitTermination(300)
    assert r.results().count() == 999 and [(w.id, w._attempts) for w in r.waiting().collect()] == [(617, 1)]
    r.sweep()  # too early
    assert [(w.id, w._attempts) for w in r.waiting().collect()] == [(617, 1)]
    for n in (2, 3, 4):
        clock[0] += 61
        r.sweep()
        assert [(w.id, w._attempts) for w in r.waiting().collect()] == [(617, n)] and r.dead_letters().count() == 0
    clock[0] += 61
    r.sweep()
    dead = r.dead_letters().collect()
    assert [(d.id, d.code, d.attempts) for d in dead] == [(617, "HANDLER_FAILED", 5)] and "cannot handle" in dead[0].error
    assert r.waiting().count() == 0 and r.results().count() == 999
    r.step(spark.createDataFrame(rows[:5], ROWS), 0)  # a batch that is repeated after its commit
    assert r.results().count() == 999


def test_a_row_that_recovers_and_a_handler_that_fails_on_all(spark, tmp_path):
    clock, down = [0.0], [True]
    handler = lambda df: df.withColumn("text", F.when(F.lit(down[0]) & (F.col("id") >= 2), F.raise_error("down").cast("string")).otherwise(F.col("text")))
    batch = spark.createDataFrame([(k, "x") for k in range(40)] + [(39, "x")], ROWS)
    r = retry.Retries(spark, batch.schema, handler, str(tmp_path / "b"), idle_s=10, most_runs=9, clock=lambda: clock[0])
    r.step(batch, 0)
    assert r.waiting().filter("_attempts = 0").count() >= 30 and r.dead_letters().count() == 0  # the rows are not at fault
    clock[0], down[0] = 20.0, False
    r.step(batch.limit(0), 1)
    assert sorted(x.id for x in r.results().collect()) == [*range(40), 39][:40] + [39] and r.waiting().count() == 0


def test_a_batch_that_ends_the_driver_again_and_again(spark, tmp_path):
    def dies(df):
        raise KeyboardInterrupt
    batch = spark.createDataFrame([(1, "x")], ROWS)
    r = retry.Retries(spark, batch.schema, dies, str(tmp_path / "b"))
    for _ in range(5):
        with pytest.raises(KeyboardInterrupt):
            r.step(batch, 0)
    r.handler = lambda df: df
    r.step(batch, 0)
    assert [(d.id, d.code) for d in r.dead_letters().collect()] == [(1, "MAX_DELIVERY_ATTEMPTS_EXCEEDED")]


TENANTS = "tenant_id string, status string, abuse_frozen boolean"


def test_snapshots_expire_and_deny_when_their_source_is_out(spark):
    now, table, reads = [0.0], [[("a", "active", False), ("b", "frozen", False), ("c", "active", True), ("d", "provisioning", False)]], [0]

    def read():
        reads[0] += 1
        if table[0] is None:
            raise ConnectionError("out of reach")
        return spark.createDataFrame(table[0], TENANTS)

    snapshot = Snapshot(read, "tenants", 60, lambda: now[0])
    requests = spark.createDataFrame([(t,) for t in "abcde"], "tenant_id string")
    codes = lambda: {r.tenant_id: (r.code, r.retry_after_s) for r in admit(requests, snapshot).collect()}
    first = {"a": (None, None), "b": ("TRIAL_EXPIRED", None), "c": ("TENANT_FROZEN", None), "d": ("SERVICE_UNAVAILABLE", 30), "e": ("AUTH_REQUIRED", None)}
    assert codes() == first and reads[0] == 1
    table[0] = [("a", "frozen", False)]
    now[0] = 59.0
    assert codes() == first and reads[0] == 1  # a hit
    now[0] = 60.0
    assert codes()["a"] == ("TRIAL_EXPIRED", None) and codes()["b"] == ("AUTH_REQUIRED", None) and reads[0] == 2 and snapshot.version == 2
    table[0] = None
    now[0] = 100.0
    assert codes()["a"] == ("TRIAL_EXPIRED", None)  # out of reach, but still valid
    now[0] = 121.0
    assert set(codes().values()) == {("SERVICE_UNAVAILABLE", 30)}
    with pytest.raises(SourceUnavailable):
        snapshot.frame()
    table[0] = [("a", "active", False)]
    assert codes()["a"] == (None, None)
    table[0] = [("a", "purged", False)]
    snapshot.invalidate()
    assert codes()["a"] == ("TRIAL_EXPIRED", None)
    cold = Snapshot(lambda: spark.read.parquet("/nowhere/at/all"), "cold")
    assert {r.code for r in admit(requests, cold).collect()} == {"SERVICE_UNAVAILABLE"}


def test_devices_are_looked_at_first(spark):
    tenants = Snapshot(lambda: spark.createDataFrame([("a", "frozen", False), ("b", "active", False)], TENANTS), "t")
    known = [("b", "d1", "active", "AA", "bb", T0), ("b", "d2", "revoked", "cc", None, None), ("a", "d1", "active", "dd", None, None)]
    devices = Snapshot(lambda: spark.createDataFrame(known, "tenant_id string, device_id string, status string, cert_serial string, prev_cert_serial string, prev_valid_until timestamp"), "d")
    asked = [(1, "b", "d1", "aa", T0), (2, "b", "d1", "BB", T0), (3, "b", "d1", "bb", T0 + timedelta(1)), (4, "b", "d2", "cc", T0), (5, "b", "d9", "aa", T0), (6, "b", "d1", None, T0), (7, "a", "d1", "dd", T0)]
    rows = spark.createDataFrame(asked, "n int, tenant_id string, device_id string, serial string, at timestamp")
    assert {r.n: r.code for r in admit(rows, tenants, devices).collect()} == {1: None, 2: None, 3: "DEVICE_IDENTITY_INVALID", 4: "DEVICE_REVOKED", 5: "DEVICE_IDENTITY_INVALID", 6: "DEVICE_IDENTITY_INVALID", 7: "TRIAL_EXPIRED"}


def test_the_first_of_repeated_events_is_stored(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    rows = [("t", "d", at(0), at(m), b, k, f"{m}{b}{k}") for m in (5, 3, 4) for b in ("y", "x") for k in (2, 1)] + [("t", "e", at(0), at(9), "x", 0, "e")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "tenant_id string, doc_id string, event_time timestamp, ingest_time timestamp, batch_id string, ordinal int, v string").repartition(3)
    assert {r.doc_id: r.v for r in store_events(df, str(tmp_path / "s"), "1").collect()} == {"d": "3x1", "e": "e"}
    assert store_events(df, str(tmp_path / "s"), "2").count() == 0


ASKED = "key string, at timestamp, id long, amount long"


def asked_at(key, second, n, amount=1):
    return {"key": key, "at": None if second is None else T0 + timedelta(seconds=second), "id": n, "amount": amount}


@pytest.mark.parametrize("seconds", [None, 60])
def test_admission_in_a_stream_equals_the_batch(spark, tmp_path, seconds):
    """Cut into micro-batches anywhere: repeated times, nulls, a key that is null, and answers that depend on refused ones."""
    rng = random.Random(7)
    rows = sorted((asked_at(rng.choice(["a", "b", None]), rng.randrange(900), k, rng.choice([0, 1, 2, 5, None])) for k in range(600)), key=lambda r: (r["at"], r["id"]))
    rows += [asked_at("a", None, 700), asked_at("b", 901, 701)]
    write_batches(tmp_path, [rows[k : k + 150] for k in range(0, len(rows), 150)])
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ASKED)
    want = usage.admit_by_rate(df, "key", "at", "id", F.col("amount"), 12) if seconds is None else usage.admit_by_fixed_window(df, "key", "at", "id", 9, seconds)
    got, kept = run_stream(spark, tmp_path, ASKED, lambda r: processors.admission(r, 12 if seconds is None else 9, seconds=seconds), "cp")
    said = {r.id: r.admitted for r in got}
    assert said == {r.id: r.admitted for r in want.collect()} and len(said) == len(rows) == len(got) and len(set(said.values())) == 2 and kept > 0


def test_state_of_admission_ends_and_late_requests_count(spark, tmp_path):
    write_batches(tmp_path, [[asked_at("a", 100, 0, 5)], [asked_at("a", 20, 1, 5), asked_at("a", 20, 2, 1)], [asked_at("b", 1000, 3)]])
    got, kept = run_stream(spark, tmp_path, ASKED, lambda r: processors.admission(r, 10), "late")
    assert {r.id: r.admitted for r in got} == {0: True, 1: True, 2: False, 3: True}
    many = [[asked_at(f"k{k}", k, k) for k in range(50)], [asked_at("z", 5000, 99)], [asked_at("z", 5001, 100)]]
    write_batches(tmp_path / "more", many)
    got, ended = run_stream(spark, tmp_path / "more", ASKED, lambda r: processors.admission(r, 10, event_time="0 seconds"), "cp", idle=True)
    assert len(got) == 52 and ended <= 4


def test_only_the_store_may_fail(spark):
    links = spark.createDataFrame([("t", "a", "e1"), ("t", "a", "e2")], "tenant_id string, alert_id string, event_id string")
    events = spark.createDataFrame([("t", "e1", "{}"), ("u", "e2", "other")], "tenant_id string, event_id string, body string")
    assert {r.event_id: r.body for r in bodies_or_none(links, lambda: events).collect()} == {"e1": "{}", "e2": None}

    def refused():
        raise OSError("refused")

    assert {r.event_id: r.body for r in bodies_or_none(links, refused).collect()} == {"e1": None, "e2": None}
    with pytest.raises(Exception, match="broken links"):
        bodies_or_none(links.withColumn("event_id", F.raise_error(F.lit("broken links")).cast("string")), lambda: events)
    with pytest.raises(KeyError):  # a mistake of the caller is no outage
        bodies_or_none(links, lambda: {}["events"])
