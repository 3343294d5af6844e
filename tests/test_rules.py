"""The rule language: operators, missing fields, bounds, gates, packs."""

import json

import pytest
from pyspark.sql import functions as F

from sparkwarden import schema
from sparkwarden.rules.compile import RuleError, TypedResolver, VariantResolver, check_tree, compile_rule, condition
from sparkwarden.rules.content import RULES, every, leaf
from sparkwarden.rules.detect import detect
from sparkwarden.rules.pack import active_pack, build_pack, load_pack, load_yaml, publish, run_fixtures

PROC, NET, AUTH, GEN = "process_activity", "network_activity", "authentication", "generic"

#: (class, tree, event, expected): what each operator says of values of each type.
CASES = [
    (PROC, leaf("process.pid", "equals", 1), {"process": {"pid": 1}}, True),
    (PROC, leaf("process.pid", "equals", 1), {"process": {"pid": 1.0}}, True),
    (PROC, leaf("process.pid", "equals", 1), {"process": {"pid": "1"}}, False),
    (PROC, leaf("process.pid", "equals", 1), {"process": {"pid": True}}, False),
    (PROC, leaf("process.pid", "equals", True), {"process": {"pid": 1}}, False),
    (PROC, leaf("process.pid", "equals", True), {"process": {"pid": True}}, True),
    (PROC, leaf("process.name", "equals", "A"), {"process": {"name": "a"}}, False),
    (PROC, leaf("process.name", "iequals", "STRASSE"), {"process": {"name": "Straße"}}, True),
    (PROC, leaf("process.name", "iequals", "s"), {"process": {"name": "ſ"}}, True),
    (PROC, leaf("process.name", "contains", ["x", "b"]), {"process": {"name": "abc"}}, True),
    (PROC, leaf("process.name", "contains", "B"), {"process": {"name": "abc"}}, False),
    (PROC, leaf("process.name", "contains", ""), {"process": {"name": ""}}, True),
    (PROC, leaf("process.name", "icontains", "B"), {"process": {"name": "abc"}}, True),
    (PROC, leaf("process.name", "startswith", "ab"), {"process": {"name": "abc"}}, True),
    (PROC, leaf("process.name", "istartswith", ["Q", "AB"]), {"process": {"name": "abc"}}, True),
    (PROC, leaf("process.name", "endswith", "bc"), {"process": {"name": "abc"}}, True),
    (PROC, leaf("process.name", "iendswith", "BC"), {"process": {"name": "abc"}}, True),
    (PROC, leaf("process.name", "contains", "1"), {"process": {"name": 1}}, False),
    (PROC, leaf("process.pid", "in", [7, "1", True]), {"process": {"pid": "1"}}, True),
    (PROC, leaf("process.pid", "in", [7, "1"]), {"process": {"pid": 1}}, False),
    (PROC, leaf("process.name", "iin", ["A", "B"]), {"process": {"name": "b"}}, True),
    (PROC, leaf("process.pid", "gt", 1), {"process": {"pid": 2}}, True),
    (PROC, leaf("process.pid", "gte", 2), {"process": {"pid": 2}}, True),
    (PROC, leaf("process.pid", "lt", 2.5), {"process": {"pid": 2}}, True),
    (PROC, leaf("process.pid", "lte", 1), {"process": {"pid": 2}}, False),
    (PROC, leaf("process.pid", "gt", 0), {"process": {"pid": True}}, False),
    (PROC, leaf("process.pid", "gt", 0), {"process": {"pid": "5"}}, False),
    (PROC, leaf("process.name", "regex", r"a\d+$"), {"process": {"name": "xa12"}}, True),
    (PROC, leaf("process.name", "regex", "(?P<n>b)c"), {"process": {"name": "abc"}}, True),
    (PROC, leaf("process.sha256", "exists"), {"process": {"sha256": "x"}}, True),
    *[(PROC, leaf("process.sha256", "exists"), {"process": {"sha256": v}}, False) for v in (None, {}, {"a": 1}, [], ["x"])],
    (PROC, leaf("process.sha256", "exists"), {"process": "x"}, False),
    (PROC, leaf("process.sha256", "exists"), {}, False),
    (PROC, {"not": leaf("process.name", "equals", "a")}, {}, True),
    (PROC, {"not": {"not": leaf("process.name", "equals", "a")}}, {}, False),
    (PROC, {"any": [leaf("process.name", "equals", "a"), leaf("process.pid", "equals", 3)]}, {"process": {"pid": 3}}, True),
    (PROC, every(leaf("process.name", "equals", "a"), leaf("process.pid", "equals", 3)), {"process": {"pid": 3}}, False),
    (GEN, leaf("fields.action", "equals", "deny"), {"fields": {"action": "deny"}}, True),
    (GEN, leaf("fields.n", "gte", 1.5), {"fields": {"n": 1.5}}, True),
    (GEN, leaf("raw_truncated", "equals", False), {"raw_truncated": False}, True),
]


def test_operators_on_untyped_events(spark):
    rows = spark.createDataFrame([(k, json.dumps(e)) for k, (_, _, e, _) in enumerate(CASES)], "k int, event string").withColumn("event", F.parse_json("event"))
    resolver = VariantResolver(F.col("event"))
    said = F.coalesce(*[F.when(F.col("k") == k, condition(tree, cls, resolver)) for k, (cls, tree, _, _) in enumerate(CASES)])
    got = {r.k: r.said for r in rows.select("k", said.alias("said")).collect()}
    assert [k for k, c in enumerate(CASES) if got[k] is not c[3]] == []


def test_typed_events_agree_where_types_fit(spark):
    fits = [c for c in CASES if _fits(c[2])]
    rows = spark.createDataFrame([(k, json.dumps(c[2])) for k, c in enumerate(fits)], "k int, doc string").select("k", F.from_json("doc", schema.EVENT).alias("e")).select("k", "e.*")
    resolver = TypedResolver(rows.schema)
    said = F.coalesce(*[F.when(F.col("k") == k, condition(c[1], c[0], resolver)) for k, c in enumerate(fits)])
    got = {r.k: r.said for r in rows.select("k", said.alias("said")).collect()}
    assert len(fits) > 25 and [c for k, c in enumerate(fits) if got[k] is not c[3]] == []


def _fits(event):
    p = event.get("process", {})
    return isinstance(p, dict) and isinstance(p.get("pid", 1), int) and not isinstance(p.get("pid"), bool) and isinstance(p.get("name", ""), str) and isinstance(p.get("sha256", ""), (str, type(None)))


BAD = [
    {"field": "process.name", "op": "equals"}, {"field": "process.name", "op": "exists", "value": 1}, {"field": "process.name", "op": "nope", "value": 1}, {"field": "raw.x", "op": "exists"},
    {"field": "tenant_id", "op": "exists"}, {"field": "direction", "op": "exists"}, {"field": "process..name", "op": "exists"}, {"all": []}, {"all": [leaf("process.name", "exists")] * 33},
    {"not": leaf("process.name", "exists"), "all": []}, {"field": "process.name", "op": "contains", "value": [1]}, {"field": "process.name", "op": "contains", "value": []},
    {"field": "process.name", "op": "in", "value": "a"}, {"field": "process.pid", "op": "gt", "value": True}, {"field": "process.pid", "op": "gt", "value": "1"}, leaf("process.name", "equals", "x" * 1025),
    leaf("process.name", "iin", ["a"] * 65), leaf("process.name", "regex", "(?=a)"), leaf("process.name", "regex", r"(a)\1"), leaf("process.name", "regex", "a++"), leaf("process.name", "regex", "("),
    leaf("process.name", "regex", "a" * 513), leaf("process.name", "iequals", ["a"]), leaf("process.name", "equals", [1]), [], "x", {"field": "process.name", "op": "exists", "more": 1}, {"any": [leaf("process.name", "exists")] * 32 + [1]},
]


@pytest.mark.parametrize("tree", BAD, ids=range(len(BAD)))
def test_bad_trees(tree):
    with pytest.raises(RuleError):
        check_tree(tree, PROC)


def test_depth_and_leaves_are_bounded():
    deep = leaf("process.name", "exists")
    for _ in range(7):
        deep = {"not": deep}
    check_tree(deep, PROC)
    with pytest.raises(RuleError):
        check_tree({"not": deep}, PROC)
    with pytest.raises(RuleError):
        check_tree({"all": [{"all": [leaf("process.name", "exists")] * 32}] * 2 + [leaf("process.name", "exists")]}, PROC)


@pytest.mark.parametrize("change", [{"severity": "huge"}, {"id": "A b"}, {"version": "1"}, {"title": ""}, {"title": "x" * 121}, {"mitre_technique_ids": []}, {"mitre_technique_ids": ["X1"]}, {"entity": []}, {"entity": ["raw.x"]}, {"event_class": "x"}, {"extra": 1}, {"detection": {}}])
def test_bad_documents(change):
    with pytest.raises(RuleError):
        compile_rule(RULES[0] | change)


def event(cls, **more):
    return {"event_class": cls, "schema_version": "1.0.0", "host": {"hostname": "h"}} | more


OUT = {"direction": "outbound", "protocol": "tcp"}
proc = lambda name, cmd="", **more: event(PROC, activity="process_launched", process={"name": name, "cmd_line": cmd}, **more)
net = lambda ip="203.0.113.5", port=443, **more: event(NET, **(OUT | {"dst": {"ip": ip, "port": port}} | more))
auth = lambda **more: event(AUTH, **more)
remote = {"activity": "logon", "status": "success", "logon_type": "remote_interactive"}

#: rule -> (events that match, events that do not).
FIXTURES = {
    "auth-account-lockout": ([auth(activity="logon_failed", failure_reason="account_locked")], [auth(activity="logon_failed", failure_reason="bad_password"), auth(activity="logon")]),
    "auth-builtin-admin-network-logon": ([auth(activity="logon", status="success", user={"name": "Administrator"}, logon_type="network")], [auth(activity="logon", status="success", user={"name": "bob"}, logon_type="network"), auth(activity="logon", status="success", user={"name": "administrator"}, logon_type="interactive")]),
    "auth-external-remote-logon": ([auth(**remote, src_ip="203.0.113.50")], [auth(**remote, src_ip="10.1.2.3"), auth(**remote)]),
    "auth-failed-admin-logon-external": ([auth(activity="logon_failed", user={"name": "ROOT"}, src_ip="8.8.8.8")], [auth(activity="logon_failed", user={"name": "root"}, src_ip="FD00::1"), auth(activity="logon_failed", user={"name": "bob"}, src_ip="8.8.8.8")]),
    "auth-failed-logon-disabled-account": ([auth(activity="logon_failed", failure_reason="account_disabled")], [auth(activity="logon", failure_reason="account_disabled")]),
    "gen-hacktool-indicator-in-logs": ([event(GEN, message="found MimiKatz here")], [event(GEN, message="nothing")]),
    "gen-ssh-auth-failure": ([event(GEN, message="Failed password for root"), event(GEN, message="Invalid user x")], [event(GEN, message="Accepted password")]),
    "net-direct-outbound-smtp": ([net(port=25)], [net(port=25, ip="192.168.0.9"), net(port=587), net(port=25, direction="inbound")]),
    "net-large-outbound-transfer": ([net(activity="connection_closed", bytes_sent=104857600)], [net(activity="connection_closed", bytes_sent=104857599), net(activity="connection_opened", bytes_sent=104857600), net(activity="connection_closed", bytes_sent=1 << 40, ip="172.20.1.1")]),
    "net-lolbin-outbound-connection": ([net(process={"name": "CertUtil.exe"})], [net(process={"name": "chrome.exe"}), net(ip="10.0.0.1", process={"name": "certutil.exe"})]),
    "net-outbound-known-c2-port": ([net(port=4444)], [net(port=4443), net(port=4444, protocol="udp")]),
    "net-rdp-inbound-from-external": ([net(ip="10.0.0.5", port=3389, direction="inbound", src={"ip": "203.0.113.1"})], [net(ip="10.0.0.5", port=3389, direction="inbound", src={"ip": "10.0.0.1"})]),
    "net-smb-to-external": ([net(port=445), net(port=139, dst={"ip": "8.8.8.8", "port": 139, "hostname": "x.example"})], [net(port=445, dst={"ip": "8.8.8.8", "port": 445, "hostname": "A.FILE.core.windows.net"}), net(port=445, ip="10.2.2.2")]),
    "proc-certutil-download-or-decode": ([proc("certutil.exe", "certutil -URLcache -f http://x"), proc("certutil.exe", "certutil -decode a b")], [proc("certutil.exe", "certutil -urlcache"), proc("x.exe", "-decode")]),
    "proc-lsass-memory-dump": ([proc("procdump64.exe", "-ma LSASS.exe"), proc("rundll32.exe", "comsvcs.dll, MiniDump 1"), proc("createdump.exe", "lsass")], [proc("procdump.exe", "-ma notepad"), proc("rundll32.exe", "comsvcs.dll")]),
    "proc-mshta-remote-or-inline-script": ([proc("mshta.exe", "mshta https://x"), proc("MSHTA.EXE", "vbscript:x")], [proc("mshta.exe", "local.hta")]),
    "proc-office-app-spawns-shell": ([proc("cmd.exe", parent={"name": "WINWORD.EXE"})], [proc("cmd.exe", parent={"name": "explorer.exe"}), proc("splwow64.exe", parent={"name": "winword.exe"})]),
    "proc-powershell-download-cradle": ([proc("pwsh.exe", "IWR http://x")], [proc("pwsh.exe", "iwr ftp://x"), proc("powershell.exe", "http only")]),
    "proc-powershell-encoded-command": ([proc("powershell.exe", "powershell -EncodedCommand x"), proc("powershell.exe", "powershell -e x")], [proc("powershell.exe", "powershell -ex"), proc("cmd.exe", " -enc x")]),
    "proc-rundll32-suspicious-execution": ([proc("rundll32.exe", "C:\\Users\\Public\\x.dll,a"), proc("rundll32.exe", "javascript:x")], [proc("rundll32.exe", "C:\\Windows\\x.dll")]),
    "proc-schtasks-suspicious-task": ([proc("schtasks.exe", "schtasks /CREATE /tr powershell")], [proc("schtasks.exe", "schtasks /create /tr notepad"), proc("schtasks.exe", "/query powershell")]),
    "proc-script-host-user-writable-path": ([proc("wscript.exe", "C:\\Users\\a\\Downloads\\x.js")], [proc("wscript.exe", "C:\\Windows\\x.js")]),
    "proc-shadow-copy-deletion": ([proc("vssadmin.exe", "delete shadows"), proc("wmic.exe", "shadowcopy delete"), proc("bcdedit.exe", "/set recoveryenabled No"), proc("wbadmin.exe", "delete catalog")], [proc("vssadmin.exe", "list shadows"), proc("bcdedit.exe", "/set recoveryenabled yes"), proc("wbadmin.exe", "delete systemstate")]),
    "proc-wmic-process-create": ([proc("wmic.exe", "process call create x")], [proc("wmic.exe", "process list"), event(PROC, process={"name": "wmic.exe"})]),
}


def test_builtin_rules_on_fixtures(spark):
    pack = build_pack("1.0.0", RULES)
    assert not pack.errors and len(pack.rules) == 24 == len(FIXTURES)
    cases = [{"rule_id": r, "name": str(k), "expected": e, "event": ev} for r, (yes, no) in FIXTURES.items() for e, evs in ((True, yes), (False, no)) for k, ev in enumerate(evs)]
    bad = [r for r in run_fixtures(spark, pack, cases).collect() if r.matched != r.expected]
    assert len(cases) >= 77 and bad == []


def test_detection_is_one_scan_and_gates_hold(spark):
    pack = build_pack("1.0.0", RULES)
    rows = [
        ("t1", "e1", proc("powershell.exe", "x -enc y", user={"name": "Sam"})), ("t2", "e2", proc("powershell.exe", "x -enc y", user={"name": "Sam"})), ("t1", "e3", proc("powershell.exe", "x -enc y") | {"schema_version": "2.0.0"}),
        ("t1", "e4", proc("powershell.exe", "x -enc y") | {"schema_version": "0.9.0"}), ("t1", "e5", proc("powershell.exe", "x -enc y") | {"schema_version": "x"}), ("t1", "e6", proc("powershell.exe", "iwr http://a -enc y") | {"schema_version": "1.9.9"}),
    ]
    docs = [(t, json.dumps(e | {"event_id": i, "tenant_id": t, "event_time": "2026-07-08T10:00:00Z"})) for t, i, e in rows]
    events = spark.createDataFrame(docs, "t string, doc string").select(F.from_json("doc", schema.EVENT).alias("e")).select("e.*")
    hits = detect(events, pack)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate ") <= 2 and "Union" not in plan and "Join" not in plan
    got = {(h.event_id, h.rule_id): h for h in hits.collect()}
    enc = "proc-powershell-encoded-command"
    assert set(got) == {("e1", enc), ("e2", enc), ("e6", enc), ("e6", "proc-powershell-download-cradle")}
    one = got["e1", enc]
    assert (one.entity_key, one.entity_user, one.entity_hostname, one.es_index, one.pack_version) == ("h|sam", "Sam", "h", "events-v1-t1-2026.07", "1.0.0") and got["e6", enc].entity_key == "h|"
    toggles = spark.createDataFrame([("t2", enc, False)], "tenant_id string, rule_id string, enabled boolean")
    off = spark.createDataFrame([("proc-powershell-download-cradle",)], "rule_id string")
    assert {h.event_id for h in detect(events, pack, disabled=off, toggles=toggles).collect()} == {"e1", "e6"}


def test_packs_from_files(spark, tmp_path):
    import yaml
    (tmp_path / "rules").mkdir()
    for doc in RULES[:3]:
        (tmp_path / "rules" / f"{doc['id']}.yml").write_text(yaml.dump(doc, Dumper=_Plain))
    names = [f"rules/{d['id']}.yml" for d in RULES[:2]]
    (tmp_path / "pack.yaml").write_text(yaml.dump({"version": "2.0.0", "rules": [*names, "rules/missing.yml"]}))
    pack = load_pack(str(tmp_path / "pack.yaml"))
    assert len(pack.rules) == 2 and len(pack.errors) == 2
    for text in ("a: &x 1\nb: *x", "a: 1\na: 2", "a: 1\n---\nb: 2", "b: {<<: {a: 1}}"):
        with pytest.raises((RuleError, yaml.YAMLError)):
            load_yaml(text)
    good = build_pack("3.0.0", RULES[:5] + [RULES[0], {"id": "broken"}])
    assert len(good.rules) == 5 and len(good.errors) == 2
    publish(spark, build_pack("1.0.0", RULES), RULES, str(tmp_path / "store"), published_by="me", at="2026-01-01")
    publish(spark, build_pack("1.1.0", RULES[:7]), RULES[:7], str(tmp_path / "store"), published_by="me", at="2026-01-02")
    active = active_pack(spark, str(tmp_path / "store"))
    assert active.version == "1.1.0" and len(active.rules) == 7


class _Plain(__import__("yaml").SafeDumper):
    def ignore_aliases(self, data):
        return True
