"""Tables that change: upserts, deletes and purges in Parquet, packs published against each other, and migrations."""

import json
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwarden.rules.compile import RuleError
from sparkwarden.rules.content import RULES
from sparkwarden.rules.pack import active_pack, build_pack, commits, publish, publish_audit, published
from sparkwarden.sources import migrations, tables
from sparkwarden.storage import create_once

SCHEMA = T.StructType([T.StructField(c, t()) for c, t in (("tenant_id", T.StringType), ("month", T.StringType), ("k", T.IntegerType), ("v", T.StringType), ("n", T.IntegerType))])


def files(path):
    return {str(p): (p.stat().st_mtime_ns, p.stat().st_size) for p in path.rglob("*.parquet")}


def content(spark, path):
    return sorted(tuple(r) for r in tables.table(spark, str(path), SCHEMA).select("tenant_id", "month", "k", "v", "n").collect())


@pytest.fixture
def stored(spark, tmp_path):
    rows = [(t, m, k, f"{t}{m}{k}", 1) for t in ("a", "b", "c:%20 d") for m in ("2024.01", "2024.10") for k in range(4)]
    path = tmp_path / "t"
    spark.createDataFrame(rows, SCHEMA).repartition("tenant_id", "month").write.partitionBy("tenant_id", "month").parquet(str(path))
    return path, rows


def test_upsert_leaves_other_partitions_alone(spark, stored):
    path, rows = stored
    before = files(path)
    changes = spark.createDataFrame([("a", "2024.10", 1, "early", 5, 1), ("a", "2024.10", 1, None, 7, 2), ("a", "2024.10", 9, "new", 1, 1), ("d", "2025.01", 0, "first", 1, 1)], "tenant_id string, month string, k int, v string, n int, _seq int")
    add = lambda old, new: old["n"] + new["n"]
    done = tables.upsert(str(path), changes, keys=["tenant_id", "month", "k"], by=["tenant_id", "month"], order=["_seq"], merge={"n": add})
    assert {(r.tenant_id, r.k): r.inserted for r in done.collect()} == {("a", 1): False, ("a", 9): True, ("d", 0): True}
    want = [r for r in rows if r[:3] != ("a", "2024.10", 1)] + [("a", "2024.10", 1, None, 8), ("a", "2024.10", 9, "new", 1), ("d", "2025.01", 0, "first", 1)]
    got = content(spark, path)
    assert sorted(got, key=str) == sorted(want, key=str)
    after = files(path)
    assert {p for p in before if after.get(p) != before[p]} == {p for p in before if "tenant_id=a/month=2024.10" in p}
    # Nothing to do, a table that is not there yet, and keys that are null.
    tables.upsert(str(path), changes.limit(0), keys=["tenant_id", "month", "k"], by=["tenant_id", "month"], order=["_seq"])
    assert files(path) == after
    tables.upsert(str(path.parent / "fresh"), changes, keys=["tenant_id", "month", "k"], by=["tenant_id", "month"], order=["_seq"])
    assert len(content(spark, path.parent / "fresh")) == 3
    with pytest.raises(Exception, match="null in a key"):
        tables.upsert(str(path), changes.withColumn("k", F.lit(None).cast("int")), keys=["tenant_id", "month", "k"], by=["tenant_id", "month"], order=["_seq"])
    with pytest.raises(ValueError):
        tables.upsert(str(path), changes, keys=["k"], by=["month"], order=["_seq"])


def test_delete_rewrites_what_it_must(spark, stored):
    path, rows = stored
    before = files(path)
    odd = "c:%20 d"
    where = (F.col("tenant_id") == odd) & (F.col("month") == "2024.01") | (F.col("tenant_id") == "b") & (F.col("k") == 2)
    tables.delete(spark, str(path), SCHEMA, where, by=["tenant_id", "month"])
    assert content(spark, path) == sorted(r for r in rows if not (r[0] == odd and r[1] == "2024.01" or r[0] == "b" and r[2] == 2))
    after = files(path)
    assert {p for p in before if after.get(p) == before[p]} == {p for p in before if "tenant_id=a/" in p or "tenant_id=c" in p and "month=2024.10" in p}
    assert len(list(path.glob("tenant_id=c*/month=2024.01"))) == 0
    tables.delete(spark, str(path), SCHEMA, where, by=["tenant_id", "month"])
    tables.delete(spark, str(path), SCHEMA, F.lit(None).cast("boolean"), by=["tenant_id", "month"])
    tables.delete(spark, str(path.parent / "none"), SCHEMA, where, by=["tenant_id", "month"])
    assert files(path) == after


def test_retention_and_purge(spark, stored):
    path, rows = stored
    days = spark.createDataFrame([("a", 30), ("b", 400)], "tenant_id string, days int")
    assert tables.retain_months(spark, str(path), SCHEMA, days, "2024-12-15") == [("a", "2024.01"), ("a", "2024.10")]
    assert content(spark, path) == sorted(r for r in rows if r[0] != "a") and tables.retain_months(spark, str(path), SCHEMA, days, "2024-12-15") == []
    audit = path.parent / "audit"
    spark.createDataFrame(rows, SCHEMA).write.partitionBy("tenant_id").parquet(str(audit))
    of = {"alerts": (str(path), SCHEMA, ["tenant_id", "month"]), "alert_events": (str(audit), SCHEMA, ["tenant_id"]), "devices": (str(path.parent / "none"), SCHEMA, ["tenant_id"])}
    for _ in range(2):
        assert tables.purge(spark, of, "b", retained={"alert_events": F.col("k") == 0}) == ["alert_events", "alerts", "devices"]
        assert content(spark, path) == sorted(r for r in rows if r[0] not in ("a", "b"))
        assert content(spark, audit) == sorted(r for r in rows if r[0] != "b" or r[2] == 0)


def test_publishers_race(spark, tmp_path):
    base, said = str(tmp_path / "packs"), []

    def run(version):
        try:
            said.append(publish(spark, build_pack(version, RULES[:3]), RULES[:3], base, published_by=version, at="2026-01-01"))
        except RuleError as refused:
            said.append(str(refused))

    assert active_pack(spark, base) is None and commits(spark, base) == []
    publish(spark, build_pack("1.0.0", RULES), RULES, base, published_by="me", at="2026-01-01")
    threads = [threading.Thread(target=run, args=("2.0.0",)) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(map(str, said))[0] == "2" and sum(x == 2 for x in said) == 1 and all("published" in x for x in said if x != 2)
    assert active_pack(spark, base).version == "2.0.0" and len(active_pack(spark, base).rules) == 3
    assert [(r.pack_version, r.status) for r in published(spark, base).orderBy("number").collect()] == [("1.0.0", "superseded"), ("2.0.0", "active")]
    assert len(list((tmp_path / "packs" / "rules").iterdir())) == 2 and commits(spark, base)[1]["supersedes"] == "1.0.0"
    audit = publish_audit(spark, base).orderBy("target").collect()
    assert [r.action_type for r in audit] == ["rule_pack.publish"] * 2 and json.loads(audit[0].after)["rule_count"] == len(RULES)
    # A publisher that died on its commit: readers keep the last one, the next publisher goes on.
    create_once(spark, f"{base}/commits/00000003.json")
    assert active_pack(spark, base).version == "2.0.0"
    assert publish(spark, build_pack("3.0.0", RULES[:2]), RULES[:2], base, published_by="me", at="2026-01-02") == 4 and active_pack(spark, base).version == "3.0.0"
    for version, who in (("1.0.0", "me"), ("4.0.0", " ")):
        with pytest.raises(RuleError):
            publish(spark, build_pack(version, RULES[:2]), RULES[:2], base, published_by=who, at="2026-01-02")
    with pytest.raises(RuleError):
        publish(spark, build_pack("5.0.0", [{"id": "broken"}]), [], base, published_by="me", at="2026-01-02")


def test_migrations_up_down_and_drift(spark, tmp_path):
    spark.sql("create database if not exists moved")
    ledger = migrations.Ledger(spark, str(tmp_path / "ledger"))
    state = lambda files: {r.name: r.state for r in ledger.status(files).collect()}
    tables_of = lambda: {t.name for t in spark.catalog.listTables("moved")}
    own = migrations.own_tables("moved")
    names = [m.name for m in own]
    assert set(state(own).values()) == {"pending"} and ledger.up(own, "1") == (names, [])
    assert tables_of() == {"events", "detections", "asset_observations", "dead_letters", "audit_log", "metering"}
    assert "variant" in dict(spark.table("moved.events").dtypes).values() and ledger.up(own, "2") == ([], [])
    changed = [own[0], migrations.parse(names[1], f"{migrations.UP}\nselect 1;\n{migrations.DOWN}\nselect 2;\n"), *own[2:]]
    assert ledger.up(changed, "3") == ([], [names[1]]) and state(changed)[names[1]] == "drifted"
    with pytest.raises(migrations.MigrationError):
        ledger.down(own[:-1], 2, "4")
    assert state(own[:-1])[names[-1]] == "missing" and ledger.down(own, 2, "4") == [names[-1], names[-2]] and tables_of() == {"events", "detections", "asset_observations", "dead_letters"}
    assert ledger.down(own, 99, "5") == names[:4][::-1] and tables_of() == set() and ledger.down(own, 1, "6") == [] and set(state(own).values()) == {"pending"}


def test_an_interrupted_migration_is_run_again(spark, tmp_path):
    spark.sql("create database if not exists halfway")
    (tmp_path / "files").mkdir()
    file = tmp_path / "files" / "0001_two.sql"
    file.write_text("-- migrate:up\ncreate table if not exists halfway.a (k int) using parquet;\ncreate table halfway.b (k nonsense) using parquet;\n-- migrate:down\ndrop table if exists halfway.a;\ndrop table if exists halfway.b;\n")
    ledger = migrations.Ledger(spark, str(tmp_path / "ledger"))
    with pytest.raises(Exception):
        ledger.up(migrations.load(str(tmp_path / "files")), "1")
    assert ledger.status(migrations.load(str(tmp_path / "files"))).first().state == "interrupted"
    file.write_text(file.read_text().replace("table halfway.b (k nonsense)", "table if not exists halfway.b (k int)"))
    files = migrations.load(str(tmp_path / "files"))
    assert ledger.up(files, "2") == (["0001_two.sql"], []) and ledger.status(files).first().state == "applied"
    assert {t.name for t in spark.catalog.listTables("halfway")} == {"a", "b"}
    create_once(spark, str(tmp_path / "ledger" / "00000004.json"))  # a runner that ended as it wrote
    assert ledger.down(files, 1, "3") == ["0001_two.sql"] and {t.name for t in spark.catalog.listTables("halfway")} == set()
    for text in ("create table x", "-- migrate:up\n-- migrate:down\ndrop x;", "-- migrate:down\ndrop x;\n-- migrate:up\ncreate x;"):
        with pytest.raises(migrations.MigrationError):
            migrations.parse("bad", text)
    (tmp_path / "empty").mkdir()
    with pytest.raises(migrations.MigrationError):
        migrations.load(str(tmp_path / "empty"))
