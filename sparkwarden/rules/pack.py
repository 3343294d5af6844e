"""Rule packs: strict YAML loading, manifest checks, fixtures, publishing as Parquet under a log of commits."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.operators.tenancy import PLATFORM_TENANT
from sparkwarden.rules.compile import Rule, RuleError, VariantResolver, compile_rule
from sparkwarden.storage import create_once, names_in, remove, text_of

RULES_SCHEMA = "pack_version string, rule_id string, rule_version string, definition string"


class _StrictLoader(yaml.SafeLoader):
    """Plain documents only: no anchors, aliases, merges or repeated keys."""

    def compose_node(self, parent, index):
        if self.check_event(yaml.AliasEvent):
            raise RuleError("aliases are not allowed")
        if getattr(self.peek_event(), "anchor", None) is not None:
            raise RuleError("anchors are not allowed")
        return super().compose_node(parent, index)

    def construct_mapping(self, node, deep=False):
        keys = [self.construct_object(k) for k, _ in node.value]
        if "<<" in keys or any(k.tag.endswith(":merge") for k, _ in node.value):
            raise RuleError("merges are not allowed")
        if len(keys) != len(set(map(str, keys))):
            raise RuleError("a key is repeated")
        return super().construct_mapping(node, deep)


def load_yaml(text: str):
    documents = list(yaml.load_all(text, _StrictLoader))
    if len(documents) != 1:
        raise RuleError("a file holds exactly one document")
    return documents[0]


@dataclass
class Pack:
    """The rules of a version by class, and what is wrong with those that were left out."""

    version: str
    rules: list[Rule]
    errors: list[str] = field(default_factory=list)
    hash: str = ""

    def of(self, event_class: str) -> list[Rule]:
        return [r for r in self.rules if r.event_class == event_class]


def build_pack(version: str, documents: list[dict]) -> Pack:
    """Compile documents; a bad one is reported and skipped, a repeated id is an error."""
    pack, seen = Pack(version, []), set()
    for doc in documents:
        name = doc.get("id") if isinstance(doc, dict) else None
        try:
            if name in seen:
                raise RuleError("id is repeated")
            pack.rules.append(compile_rule(doc))
            seen.add(name)
        except RuleError as bad:
            pack.errors.append(f"{name}: {bad}")
    pack.hash = hashlib.sha256(json.dumps([version, documents], sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    return pack


def load_pack(manifest: str) -> Pack:
    """A manifest file (version, rules: list of relative paths) with its rule files; unlisted files are errors."""
    path = Path(manifest)
    doc = load_yaml(path.read_text(encoding="utf-8"))
    if not isinstance(doc, dict) or set(doc) != {"version", "rules"} or not isinstance(doc["rules"], list):
        raise RuleError("a manifest has just version and rules")
    listed = [str(r) for r in doc["rules"]]
    errors = [f"{r}: listed twice" for r in {r for r in listed if listed.count(r) > 1}]
    documents = []
    for name in dict.fromkeys(listed):
        try:
            documents.append(load_yaml((path.parent / name).read_text(encoding="utf-8")))
        except (OSError, RuleError, yaml.YAMLError) as bad:
            errors.append(f"{name}: {bad}")
    found = {str(p.relative_to(path.parent)) for p in path.parent.rglob("*.yml") if p != path}
    errors += [f"{name}: not in the manifest" for name in sorted(found - set(listed))]
    pack = build_pack(str(doc["version"]), documents)
    pack.errors = errors + pack.errors
    return pack


def run_fixtures(spark: SparkSession, pack: Pack, cases: list[dict]) -> DataFrame:
    """cases: rule_id, name, expected, event (mapping). All in one pass -> rule_id, name, expected, matched."""
    rows = spark.createDataFrame([(c["rule_id"], c["name"], c["expected"], json.dumps(c["event"])) for c in cases], "rule_id string, name string, expected boolean, event string")
    rows = rows.withColumn("event", F.parse_json("event"))
    resolver = VariantResolver(F.col("event"))
    known = {r.id for r in pack.rules}
    matched = F.coalesce(*[F.when(F.col("rule_id") == r.id, r.gate(resolver.text("event_class"), resolver.text("schema_version")) & r.matches(resolver)) for r in pack.rules if r.id in known], F.lit(False))
    return rows.select("rule_id", "name", "expected", matched.alias("matched"))


def publish(spark: SparkSession, pack: Pack, documents: list[dict], base: str, *, published_by: str, at: str) -> int:
    """Make a version the active one; returns the number of its commit.

    The rules go to a folder of their own. Then one file, the next number of the log, says that they are active, what they
    supersede, and what the audit log is to hold. Of several publishers that meet, one can make that file; the others are
    told, and what they wrote is never read. A version can be published once."""
    if pack.errors:
        raise RuleError("; ".join(pack.errors[:20]))
    if not published_by.strip():
        raise RuleError("who publishes must be named")
    before, number = commits(spark, base), 1 + max((int(n[:-5]) for n in names_in(spark, f"{base}/commits") if n.endswith(".json") and n[:-5].isdigit()), default=0)
    if pack.version in {c["pack_version"] for c in before}:
        raise RuleError(f"{pack.version} is published already")
    folder = f"{base}/rules/{uuid.uuid4().hex}"
    rows = [(pack.version, d["id"], d["version"], json.dumps(d, sort_keys=True)) for d in documents]
    spark.createDataFrame(rows, RULES_SCHEMA).write.mode("errorifexists").parquet(folder)
    after = {"pack_version": pack.version, "hash": pack.hash, "rule_count": len(documents), "published_at": at}
    record = after | {
        "number": number, "published_by": published_by, "folder": folder, "supersedes": before[-1]["pack_version"] if before else None,
        "audit": {"tenant_id": PLATFORM_TENANT, "actor": published_by, "action_type": "rule_pack.publish", "target": pack.version, "after": after, "created_at": at}}
    if not create_once(spark, f"{base}/commits/{number:08d}.json", json.dumps(record, sort_keys=True)):
        remove(spark, folder)
        raise RuleError("another version was published meanwhile")
    return number


def commits(spark: SparkSession, base: str) -> list[dict]:
    """What was published, in order. A file that its publisher did not finish is no commit."""
    out = []
    for name in names_in(spark, f"{base}/commits"):
        try:
            out.append(json.loads(text_of(spark, f"{base}/commits/{name}")))
        except ValueError:
            continue
    return out


def published(spark: SparkSession, base: str) -> DataFrame:
    """The versions with their status: the last one is active, the others are superseded by the next."""
    log = commits(spark, base)
    rows = [(c["number"], c["pack_version"], c["hash"], c["rule_count"], c["published_by"], c["published_at"], "active" if c is log[-1] else "superseded") for c in log]
    return spark.createDataFrame(rows, "number int, pack_version string, hash string, rule_count int, published_by string, published_at string, status string")


def publish_audit(spark: SparkSession, base: str) -> DataFrame:
    """The rows of the audit log that publishing made."""
    rows = [(*[c["audit"][k] for k in ("tenant_id", "actor", "action_type", "target")], json.dumps(c["audit"]["after"], sort_keys=True), c["audit"]["created_at"]) for c in commits(spark, base)]
    return spark.createDataFrame(rows, "tenant_id string, actor string, action_type string, target string, after string, created_at string")


def active_pack(spark: SparkSession, base: str) -> Pack | None:
    """The version published last."""
    log = commits(spark, base)
    if not log:
        return None
    rules = spark.read.schema(RULES_SCHEMA).parquet(log[-1]["folder"]).orderBy("rule_id").collect()  # a pack's rules: a few hundred
    return build_pack(log[-1]["pack_version"], [json.loads(r.definition) for r in rules])
