"""Asset identity: which computer an observation belongs to, in order of arrival, with manual merges and splits.

The rules need order: an identifier bound by one observation decides the next. `Resolver` answers a log in order; the
streaming processor gives it a state store in place of its dicts. In the batch form only what can touch must be in one order:
identifiers that an observation names together, and whatever a merge or split names, are linked, and each connected
component is replayed by itself. An asset's id comes from the row that made it, so that it does not depend on the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.operators.components import components
from sparkwarden.session import ship_package
from sparkwarden.storage import written

# The name of the match by each kind of identifier, strongest first.
MATCH_RULES = {"device_id": "device_id_exact", "hostname_os": "hostname_os", "mac": "mac_exact"}
ASSET_SCHEMA = """tenant_id string, asset_id string, hostname string, os_family string, os_name string, os_version string, ip string, mac string,
sources array<string>, agent_status string, dedup_rule string, first_seen timestamp, last_seen timestamp, state string"""
BINDING_SCHEMA = "tenant_id string, seq long, asset_id string, matched_rule string, created boolean, bound array<string>"


def identifier_keys() -> Column:
    """`kind:value` of the identifiers of an observation, strongest first."""
    present = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    named = lambda kind, value: F.concat(F.lit(f"{kind}:"), value)
    return F.filter(F.array(
        F.when(present("device_id"), named("device_id", F.col("device_id"))),
        F.when(present("hostname") & present("os_family"), named("hostname_os", F.concat(F.lower("hostname"), F.lit("|"), F.lower("os_family")))),
        F.when(present("mac"), named("mac", F.lower("mac"))),
    ), lambda k: k.isNotNull())


def identifiers(row) -> list[tuple[str, str]]:
    """(kind, value) of an observation, strongest first."""
    if row.get("keys") is not None:
        return [tuple(k.split(":", 1)) for k in row["keys"]]
    out = []
    if row.get("device_id"):
        out.append(("device_id", row["device_id"]))
    if row.get("hostname") and row.get("os_family"):
        out.append(("hostname_os", f"{row['hostname'].lower()}|{row['os_family'].lower()}"))
    if row.get("mac"):
        out.append(("mac", row["mac"].lower()))
    return out


@dataclass
class Resolver:
    """Assets, the asset of each identifier, those that are pinned, and the identifiers of each asset."""

    tenant_id: str
    assets: dict[str, dict] = field(default_factory=dict)
    identities: dict[tuple[str, str], str] = field(default_factory=dict)
    pins: dict[tuple[str, str], str] = field(default_factory=dict)
    owned: dict[str, list[tuple[str, str]]] = field(default_factory=dict)

    def device_of(self, asset_id: str) -> str | None:
        return next((v for k, v in self.owned.get(asset_id, []) if k == "device_id"), None)

    def match(self, row, keys) -> tuple[str | None, str | None]:
        for kind, value in keys:
            pinned = self.pins.get((kind, value))
            found = pinned or self.identities.get((kind, value))
            if found is None:
                continue
            if kind != "device_id" and row.get("device_id"):
                bound = self.assets[found].get("device_id")
                if bound and bound != row["device_id"]:
                    continue
            return found, None if pinned else MATCH_RULES[kind]
        return None, None

    def new_id(self, row) -> str:
        return "as_" + hashlib.sha256(f"{self.tenant_id}:{row['seq']}".encode()).hexdigest()[:26]

    def observe(self, row) -> dict | None:
        keys = identifiers(row)
        if not keys:
            return None
        asset_id, rule = self.match(row, keys)
        created = asset_id is None
        at = row["observed_at"]
        seen = {"hostname": (row.get("hostname") or "").lower() or None, "mac": (row.get("mac") or "").lower() or None} | {k: row.get(k) for k in ("os_family", "os_name", "os_version", "ip")}
        if created:
            asset_id = self.new_id(row)
            agent = row.get("source") == "agent"
            self.assets[asset_id] = seen | {"sources": [row.get("source")], "agent_status": "enrolled" if agent else "none", "dedup_rule": "agent_enrollment" if agent else "log_ingest", "first_seen": at, "last_seen": at, "state": "active"}
        else:
            a = self.assets[asset_id]
            a |= {k: v for k, v in seen.items() if v is not None}
            a["last_seen"] = max(a["last_seen"], at)
            if row.get("source") not in a["sources"]:
                a["sources"].append(row.get("source"))
            if rule and not a["dedup_rule"].startswith("manual"):
                a["dedup_rule"] = rule
        bound = []
        for key in keys:
            if self.pins.get(key, asset_id) != asset_id or self.identities.get(key, asset_id) != asset_id:
                continue
            if key not in self.identities:
                bound.append(f"{key[0]}:{key[1]}")
                self.owned[asset_id] = [*self.owned.get(asset_id, []), key]
            self.identities[key] = asset_id
            if key[0] == "device_id":
                self.assets[asset_id]["device_id"] = key[1]
        return {"asset_id": asset_id, "matched_rule": rule, "created": created, "bound": bound}

    def merge(self, ids: list[str]) -> str | None:
        """The first asset survives: it gets the others' identities, pinned, their sources and times."""
        ids = [i for i in dict.fromkeys(ids) if i in self.assets and self.assets[i]["state"] == "active"]
        if len(ids) < 2:
            return None
        keep, rest = ids[0], ids[1:]
        a = self.assets[keep]
        self.owned[keep] = [key for i in ids for key in self.owned.get(i, [])]
        for key in self.owned[keep]:
            self.identities[key] = self.pins[key] = keep
        for other in rest:
            b = self.assets[other]
            a["sources"] = sorted(set(a["sources"]) | set(b["sources"]))
            a["first_seen"], a["last_seen"] = min(a["first_seen"], b["first_seen"]), max(a["last_seen"], b["last_seen"])
            a["device_id"] = a.get("device_id") or b.get("device_id")
            if a["agent_status"] == "none":
                a["agent_status"] = b["agent_status"]
            b["state"], self.owned[other] = "merged", []
        a["dedup_rule"] = "manual_merge"
        return keep

    def split(self, asset_id: str, keys: list[tuple[str, str]], row) -> str | None:
        """A new asset from some of an asset's identities, pinned to it; the agent's status goes with its device id."""
        own = [k for k in keys if self.identities.get(k) == asset_id]
        if not own or asset_id not in self.assets:
            return None
        a, new = self.assets[asset_id], self.new_id(row)
        moves = any(k[0] == "device_id" for k in own)
        self.owned[new], self.owned[asset_id] = own, [k for k in self.owned[asset_id] if k not in own]
        self.assets[new] = dict(a) | {"sources": list(a["sources"]), "dedup_rule": "manual_split", "agent_status": a["agent_status"] if moves else "none", "device_id": next((v for k, v in own if k == "device_id"), None)}
        if moves:
            a["agent_status"], a["device_id"] = "none", self.device_of(asset_id)
        for key in own:
            self.identities[key] = self.pins[key] = new
        for key in self.owned[asset_id]:
            self.pins[key] = asset_id
        return new

    def apply(self, row) -> dict | None:
        kind = row.get("action") or "observe"
        if kind == "observe":
            return self.observe(row)
        ids = list(row["asset_ids"]) if row.get("asset_ids") is not None else []
        if kind == "merge":
            done = self.merge(ids)
        else:
            keys = [tuple(k.split(":", 1)) for k in (row["identities"] if row.get("identities") is not None else [])]
            done = self.split(ids[0], keys, row) if ids else None
        return None if done is None else {"asset_id": done, "matched_rule": f"manual_{kind}", "created": kind == "split", "bound": []}

    def rows(self) -> list[tuple]:
        cols = ("hostname", "os_family", "os_name", "os_version", "ip", "mac", "sources", "agent_status", "dedup_rule", "first_seen", "last_seen", "state")
        return [(self.tenant_id, i, *[a.get(c) for c in cols]) for i, a in self.assets.items()]


def _clean(batch: pd.DataFrame) -> list[dict]:
    return [{k: (None if not isinstance(v, (list, tuple)) and not hasattr(v, "__len__") and pd.isna(v) else v) for k, v in r.items()} for r in batch.to_dict("records")]


def with_component(log: DataFrame) -> DataFrame:
    """log with `keys` (its identifiers) and `component`: rows of different components cannot touch. Rows without any
    identifier, and actions that name nothing, are in none and go."""
    kind = F.coalesce("action", F.lit("observe"))
    rows = log.withColumns({"keys": F.when(kind == "observe", identifier_keys()).otherwise(F.array().cast("array<string>")), "_action": F.concat(F.lit("action:"), F.col("seq").cast("string"))})
    name = lambda c: F.concat(F.col("tenant_id"), F.lit("\x1f"), c)
    observed = rows.filter((kind == "observe") & (F.size("keys") > 0))
    together = observed.select("tenant_id", F.element_at("keys", 1).alias("first"), F.explode("keys").alias("key")).distinct()
    links = together.select(name(F.col("first")).alias("u"), name(F.col("key")).alias("v"))
    actions = written(rows.filter(kind != "observe"), "actions")
    if not actions.isEmpty():
        asset = lambda c: F.concat(F.lit("asset:"), c)
        named = F.concat(F.transform(F.coalesce("asset_ids", F.array().cast("array<string>")), asset), F.coalesce("identities", F.array().cast("array<string>")))
        acted = actions.select("tenant_id", "_action", F.explode(named).alias("key"))
        own_id = F.concat(F.lit("as_"), F.substring(F.sha2(F.concat_ws(":", "tenant_id", F.col("seq").cast("string")), 256), 1, 26))
        makers = observed.select("tenant_id", asset(own_id).alias("key"), F.element_at("keys", 1).alias("made_by")).unionByName(actions.select("tenant_id", asset(own_id).alias("key"), F.col("_action").alias("made_by")))
        made = makers.join(acted.select("tenant_id", "key").distinct(), ["tenant_id", "key"], "left_semi")
        links = links.union(acted.select(name(F.col("_action")), name(F.col("key")))).union(made.select(name(F.col("key")), name(F.col("made_by"))))
    node = name(F.when(kind == "observe", F.element_at("keys", 1)).otherwise(F.col("_action")))
    placed = rows.filter((kind != "observe") | (F.size("keys") > 0)).withColumn("node", node)
    return placed.join(components(links), "node").drop("node", "_action")


def resolve(log: DataFrame) -> DataFrame:
    """log(tenant_id, seq, observed_at, source, ..., action, asset_ids, identities) -> the asset of each row.

    A component's rows reach its task in order and in batches of bounded size."""
    ship_package(log.sparkSession)

    def run(tenant: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = Resolver(tenant)
        for batch in batches:
            done = [(r["tenant_id"], r["seq"], state.apply(r)) for r in _clean(batch)]
            rows = [(t, s, d["asset_id"], d["matched_rule"], d["created"], d["bound"]) for t, s, d in done if d]
            yield pd.DataFrame(rows, columns=["tenant_id", "seq", "asset_id", "matched_rule", "created", "bound"])

    return _in_order(with_component(log), run, BINDING_SCHEMA)


def assets(log: DataFrame) -> DataFrame:
    """The assets after the whole log."""
    ship_package(log.sparkSession)

    def run(tenant: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = Resolver(tenant)
        for batch in batches:
            for r in _clean(batch):
                state.apply(r)
        yield pd.DataFrame(state.rows(), columns=[c.split()[0] for c in ASSET_SCHEMA.replace("\n", " ").split(", ")])

    return _in_order(with_component(log), run, ASSET_SCHEMA)


def _in_order(log: DataFrame, run, schema: str) -> DataFrame:
    """Components in hash partitions, each partition sorted by component and sequence, and read batch by batch."""
    def partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = (part for batch in batches for part in batch.groupby("component", sort=False))
        for _, own in groupby(parts, key=lambda part: part[0]):
            first = next(own)[1]
            yield from run(first["tenant_id"].iloc[0], chain([first], (part for _, part in own)))

    return log.repartition("component").sortWithinPartitions("component", "seq").mapInPandas(partition, schema)


def match_once(observations: DataFrame, pins: DataFrame, identities: DataFrame) -> DataFrame:
    """Stateless form: the asset each observation would match against given tables, by joins only.

    observations(tenant_id, obs_id, device_id, hostname, os_family, mac); pins and identities(tenant_id, kind, value, asset_id).
    """
    keyed = observations.select("tenant_id", "obs_id", "device_id", F.explode(F.filter(F.array(
        F.struct(F.lit(0).alias("rank"), F.lit("device_id").alias("kind"), F.col("device_id").alias("value")),
        F.struct(F.lit(1).alias("rank"), F.lit("hostname_os").alias("kind"), F.concat(F.lower("hostname"), F.lit("|"), F.lower("os_family")).alias("value")),
        F.struct(F.lit(2).alias("rank"), F.lit("mac").alias("kind"), F.lower("mac").alias("value")),
    ), lambda k: k["value"].isNotNull())).alias("k")).select("tenant_id", "obs_id", "device_id", "k.*")
    devices = identities.filter("kind = 'device_id'").groupBy("tenant_id", "asset_id").agg(F.min("value").alias("_bound"))
    known = keyed.join(pins.withColumnRenamed("asset_id", "_pin"), ["tenant_id", "kind", "value"], "left").join(identities.withColumnRenamed("asset_id", "_identity"), ["tenant_id", "kind", "value"], "left")
    known = known.withColumn("asset_id", F.coalesce("_pin", "_identity")).filter("asset_id is not null").join(devices, ["tenant_id", "asset_id"], "left")
    held = (F.col("kind") != "device_id") & F.col("device_id").isNotNull() & F.col("_bound").isNotNull() & (F.col("_bound") != F.col("device_id"))
    best = known.filter(~held).groupBy("tenant_id", "obs_id").agg(F.min_by("asset_id", "rank").alias("asset_id"))
    return observations.join(best, ["tenant_id", "obs_id"], "left")


def with_latest_device(assets: DataFrame, devices: DataFrame) -> DataFrame:
    """Assets with their device enrolled last."""
    last = devices.groupBy("tenant_id", "asset_id").agg(F.max_by(F.struct("device_id", "agent_version", "last_heartbeat"), F.struct("created_at", "device_id")).alias("agent"))
    return assets.join(last, ["tenant_id", "asset_id"], "left")


def _picked(names: list[str]):
    return lambda x: F.struct(*[x[c].alias(c) for c in names])


def asset_view(assets: DataFrame, devices: DataFrame, identities: DataFrame | None = None, merges: DataFrame | None = None) -> DataFrame:
    """Nested form of assets: summary with the latest agent; with identities and merges, the detail of each."""
    rows = with_latest_device(assets, devices)
    out = ["asset_id", "state"]
    for table, name, fields, at in ((identities, "identities", ("source", "kind", "value", "first_seen", "last_seen"), "first_seen"), (merges, "merge_audit", ("at", "rule", "actor", "details"), "at")):
        if table is not None:
            own = [c for c in fields if c in table.columns]
            of = table.groupBy("tenant_id", "asset_id").agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("_at"), *[F.col(c) for c in own]))).alias(name))
            rows = rows.join(of, ["tenant_id", "asset_id"], "left").withColumn(name, F.transform(F.coalesce(name, F.array().cast(of.schema[name].dataType)), _picked(own)))
            out.append(name)
    summary = [c for c in ("hostname", "os_family", "os_name", "os_version", "sources", "agent_status", "agent", "billable", "first_seen", "last_seen", "created_via", "merged_into") if c in rows.columns]
    return rows.select("tenant_id", *out, *summary)


def billable(assets: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Number of active, not revoked assets seen within the window, by tenant."""
    seen = F.col("last_seen") >= F.lit(as_of) - F.expr(f"interval {days} days")
    return assets.filter((F.col("state") == "active") & (F.col("agent_status") != "revoked") & seen).groupBy("tenant_id").agg(F.count("*").alias("billable"))


def offline(devices: DataFrame, as_of, interval_s: int = 60, missed: int = 3) -> DataFrame:
    """Devices with agent_status offline where no heartbeat came for `missed` intervals; revoked ones stay so."""
    late = F.col("last_heartbeat") < F.lit(as_of) - F.expr(f"interval {interval_s * missed} seconds")
    return devices.withColumn("agent_status", F.when(F.col("agent_status") == "revoked", "revoked").when(late, "offline").otherwise("healthy"))
