"""Exact stateful forms, in arrival order: alerts with correlation, asset identity, the status of agents, and admission.

State ends. What makes a repeated event known, and an alert that correlation may meet, has a time to live; an alert without
a hit for that long is given up by a timer, which says so (`expired`). Times to live and those timers run on processing time,
since a late hit must still find its alert: in event time Spark would drop it. Spark then goes on with batches without rows,
to look at timers; a query that is to end with its input (availableNow) needs spark.sql.streaming.noDataMicroBatches.enabled
set to false, and looks at timers when it next has rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkwarden.operators.alerts import CORRELATION_MINUTES, DEDUP_MINUTES
from sparkwarden.operators.assets import BINDING_SCHEMA, Resolver, _clean
from sparkwarden.operators.usage import BUCKET_SECONDS, BUCKETS
from sparkwarden.session import ship_package

ALERT_CHANGES = """tenant_id string, rule_id string, entity_key string, alert_id string, change string, event_id string, occurrence_count int,
first_seen timestamp, last_seen timestamp, title string, severity string, entity_hostname string"""
STATUS_CHANGES = "tenant_id string, device_id string, status string, at timestamp"
#: How long state is kept without news, and the heartbeats after which an agent is offline.
KEEP = timedelta(days=30)
HEARTBEAT_S, MISSED = 60, 3


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.replace("\n", " ").split(", ")]


def stamp(t):
    return t.to_pydatetime() if hasattr(t, "to_pydatetime") else t


def millis(t: datetime) -> int:
    return round(t.replace(tzinfo=timezone.utc).timestamp() * 1000)


def alert_id(tenant: str, rule: str, entity: str, event: str) -> str:
    """An alert's id comes from the event that opened it, so that it needs no counter."""
    return "al_" + hashlib.sha256("\x1f".join([tenant, rule, entity, event]).encode()).hexdigest()[:26]


def wake(handle: StatefulProcessorHandle, at_ms: int) -> None:
    """Have one timer, at this time."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    handle.registerTimer(at_ms)


class AlertDedup(StatefulProcessor):
    """One open alert for each (tenant, rule, entity). A hit joins it if its last time is not more than the window before
    the hit's, so a late hit always joins; else it is closed and a new one opens. A repeated event changes nothing.
    Rows of a key are taken by `arrival` within a batch. A `close` action makes the next hit open a new alert. Without
    a row for `keep`, an open alert expires and the key's state is dropped."""

    def __init__(self, keep: timedelta = KEEP):
        self.keep_ms = round(keep.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "alert_id string, count int, first_seen timestamp, last_seen timestamp, title string, severity string, host string, is_open boolean")
        self.linked = handle.getMapState("linked", "event_id string", "n int", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tenant, rule, entity = key
        state = self.open.get()
        own, count, first, last, title, severity, host, is_open = state if state is not None else (None, 0, None, None, None, None, None, False)
        window, out = timedelta(minutes=DEDUP_MINUTES), []

        def change(kind: str, event_id: str | None) -> None:
            out.append((tenant, rule, entity, own, kind, event_id, count, first, last, title, severity, host))

        batch = pd.concat(list(rows)).sort_values("arrival")
        for r in batch.to_dict("records"):
            if r["kind"] == "close":
                if is_open:
                    is_open = False
                    change("closed", None)
                continue
            if self.linked.containsKey((r["event_id"],)):
                continue
            self.linked.updateValue((r["event_id"],), (1,))
            at = r["event_time"]
            if is_open and last >= at - window:
                count, last = count + 1, max(last, at)
                change("updated", r["event_id"])
                continue
            if is_open:
                change("closed", None)
            own, count, first, last, is_open = alert_id(tenant, rule, entity, r["event_id"]), 1, at, at, True
            title, severity, host = r["title"], r["severity"], r["entity_hostname"]
            change("opened", r["event_id"])
        if own:
            self.open.update((own, count, stamp(first), stamp(last), title, severity, host, is_open))
            wake(self.handle, timerValues.getCurrentProcessingTimeInMs() + self.keep_ms)
        yield pd.DataFrame(out, columns=names(ALERT_CHANGES))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, out = self.open.get(), []
        if state is not None and state[-1]:
            own, count, first, last, title, severity, host, _ = state
            out.append((*key, own, "expired", None, count, first, last, title, severity, host))
        self.open.clear()
        self.linked.clear()
        yield pd.DataFrame(out, columns=names(ALERT_CHANGES))

    def close(self) -> None:
        pass


class Correlate(StatefulProcessor):
    """Groups alerts of a host as they open: with one by another rule seen within the window before, the new alert joins
    the group of the latest such alert that has one, or both start a group; existing groups are never merged.

    Alerts stand in slots of one window by the time they were last seen, so a row reads the slots from one window before
    it on, not all of a host's alerts. Slots end with their time to live."""

    def __init__(self, keep: timedelta = KEEP):
        self.keep_ms = round(keep.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getMapState("slots", "slot long", "alerts string", self.keep_ms)
        self.places = handle.getMapState("places", "alert_id string", "slot long", self.keep_ms)

    def slot_of(self, at: datetime) -> int:
        return millis(at) // (CORRELATION_MINUTES * 60_000)

    def read(self, slot: int) -> dict[str, list]:
        """Alerts of a slot: rule, milliseconds of the last time, group."""
        return json.loads(self.slots.getValue((slot,))[0]) if self.slots.containsKey((slot,)) else {}

    def put(self, alert: str, entry: list, slot: int) -> None:
        if (old := self.place(alert)) is not None and old != slot:
            self.remove(alert, old)
        self.slots.updateValue((slot,), (json.dumps(self.read(slot) | {alert: entry}),))
        self.places.updateValue((alert,), (slot,))

    def place(self, alert: str) -> int | None:
        return self.places.getValue((alert,))[0] if self.places.containsKey((alert,)) else None

    def remove(self, alert: str, slot: int) -> None:
        left = {k: v for k, v in self.read(slot).items() if k != alert}
        if left:
            self.slots.updateValue((slot,), (json.dumps(left),))
        elif self.slots.containsKey((slot,)):
            self.slots.removeKey((slot,))
        self.places.removeKey((alert,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tenant, host = key
        out = []
        for r in pd.concat(list(rows)).sort_values("arrival").to_dict("records"):
            at, own = stamp(r["last_seen"]), r["alert_id"]
            if r["change"] != "opened":
                if (old := self.place(own)) is not None:
                    entry = self.read(old).get(own)
                    if r["change"] == "updated" and entry:
                        self.put(own, [entry[0], millis(at), entry[2]], self.slot_of(at))
                    elif r["change"] != "updated":
                        self.remove(own, old)
                continue
            since = millis(at) - CORRELATION_MINUTES * 60_000
            known: dict[str, list] = {}
            for slot in sorted(k[0] for k in self.slots.keys() if k[0] >= self.slot_of(at) - 1):
                known |= self.read(slot)
            near = sorted(((v[1], k) for k, v in known.items() if v[0] != r["rule_id"] and v[1] >= since), reverse=True)
            group = next((known[k][2] for _, k in near if known[k][2]), None)
            if near and group is None:
                group = "cg_" + hashlib.sha256(f"{tenant}\x1f{host}\x1f{own}".encode()).hexdigest()[:26]
            for _, k in near:
                if not known[k][2]:
                    self.put(k, [*known[k][:2], group], self.place(k))
                    out.append((tenant, k, group))
            self.put(own, [r["rule_id"], millis(at), group], self.slot_of(at))
            if group:
                out.append((tenant, own, group))
        yield pd.DataFrame(out, columns=["tenant_id", "alert_id", "group_id"])

    def close(self) -> None:
        pass


class Kept(dict):
    """A map state as a dict: a key is loaded when it is first asked for, and written back at the end if it has changed."""

    def __init__(self, state, load: Callable[[str], object], dump: Callable[[object], str], name: Callable[[object], str] = str):
        super().__init__()
        self.state, self.load, self.dump, self.name = state, load, dump, name
        self.seen: dict[object, str | None] = {}

    def __contains__(self, key) -> bool:
        if key not in self.seen:
            found = self.state.getValue((self.name(key),))[0] if self.state.containsKey((self.name(key),)) else None
            self.seen[key] = found
            if found is not None:
                super().__setitem__(key, self.load(found))
        return super().__contains__(key)

    def __getitem__(self, key):
        if key not in self:
            raise KeyError(key)
        return super().__getitem__(key)

    def __setitem__(self, key, value) -> None:
        self.seen.setdefault(key, None)
        super().__setitem__(key, value)

    def get(self, key, default=None):
        return self[key] if key in self else default

    def flush(self) -> None:
        for key, value in self.items():
            now = self.dump(value)
            if now != self.seen[key]:
                self.state.updateValue((self.name(key),), (now,))
                self.seen[key] = now


class Assets(StatefulProcessor):
    """The tenant's resolver over keyed states: a batch loads and writes only the assets and identifiers that it touches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.states = {k: handle.getMapState(k, "name string", "value string") for k in ("assets", "identities", "pins", "owned")}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pair = ":".join
        kept = {
            "assets": Kept(self.states["assets"], load_asset, dump_asset), "owned": Kept(self.states["owned"], lambda t: [tuple(k) for k in json.loads(t)], json.dumps),
            "identities": Kept(self.states["identities"], str, str, pair), "pins": Kept(self.states["pins"], str, str, pair),
        }
        resolver = Resolver(key[0], **kept)
        done = [(r["tenant_id"], r["seq"], resolver.apply(r)) for r in _clean(pd.concat(list(rows)).sort_values("seq"))]
        for state in kept.values():
            state.flush()
        out = [(t, s, d["asset_id"], d["matched_rule"], d["created"], d["bound"]) for t, s, d in done if d]
        yield pd.DataFrame(out, columns=names(BINDING_SCHEMA))

    def close(self) -> None:
        pass


def dump_asset(asset: dict) -> str:
    return json.dumps({k: str(v) if k in ("first_seen", "last_seen") else v for k, v in asset.items()})


def load_asset(text: str) -> dict:
    asset = json.loads(text)
    return asset | {k: pd.Timestamp(asset[k]) for k in ("first_seen", "last_seen")}


class AgentStatus(StatefulProcessor):
    """healthy with the first heartbeat, offline when none has come for `after_s`, healthy again with the next one, and
    never again anything once revoked. Rows of a batch are taken by time; an outage between two of them, which no timer has
    met, is told as well, so results do not depend on how rows fall into batches. A heartbeat older than the last one
    changes nothing."""

    def __init__(self, after_s: int, event_time: bool):
        self.after, self.event_time = timedelta(seconds=after_s), event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("status", "status string, last timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, last = self.state.get() or (None, None)
        before, out = (status, last), []
        for at, kind in sorted((stamp(r["at"]), r["kind"]) for part in rows for r in part.to_dict("records")):
            if status == "revoked":
                break
            if kind == "revoke":
                status, last = "revoked", at
                out.append((*key, status, at))
                continue
            if status == "healthy" and self.event_time and at > last + self.after:
                out.append((*key, "offline", last + self.after))
                status = "offline"
            if status != "healthy" and (last is None or at > last):
                status = "healthy"
                out.append((*key, status, at))
            last = at if last is None else max(last, at)
        if (status, last) != before:
            self.state.update((status, last))
            if status == "healthy":
                wake(self.handle, millis(last + self.after) if self.event_time else timerValues.getCurrentProcessingTimeInMs() + round(self.after.total_seconds() * 1000))
            elif status == "revoked":
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
        yield pd.DataFrame(out, columns=names(STATUS_CHANGES))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, last = self.state.get() or (None, None)
        out = []
        if status == "healthy":
            self.state.update(("offline", last))
            out.append((*key, "offline", last + self.after))
        yield pd.DataFrame(out, columns=names(STATUS_CHANGES))

    def close(self) -> None:
        pass


class Admission(StatefulProcessor):
    """Whether each request of a key is admitted, in the order of arrival, and by time and id within a batch.

    By rate: buckets of BUCKET_SECONDS in a ring of BUCKETS; a request that would bring their sum over the limit is refused
    and takes nothing. By fixed window: the first request after the last window starts one, and `limit` are admitted in it.
    A late request is taken at the time of the newest before it. Once a key's ring or window is past, it has no state."""

    def __init__(self, limit: int, seconds: int | None, event_time: bool):
        self.limit, self.seconds, self.event_time = limit, seconds, event_time
        self.lasts = seconds or BUCKET_SECONDS * BUCKETS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("taken", "newest bigint, taken string")

    def by_rate(self, ring: list, second: int, amount: int) -> tuple[bool, list]:
        bucket = second // BUCKET_SECONDS
        ring = [r for r in ring if r[0] > bucket - BUCKETS]
        if sum(n for _, n in ring) + amount > self.limit:
            return False, ring
        if ring and ring[-1][0] == bucket:
            return True, [*ring[:-1], [bucket, ring[-1][1] + amount]]
        return True, [*ring, [bucket, amount]]

    def by_window(self, window: list, second: int, amount: int) -> tuple[bool, list]:
        start, asked = window or (second, 0)
        start, asked = (second, 1) if second >= start + self.seconds else (start, asked + 1)
        return asked <= self.limit, [start, asked]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest, text = self.state.get() or (None, "[]")
        taken, ask = json.loads(text), self.by_rate if self.seconds is None else self.by_window
        batch = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        said = []
        for second, amount in zip(batch["second"], batch["amount"]):
            if pd.isna(second):
                said.append(False)
                continue
            newest = int(second) if newest is None else max(newest, int(second))
            admitted, taken = ask(taken, newest, int(amount))
            said.append(admitted)
        if newest is not None:
            self.state.update((newest, json.dumps(taken)))
            wake(self.handle, (newest + self.lasts) * 1000 if self.event_time else timerValues.getCurrentProcessingTimeInMs() + self.lasts * 1000)
        yield pd.DataFrame({"key": [key[0]] * len(batch), "id": batch["id"].to_list(), "admitted": said}, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame(columns=["key", "id", "admitted"], dtype=object)

    def close(self) -> None:
        pass


class FirstSeen(StatefulProcessor):
    """The first row of each key by time, once for all."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        if not self.done.exists():
            first = stamp(min(part["ingest_time"].min() for part in rows))
            self.done.update((first,))
            out.append((*key, first))
        yield pd.DataFrame(out, columns=["tenant_id", "first_event_at"])

    def close(self) -> None:
        pass


def alert_changes(hits: DataFrame, keep: timedelta = KEEP) -> DataFrame:
    """hits with arrival (a number that grows) and kind (hit or close), a stream or not -> changes of alerts."""
    ship_package(hits.sparkSession)
    return hits.groupBy("tenant_id", "rule_id", "entity_key").transformWithStateInPandas(AlertDedup(keep), ALERT_CHANGES, "Update", "ProcessingTime")


def correlated(changes: DataFrame, keep: timedelta = KEEP) -> DataFrame:
    """changes with arrival -> group membership as it comes about."""
    ship_package(changes.sparkSession)
    on_host = changes.filter(F.col("entity_hostname").isNotNull())
    return on_host.groupBy("tenant_id", "entity_hostname").transformWithStateInPandas(Correlate(keep), "tenant_id string, alert_id string, group_id string", "Update", "ProcessingTime")


def asset_bindings(log: DataFrame) -> DataFrame:
    ship_package(log.sparkSession)
    return log.groupBy("tenant_id").transformWithStateInPandas(Assets(), BINDING_SCHEMA, "Update", "None")


def agent_status(beats: DataFrame, after_s: int = HEARTBEAT_S * MISSED, event_time: str | None = None) -> DataFrame:
    """beats(tenant_id, device_id, kind: heartbeat or revoke, at) -> changes of status as they come about.

    By default an agent is offline when no heartbeat has come for so long by the clock; with `event_time` (a delay for late
    rows), when the stream's own time has passed that point."""
    ship_package(beats.sparkSession)
    rows = beats if event_time is None else beats.withWatermark("at", event_time)
    mode = "ProcessingTime" if event_time is None else "EventTime"
    return rows.groupBy("tenant_id", "device_id").transformWithStateInPandas(AgentStatus(after_s, event_time is not None), STATUS_CHANGES, "Update", mode)


def first_seen(events: DataFrame) -> DataFrame:
    """events(tenant_id, ingest_time) -> when each tenant's first event came, told once."""
    ship_package(events.sparkSession)
    return events.select("tenant_id", "ingest_time").groupBy("tenant_id").transformWithStateInPandas(FirstSeen(), "tenant_id string, first_event_at timestamp", "Update", "None")


def admission(requests: DataFrame, limit: int, *, seconds: int | None = None, event_time: str | None = None) -> DataFrame:
    """requests(key, at, id, amount) -> key, id, admitted: by rate, or with `seconds` by fixed windows of that length, where
    amounts do not count. The same answers as usage.admit_by_rate() and admit_by_fixed_window() where rows come in order.

    By default every request is answered, and a key's state ends when it was not asked for by the clock for as long as a
    ring or window lasts. With `event_time` (a delay for late rows) it ends when the stream's own time is past it, which
    replays need; later rows than that delay are not answered."""
    ship_package(requests.sparkSession)
    rows = requests if event_time is None else requests.withWatermark("at", event_time)
    rows = rows.select("key", "at", "id", F.unix_timestamp("at").alias("second"), F.coalesce(F.col("amount").cast("bigint"), F.lit(0)).alias("amount"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    mode = "ProcessingTime" if event_time is None else "EventTime"
    return rows.groupBy("key").transformWithStateInPandas(Admission(limit, seconds, event_time is not None), f"key {kinds['key']}, id {kinds['id']}, admitted boolean", "Update", mode)
