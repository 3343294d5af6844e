"""Migrations of the library's tables: numbered SQL files with a way up and a way down, and a ledger of what was done.

The catalog has no transactions. So the ledger says when a migration starts and when it is done; one that started and was
not done is `interrupted`, and is run again, for which its statements must be repeatable (IF [NOT] EXISTS). Each entry is
the next numbered file of a folder, which one runner alone can make: of two that start at once, one goes on.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from sparkwarden import schema
from sparkwarden.storage import create_once, names_in, text_of

# The marks of a file's two parts.
UP, DOWN = "-- migrate:up", "-- migrate:down"


class MigrationError(Exception):
    pass


@dataclass(frozen=True)
class Migration:
    name: str
    up: tuple[str, ...]
    down: tuple[str, ...]
    checksum: str


def parse(name: str, text: str) -> Migration:
    """A file: statements end with a semicolon at the end of a line."""
    if text.count(UP) != 1 or text.count(DOWN) != 1 or text.index(UP) > text.index(DOWN):
        raise MigrationError(f"{name}: one part up and then one part down")
    parts = text.split(UP)[1].split(DOWN)
    up, down = (tuple(s.strip() for s in re.split(r";[ \t]*(?:\n|$)", part) if s.strip()) for part in parts)
    if not up or not down:
        raise MigrationError(f"{name}: a part is empty")
    return Migration(name, up, down, hashlib.sha256(text.encode()).hexdigest())


def load(folder: str) -> list[Migration]:
    """The .sql files of a folder, by name."""
    found = [parse(p.name, p.read_text(encoding="utf-8")) for p in sorted(Path(folder).glob("*.sql"))]
    if not found:
        raise MigrationError(f"no migrations in {folder}")
    return found


def own_tables(database: str) -> list[Migration]:
    """The library's tables in a database, events and detections by tenant."""
    tables = (("events", schema.EVENT, "tenant_id"), ("detections", schema.HIT, "tenant_id"), ("asset_observations", schema.OBSERVATION, "tenant_id"), ("dead_letters", schema.DEAD_LETTER, None), ("audit_log", schema.AUDIT, None), ("metering", schema.METERING, None))
    out = []
    for n, (name, columns, by) in enumerate(tables, 1):
        parts = f" partitioned by ({by})" if by else ""
        out.append(parse(f"{n:04d}_{name}.sql", f"{UP}\ncreate table if not exists {database}.{name} ({columns.strip()}) using parquet{parts};\n{DOWN}\ndrop table if exists {database}.{name};\n"))
    return out


class Ledger:
    """What was done to the tables, under a folder that all runners share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def entries(self) -> list[dict]:
        out = []
        for name in names_in(self.spark, self.folder):
            try:
                out.append(json.loads(text_of(self.spark, f"{self.folder}/{name}")))
            except ValueError:  # its runner ended as it wrote it
                continue
        return out

    def states(self) -> dict[str, tuple[str, str]]:
        """name -> (state, checksum): applied, or interrupted on the way up or down. What was reverted is not there."""
        now = {}
        for e in self.entries():
            if e["action"] == "reverted":
                now.pop(e["name"], None)
            else:
                now[e["name"]] = ("applied" if e["action"] == "applied" else "interrupted", e["checksum"])
        return now

    def add(self, action: str, migration: Migration, at: str) -> None:
        number = 1 + max((int(n[:-5]) for n in names_in(self.spark, self.folder) if n.endswith(".json") and n[:-5].isdigit()), default=0)
        entry = {"action": action, "name": migration.name, "checksum": migration.checksum, "at": at}
        if not create_once(self.spark, f"{self.folder}/{number:08d}.json", json.dumps(entry, sort_keys=True)):
            raise MigrationError("another runner is at work")

    def _run(self, migration: Migration, statements: tuple[str, ...], start: str, end: str, at: str) -> None:
        self.add(start, migration, at)
        for statement in statements:
            self.spark.sql(statement)
        self.add(end, migration, at)

    def up(self, migrations: list[Migration], at: str) -> tuple[list[str], list[str]]:
        """(names applied now, names whose files changed since they were applied, which are not run again)."""
        done, drifted = [], []
        for m in sorted(migrations, key=lambda m: m.name):
            state, checksum = self.states().get(m.name, (None, None))
            if state == "applied":
                drifted += [m.name] if checksum != m.checksum else []
                continue
            self._run(m, m.up, "started", "applied", at)
            done.append(m.name)
        return done, drifted

    def down(self, migrations: list[Migration], steps: int, at: str) -> list[str]:
        """Revert the last `steps` by name; one whose file is missing is an error before anything is done."""
        files, last = {m.name: m for m in migrations}, sorted(self.states(), reverse=True)[:steps]
        if missing := [n for n in last if n not in files]:
            raise MigrationError(f"no file for {', '.join(missing)}")
        for name in last:
            self._run(files[name], files[name].down, "reverting", "reverted", at)
        return last

    def status(self, migrations: list[Migration]) -> DataFrame:
        """name, state: pending, applied, drifted, interrupted, or missing (applied, but its file is gone)."""
        now, files = self.states(), {m.name: m for m in migrations}
        rows = []
        for name in sorted({*now, *files}):
            state, checksum = now.get(name, ("pending", None))
            if name not in files:
                state = "missing"
            elif state == "applied" and checksum != files[name].checksum:
                state = "drifted"
            rows.append((name, state))
        return self.spark.createDataFrame(rows, "name string, state string")
