"""The rule language: documents are checked on the driver and become boolean Catalyst columns.

A leaf on a path that does not resolve to a scalar is false, so each leaf is coalesced before any NOT sees it. Constants
are folded once, on the driver; types that can never match make a literal false.
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwarden.functions.text import entity_key, fold, render_number, semver

MAX_DEPTH, MAX_LEAVES, MAX_CHILDREN, MAX_STRING, MAX_LIST, MAX_PATTERN = 8, 64, 32, 1024, 64, 512
SEVERITIES = ("low", "medium", "high", "critical")
# What a rule may name, by class.
ENVELOPE = {
    "activity", "event_time", "time_inferred", "source_type", "source_event_id", "severity_hint", "host.hostname", "host.os_family",
    "host.os_name", "host.os_version", "host.ip", "host.mac", "source.vendor", "source.product", "source.agent_version",
}
_USER = {"user.name", "user.domain", "user.uid"}
_PROCESS = {"process.pid", "process.name", "process.exe_path"}
CLASS_FIELDS = {
    "process_activity": _PROCESS | _USER | {"process.cmd_line", "process.sha256", "process.created_time", "parent.pid", "parent.name", "parent.exe_path", "exit_code"},
    "network_activity": _PROCESS | _USER | {"direction", "protocol", "src.ip", "src.port", "dst.ip", "dst.port", "dst.hostname", "bytes_sent", "bytes_received"},
    "authentication": _USER | {"status", "logon_type", "src_ip", "session_id", "failure_reason"},
    "generic": {"message", "category", "raw_truncated"},
}
REQUIRED = {"id", "version", "title", "description", "severity", "event_class", "min_schema_version", "mitre_technique_ids", "entity", "detection", "false_positives", "references"}
TEXT_TESTS = {"contains": "contains", "startswith": "startswith", "endswith": "endswith"}
NUMBER_TESTS = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}
NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


class RuleError(ValueError):
    """A rule document that cannot be compiled."""


class Resolver(Protocol):
    """Scalar views of a field path, each null where the value is of another type."""

    def text(self, path: str) -> Column | None: ...
    def number(self, path: str) -> Column | None: ...
    def boolean(self, path: str) -> Column | None: ...


class VariantResolver:
    """Paths into a VARIANT column: the type is that of each row's value, nothing is coerced."""

    def __init__(self, event: Column):
        self.event = event

    def _typed(self, path: str, kinds: str, to: str) -> Column:
        at = "$" + "".join(f'["{p}"]' for p in path.split("."))
        kind = F.schema_of_variant(F.try_variant_get(self.event, at, "variant"))
        return F.when(kind.rlike(kinds), F.try_variant_get(self.event, at, to))

    def text(self, path: str) -> Column:
        return self._typed(path, "^STRING$", "string")

    def number(self, path: str) -> Column:
        return self._typed(path, "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL.*|DOUBLE|FLOAT)$", "double")

    def boolean(self, path: str) -> Column:
        return self._typed(path, "^BOOLEAN$", "boolean")


class TypedResolver:
    """Paths into typed columns: only the view of the column's own type exists, so plans stay in generated code.

    `fields.<key>` of generic events, and any other VARIANT column, is read as a variant. A timestamp is matched by its
    text in `<name>_str` where the schema has it.
    """

    def __init__(self, schema: T.StructType):
        self.schema = schema

    def _find(self, path: str) -> tuple[T.DataType | None, list[str]]:
        kind: T.DataType = self.schema
        steps = path.split(".")
        for k, step in enumerate(steps):
            if isinstance(kind, T.VariantType):
                return kind, steps[k:]
            if not isinstance(kind, T.StructType) or step not in kind.names:
                return None, []
            kind = kind[step].dataType
        return kind, []

    def _view(self, path: str, kinds: tuple, of_variant: str) -> Column | None:
        kind, rest = self._find(path)
        if isinstance(kind, T.TimestampType) and f"{path}_str" in self.schema.names:
            return self._view(f"{path}_str", kinds, of_variant)
        if isinstance(kind, T.VariantType) and rest:
            root = path.split(".")[: -len(rest)]
            return getattr(VariantResolver(F.col(".".join(root))), of_variant)(".".join(rest))
        return F.col(path) if isinstance(kind, kinds) else None

    def text(self, path: str) -> Column | None:
        return self._view(path, (T.StringType,), "text")

    def number(self, path: str) -> Column | None:
        return self._view(path, NUMERIC_TYPES, "number")

    def boolean(self, path: str) -> Column | None:
        return self._view(path, (T.BooleanType,), "boolean")


def _kind(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "text"
    raise RuleError(f"a value must be a string, number or boolean, not {type(value).__name__}")


def _strings(value, op: str, single: bool = True) -> list[str]:
    values = value if isinstance(value, list) else [value] if single else None
    if not values or not all(isinstance(v, str) for v in values):
        raise RuleError(f"{op} needs " + ("a string or " * single) + "a list of strings")
    return values


def check_path(path, event_class: str) -> None:
    if not isinstance(path, str) or not re.fullmatch(r"[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)*", path):
        raise RuleError(f"not a field path: {path!r}")
    if path in ENVELOPE or path in CLASS_FIELDS[event_class]:
        return
    if event_class == "generic" and re.fullmatch(r"fields\.[^.]+", path):
        return
    raise RuleError(f"{path} cannot be matched in {event_class}")


def java_pattern(pattern) -> str:
    """A pattern of the linear-time subset in Java's notation, with Unicode classes."""
    if not isinstance(pattern, str) or not pattern or len(pattern) > MAX_PATTERN:
        raise RuleError(f"regex needs a pattern of 1 to {MAX_PATTERN} characters")
    bare = re.sub(r"\\\\", "", pattern)
    if re.search(r"\(\?(?![:iP]|i\))|\(\?P[=>]|\\[1-9]|\\k|[*+?}]\+|\(\?\(", bare) or re.search(r"\(\?<", bare):
        raise RuleError("regex uses what a linear-time engine lacks")
    try:
        re.compile(pattern)
    except re.error as bad:
        raise RuleError(f"regex: {bad}") from bad
    return "(?U)" + pattern.replace("(?P<", "(?<")


def _leaf(node: dict, event_class: str, resolver: Resolver | None) -> Column | None:
    extra = set(node) - {"field", "op", "value"}
    if extra:
        raise RuleError(f"unknown keys in a leaf: {sorted(extra)}")
    path, op, value = node["field"], node.get("op"), node.get("value")
    check_path(path, event_class)
    view_of = {k: (getattr(resolver, k) if resolver else lambda path: None) for k in ("text", "number", "boolean")}
    text, number, boolean = view_of.values()
    for v in value if isinstance(value, list) else [value]:
        if isinstance(v, str) and len(v) > MAX_STRING:
            raise RuleError(f"a string of more than {MAX_STRING} characters")
    if isinstance(value, list) and not 1 <= len(value) <= MAX_LIST:
        raise RuleError(f"a list must have 1 to {MAX_LIST} entries")
    if op == "exists":
        if "value" in node:
            raise RuleError("exists takes no value")
        views = [v.isNotNull() for v in (text(path), number(path), boolean(path)) if v is not None]
        return None if resolver is None else reduce(operator.or_, views) if views else F.lit(False)
    if "value" not in node or value is None:
        raise RuleError(f"{op} needs a value")
    out: Column | None
    if op == "equals":
        view = view_of[_kind(value)](path)
        out = None if view is None else view == F.lit(value)
    elif op == "in":
        if not isinstance(value, list):
            raise RuleError("in needs a list")
        by_kind: dict[str, list] = {}
        for v in value:
            by_kind.setdefault(_kind(v), []).append(v)
        tests = [F.coalesce(view.isin(vs), F.lit(False)) for k, vs in by_kind.items() if (view := view_of[k](path)) is not None]
        out = reduce(operator.or_, tests) if tests else None
    elif op in ("iequals", "iin"):
        values = [v.casefold() for v in ([_strings(value, op)[0]] if op == "iequals" and isinstance(value, str) else _strings(value, op, single=False))]
        if op == "iequals" and not isinstance(value, str):
            raise RuleError("iequals needs a string")
        view = text(path)
        out = None if view is None else fold(view).isin(values)
    elif op in TEXT_TESTS or (isinstance(op, str) and op[:1] == "i" and op[1:] in TEXT_TESTS):
        loose = op not in TEXT_TESTS
        values = [v.casefold() if loose else v for v in _strings(value, op)]
        view = text(path)
        if view is None:
            out = None
        else:
            subject = fold(view) if loose else view
            out = reduce(operator.or_, [getattr(subject, TEXT_TESTS[op[loose:]])(v) for v in values])
    elif op in NUMBER_TESTS:
        if _kind(value) != "number":
            raise RuleError(f"{op} needs a number")
        view = number(path)
        out = None if view is None else NUMBER_TESTS[op](view, F.lit(value))
    elif op == "regex":
        pattern = java_pattern(value)
        view = text(path)
        out = None if view is None else view.rlike(pattern)
    else:
        raise RuleError(f"unknown operator {op!r}")
    if resolver is None:
        return None
    return F.lit(False) if out is None else F.coalesce(out, F.lit(False))


def condition(node, event_class: str, resolver: Resolver | None) -> Column | None:
    """The boolean column of a condition tree, never null; without a resolver the tree is only checked."""
    leaves = 0

    def walk(node, depth: int) -> Column | None:
        nonlocal leaves
        if depth > MAX_DEPTH:
            raise RuleError(f"deeper than {MAX_DEPTH}")
        if not isinstance(node, dict):
            raise RuleError("a node must be a mapping")
        kinds = [k for k in ("field", "all", "any", "not") if k in node]
        if len(kinds) != 1:
            raise RuleError("a node has exactly one of field, all, any, not")
        kind = kinds[0]
        if kind == "field":
            leaves += 1
            if leaves > MAX_LEAVES:
                raise RuleError(f"more than {MAX_LEAVES} leaves")
            return _leaf(node, event_class, resolver)
        if len(node) != 1:
            raise RuleError(f"{kind} has no siblings")
        if kind == "not":
            inner = walk(node["not"], depth + 1)
            return None if resolver is None else ~inner
        children = node[kind]
        if not isinstance(children, list) or not 1 <= len(children) <= MAX_CHILDREN:
            raise RuleError(f"{kind} needs 1 to {MAX_CHILDREN} nodes")
        tests = [walk(c, depth + 1) for c in children]
        return None if resolver is None else reduce(operator.and_ if kind == "all" else operator.or_, tests)

    return walk(node, 1)


@dataclass(frozen=True)
class Rule:
    """A checked rule with its document."""

    id: str
    version: str
    title: str
    severity: str
    event_class: str
    min_schema_version: tuple[int, int, int]
    techniques: tuple[str, ...]
    entity: tuple[str, ...]
    tree: dict

    def gate(self, event_class: Column, schema_version: Column) -> Column:
        """Same class, same major version, and not older than the rule asks for."""
        have = semver(schema_version)
        least = F.struct(*[F.lit(v).alias(n) for v, n in zip(self.min_schema_version, ("major", "minor", "patch"))])
        fits = (have["major"] == self.min_schema_version[0]) & (have >= least)
        return (event_class == self.event_class) & F.coalesce(fits, F.lit(False))

    def matches(self, resolver: Resolver) -> Column:
        return condition(self.tree, self.event_class, resolver)

    def entity_key(self, resolver: Resolver) -> Column:
        parts = []
        for path in self.entity:
            views = [resolver.text(path), resolver.number(path), resolver.boolean(path)]
            shown = [v if k == 0 else render_number(v) if k == 1 else v.cast("string") for k, v in enumerate(views) if v is not None]
            parts.append(F.coalesce(*shown) if shown else F.lit(None).cast("string"))
        return entity_key(parts)


def compile_rule(doc) -> Rule:
    """Check a rule document; its condition is compiled once against no data, so that mistakes show here."""
    if not isinstance(doc, dict):
        raise RuleError("a rule must be a mapping")
    if set(doc) != REQUIRED:
        raise RuleError(f"keys missing {sorted(REQUIRED - set(doc))}, unknown {sorted(set(doc) - REQUIRED)}")
    if not re.fullmatch(r"[a-z0-9]+(-[a-z0-9]+)*", str(doc["id"])):
        raise RuleError("id must be in lower case with hyphens")
    for key in ("version", "min_schema_version"):
        if not re.fullmatch(r"(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)", str(doc[key])):
            raise RuleError(f"{key} must be a semantic version")
    if not isinstance(doc["title"], str) or not 1 <= len(doc["title"]) <= 120:
        raise RuleError("title must have 1 to 120 characters")
    if doc["severity"] not in SEVERITIES:
        raise RuleError(f"severity must be one of {SEVERITIES}")
    if doc["event_class"] not in CLASS_FIELDS:
        raise RuleError(f"event_class must be one of {sorted(CLASS_FIELDS)}")
    techniques = doc["mitre_technique_ids"]
    if not isinstance(techniques, list) or not techniques or not all(re.fullmatch(r"T\d{4}(\.\d{3})?", str(t)) for t in techniques):
        raise RuleError("mitre_technique_ids must be a list of technique ids")
    entity = doc["entity"]
    if not isinstance(entity, list) or not 1 <= len(entity) <= 4:
        raise RuleError("entity must have 1 to 4 paths")
    for path in entity:
        check_path(path, doc["event_class"])
    if not isinstance(doc["detection"], dict) or set(doc["detection"]) != {"condition"}:
        raise RuleError("detection must have just a condition")
    check_tree(doc["detection"]["condition"], doc["event_class"])
    version = tuple(int(x) for x in doc["min_schema_version"].split("."))
    return Rule(doc["id"], doc["version"], doc["title"], doc["severity"], doc["event_class"], version, tuple(techniques), tuple(entity), doc["detection"]["condition"])


def check_tree(node, event_class: str) -> None:
    condition(node, event_class, None)
