"""Text functions as Spark columns: case folding, ids, entity keys, redaction, trimming, safe byte prefixes."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters that full case folding leaves as they are, or folds to capitals, unlike upper then lower case.
_DOTLESS, _SAVED = chr(0x131), chr(0xE000)
_CHEROKEE_SMALL = "".join(map(chr, [*range(0xAB70, 0xABC0), *range(0x13F8, 0x13FE)]))
_CHEROKEE = "".join(map(chr, [*range(0x13A0, 0x13F0), *range(0x13F0, 0x13F6)]))


def fold(text: Column) -> Column:
    """Unicode full case folding, by JVM functions only: upper case first, which spells out letters such as sharp s,
    then lower case; what that does differently is put right by translation. ASCII takes the short way."""
    upper = F.translate(F.upper(F.regexp_replace(F.translate(text, _DOTLESS, _SAVED), chr(0x1E9E), "SS")), chr(0), "")
    lower = F.translate(F.lower(upper), _SAVED + chr(0x3C2) + _CHEROKEE_SMALL, _DOTLESS + chr(0x3C3) + _CHEROKEE)
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), F.lower(text)).otherwise(lower)


def document_id(tenant: Column, scope: Column, source_event_id: Column) -> Column:
    """Idempotency key of an event: sha256 of tenant:scope:source id."""
    return F.sha2(F.concat(tenant, F.lit(":"), scope, F.lit(":"), source_event_id), 256)


def render_number(x: Column) -> Column:
    """Whole numbers without a fraction, others in their shortest form."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(whole, x.cast("decimal(20,0)").cast("string")).otherwise(x.cast("string"))


def entity_key(parts: list[Column]) -> Column:
    """Folded parts joined by |; a missing part is an empty one (concat_ws would skip it)."""
    folded = [F.coalesce(fold(p.cast("string")), F.lit("")) for p in parts]
    out = [folded[0]]
    for p in folded[1:]:
        out += [F.lit("|"), p]
    return F.concat(*out)


def byte_prefix(text: Column, most: int) -> Column:
    """The longest prefix of whole characters within `most` UTF-8 bytes: a cut-off character's bytes go."""
    cut = F.substring(text.cast("binary"), 1, most)
    hexed = F.hex(cut)
    # A lead byte whose continuation is incomplete at the end of the cut.
    whole = F.regexp_replace(hexed, "(?:F[0-7](?:[89AB][0-9A-F]){0,2}|E[0-9A-F](?:[89AB][0-9A-F]){0,1}|[CD][0-9A-F])$", "")
    aligned = F.when(F.length(whole) % 2 == 0, whole).otherwise(hexed)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.unhex(aligned), "UTF-8"))


def clamp_payload(payload: Column, most: int = 65_536) -> Column:
    return F.substring(payload.cast("binary"), 1, most)


# Key names whose values are secret, and runs that look like encoded data.
SECRET_KEY = r"(?i)(token|secret|password|passwd|credential|cert_key|private_key|api_key|(^|[_\-.])key(s)?([_\-.]|$))"
BLOB, BLOB_MARK = r"[A-Za-z0-9+/=]{64,}|\b[0-9a-fA-F]{40,}\b", "[blob-removed]"
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
REDACTED, CUT = "[REDACTED]", "…[truncated]"
# What a model is never told of an event, and how many items of a list it is.
UNTOLD, MOST_ITEMS = ("raw", "unmapped", "batch_id", "tenant_id", "source"), 16


def redact_map(values: Column) -> Column:
    """A map of strings, with the values of secret keys hidden."""
    return F.transform_values(values, lambda k, v: F.when(k.rlike(SECRET_KEY), F.lit(REDACTED)).otherwise(v))


MAX_DEPTH = 20


def redact_json(document: Column) -> Column:
    """JSON text with whatever stands under a secret key hidden, at any depth, in compact form; null where the text is no
    JSON object. Below MAX_DEPTH levels all is hidden. Built-in functions cannot walk a value of unknown depth, so this is
    a vectorised UDF; it is meant for audit entries, which are few beside events."""
    secret, hidden, deepest = re.compile(SECRET_KEY), REDACTED, MAX_DEPTH

    def clean(value, depth):
        if depth > deepest:
            return hidden
        if isinstance(value, dict):
            return {k: hidden if secret.search(k) else clean(v, depth + 1) for k, v in value.items()}
        return [clean(v, depth + 1) for v in value] if isinstance(value, list) else value

    def one(text):
        try:
            value = json.loads(text)
        except (TypeError, ValueError, RecursionError):
            return None
        return json.dumps(clean(value, 0), separators=(",", ":")) if isinstance(value, dict) else None

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return F.pandas_udf(run, "string")(document)


def ulid(at: Column, seed: Column) -> Column:
    """26 characters that sort by time: 48 bits of milliseconds and 80 bits of a hash of the seed, in Crockford's base 32."""
    millis, digest = F.unix_millis(at.cast("timestamp")), F.sha2(seed.cast("string"), 256)
    digit = lambda n, k: F.substring(F.lit(CROCKFORD), F.shiftrightunsigned(n, 5 * k).bitwiseAND(31).cast("int") + 1, F.lit(1))
    half = lambda start: F.conv(F.substring(digest, start, 10), 16, 10).cast("bigint")
    return F.concat(*[digit(millis, k) for k in range(9, -1, -1)], *[digit(half(start), k) for start in (1, 11) for k in range(7, -1, -1)])


def scrub(text: Column, most: int = 512) -> Column:
    """Encoded blobs and control characters go; long text is cut with a mark."""
    clean = F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F\x7F]", " "), BLOB, BLOB_MARK)
    return F.when(F.char_length(clean) > most, F.concat(F.substring(clean, 1, most), F.lit(CUT))).otherwise(clean)


def like_literal(pattern: str) -> str:
    """A user's text as a LIKE pattern of its own, with backslash as escape."""
    return re.sub(r"([\\%_])", r"\\\1", pattern)


def semver(version: Column) -> Column:
    """(major, minor, patch) or null where it is none."""
    ok = version.rlike(r"^(0|[1-9][0-9]{0,8})\.(0|[1-9][0-9]{0,8})\.(0|[1-9][0-9]{0,8})$")
    part = lambda k: F.try_to_number(F.split_part(version, F.lit("."), F.lit(k)), F.lit("999999999")).cast("int")
    return F.when(ok, F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def trimmed(event: Column, kind: T.DataType, most: int = 512) -> Column:
    """A typed event for a model: without UNTOLD fields at any depth, lists and texts cut short. Null stays null."""
    if isinstance(kind, T.StructType):
        fields = [trimmed(event[f.name], f.dataType, most).alias(f.name) for f in kind.fields if f.name not in UNTOLD]
        return F.when(event.isNotNull(), F.struct(*fields)) if fields else F.lit(None).cast("string")
    if isinstance(kind, T.ArrayType):
        return F.transform(F.slice(event, 1, MOST_ITEMS), lambda x: trimmed(x, kind.elementType, most))
    if isinstance(kind, T.MapType):
        told = F.map_filter(event, lambda k, v: ~k.cast("string").isin(*UNTOLD))
        return F.transform_values(told, lambda k, v: trimmed(v, kind.valueType, most))
    if isinstance(kind, T.VariantType):
        return F.parse_json(trim_json(F.to_json(event), most))
    return scrub(event, most) if isinstance(kind, T.StringType) else event


def trim_json(document: Column, most: int = 512) -> Column:
    """The same for JSON text, whose depth no plan knows; null where it is no object."""
    # Control characters but tab and line feed, as scrub() takes them.
    control, blob = re.compile(r"[\x00-\x08\x0B-\x1F\x7F]"), re.compile(BLOB, re.ASCII)

    def trim(value):
        if isinstance(value, str):
            value = blob.sub(BLOB_MARK, control.sub(" ", value))
            return value[:most] + CUT if len(value) > most else value
        if isinstance(value, dict):
            return {k: trim(v) for k, v in value.items() if k not in UNTOLD}
        return [trim(v) for v in value[:MOST_ITEMS]] if isinstance(value, list) else value

    def one(text):
        try:
            value = json.loads(text)
            return json.dumps(trim(value), ensure_ascii=False, separators=(",", ":")) if isinstance(value, dict) else None
        except (TypeError, ValueError, RecursionError):
            return None

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return F.pandas_udf(run, "string")(document)
