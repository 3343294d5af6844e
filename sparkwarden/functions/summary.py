"""Checks of a triage summary, and strict reading of a model's answer."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from itertools import groupby
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_WORDS = 120
# The labels of the lines, what a summary must not hold, and the texts of the errors.
LABELS = ("What happened: ", "Why it matters: ", "Do this next: ")
FORMAT_DENIED = ("`", "**", "# ", "](", "http://", "https://", "!")
STRUCTURE_ERROR, LINE_ERROR = "structure: expected exactly 3 lines, got ", "structure: line does not match '^{}\\S'"
ENTITY_ERROR = ("entity: {}-like token '", "' not in alert.entity")
JARGON = {
    "lateral movement": r"\blateral movement\b",
    "C2 / command and control": r"\bc2\b|\bcommand[ -]and[ -]control\b",
    "beaconing / callback": r"\bbeacon(ing|s)?\b|\bcallback(s)?\b",
    "exfiltration": r"\bexfiltrat\w*\b",
    "persistence": r"\bpersistence\b",
    "privilege escalation": r"\bprivilege escalation\b",
    "credential dumping/access": r"\bcredential (dump\w*|access)\b",
    "brute force": r"\bbrute[ -]force\w*\b",
    "payload/dropper/implant/RAT": r"\bpayload(s)?\b|\bdropper(s)?\b|\bimplant(s)?\b|\brats?\b",
    "reverse shell / shell access": r"\breverse shell\b|\bshell access\b",
    "obfuscated/encoded": r"\bobfuscat\w*\b|\bencoded\b",
    "process injection": r"\bprocess injection\b",
    "living off the land / LOLBin": r"\bliving off the land\b|\blolbins?\b",
    "enumeration/recon/discovery": r"\benumerat\w*\b|\brecon\b|\bdiscovery\b",
    "IOC / indicator": r"\biocs?\b|\bindicator(s)?\b",
    "threat actor/adversary/TTP": r"\bthreat actor(s)?\b|\badversar(y|ies)\b|\bttps?\b",
    "endpoint/host as nouns": r"\bendpoint(s)?\b|\bhost(s)?\b",
    "compromised": r"\bcompromised\b",
    "mitigate/remediate": r"\bmitigat\w*\b|\bremediat\w*\b",
    "exploit (verb)": r"\bexploit\w*\b",
    "zero-day / CVE": r"\bzero[ -]day(s)?\b|\bcve-\d+",
}
HOST_LIKE = r"\b(?=[a-z0-9-]*\d)[a-z][a-z0-9]*(?:-[a-z0-9]+)+\b"
USER_LIKE = r"\b[a-z][a-z0-9_-]*\.[a-z][a-z0-9._-]*[a-z0-9]\b"
BLOB_LIKE = r"[A-Za-z0-9+/=]{40,}|\b[0-9a-fA-F]{32,}\b"
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE00}-\x{FE0F}]"


def stems(pattern: str) -> list[str]:
    """Beginnings of words of which each match of a JARGON pattern holds one: what stands after each \\b up to what may be
    lacking or differ, or to the word's end."""
    return re.findall(r"\\b([a-z0-9]+?)(?=.[?*]|[^a-z0-9]|$)", pattern)


_STEMS = {name: stems(p) for name, p in JARGON.items()}
#: Of stems that begin alike the shortest, so that a word is found by one of them only.
_SHORT = {x: min((y for own in _STEMS.values() for y in own if x.startswith(y)), key=len) for own in _STEMS.values() for x in own}
_BY_LETTER = "|".join(f"{c}(?:{'|'.join(x[1:] for x in own)})" for c, own in groupby(sorted(set(_SHORT.values())), key=lambda x: x[0]))
#: The first letters are looked at by themselves: few words begin with a stem.
STEM = rf"\W(?=[{''.join(sorted({x[0] for x in _SHORT}))}])({_BY_LETTER})"


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), whose value is worked out once however often f uses it: it is bound in a lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def summary_errors(summary: Column, hostname: Column, user: Column) -> Column:
    """Array of what is wrong with a summary; empty for a good one. A pattern is tried only where something stands
    without which it has no match, and which costs less to find: most summaries are good."""
    long = F.char_length(summary) > 2 * MAX_WORDS  # so many words and what parts them
    checks = [F.when(long & (F.regexp_count(summary, F.lit(r"\S+")) > MAX_WORDS), F.lit(f"length: over {MAX_WORDS} words"))]
    checks += [F.when(summary.contains(x), F.lit(f"format: banned sequence '{x}'")) for x in FORMAT_DENIED]
    plain = F.octet_length(summary) == F.char_length(summary)
    checks.append(F.when(~plain & summary.rlike(EMOJI), F.lit("format: emoji codepoint")))
    small = F.concat(F.lit(" "), F.lower(summary))
    unglossed = F.filter(F.split(summary, "[.?]"), lambda s: s.rlike(r"(?i)\bphishing\b") & ~s.rlike(r"(?i)\btrick"))
    long_word = F.exists(F.split(summary, " "), lambda w: F.char_length(w) >= 32)
    blob = F.when(long_word & summary.rlike(BLOB_LIKE), F.lit("content: encoded blob or hash reproduced"))
    allowed = F.filter(F.array(hostname, user), lambda v: v.isNotNull() & (v != ""))
    none = F.array().cast("array<string>")

    def structure(lines: Column) -> Column:
        bad = [(F.size(lines) == 3) & ~F.get(lines, F.lit(k)).rlike(rf"^{label}\S") for k, label in enumerate(LABELS)]
        of_lines = [F.when(b, F.lit(LINE_ERROR.format(label))) for b, label in zip(bad, LABELS)]
        return given([F.when(F.size(lines) != 3, F.concat(F.lit(STRUCTURE_ERROR), F.size(lines).cast("string"))), *of_lines])

    def jargon(found: Column) -> Column:
        told = {name: reduce(or_, [F.array_contains(found, _SHORT[x]) for x in own]) & summary.rlike(f"(?i){JARGON[name]}") for name, own in _STEMS.items()}
        return where(F.size(found) > 0, given([F.when(t, F.lit(f"jargon: banned term ({name})")) for name, t in told.items()]))

    def invented(pattern: str, what: str) -> Column:
        found = F.filter(F.regexp_extract_all(summary, F.lit(pattern), F.lit(0)), lambda t: ~F.array_contains(allowed, t))
        return F.transform(found, lambda t: F.concat(F.lit(ENTITY_ERROR[0].format(what)), t, F.lit(ENTITY_ERROR[1])))

    given = lambda checks: F.filter(F.array(*checks), lambda c: c.isNotNull())
    where = lambda held, errors: F.when(held.isNull() | held, errors).otherwise(none)
    phishing = where(small.contains("phishing"), F.transform(unglossed, lambda s: F.lit("jargon: 'phishing' without the required gloss")))
    host, account = where(summary.contains("-"), invented(HOST_LIKE, "hostname")), where(summary.rlike(r"\.[a-z]"), invented(USER_LIKE, "account"))
    return F.concat(once(F.split(summary, "\n"), structure), given(checks), once(F.regexp_extract_all(small, F.lit(STEM), F.lit(1)), jargon), phishing, host, account, given([blob]))


def read_answer(answer: Column) -> Column:
    """(summary, ai_severity) of a model's answer: a fence goes, the outermost braces hold JSON with both; else null."""
    bare = F.when(answer.contains("```"), F.regexp_replace(F.trim(answer), r"(?s)^```[a-zA-Z]*\n?|```$", "")).otherwise(answer)
    body = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    parsed = F.from_json(body, "summary string, ai_severity string")

    def checked(p: Column) -> Column:
        good = (F.length(F.trim(p["summary"])) > 0) & F.lower(p["ai_severity"]).isin("low", "medium", "high", "critical")
        return F.when(good, F.struct(p["summary"].alias("summary"), F.lower(p["ai_severity"]).alias("ai_severity")))

    return once(parsed, checked)


def fake_summary(hostname: Column, user: Column, count: Column, at: Column) -> Column:
    """The text of the deterministic scorer that stands in for a model."""
    who = F.coalesce(user, F.lit("an account"))
    where = F.coalesce(hostname, F.lit("a computer"))
    return F.concat(
        F.lit("What happened: "), who, F.lit(" did something unusual on "), where, F.lit(", seen "), count.cast("string"), F.lit(" times by "), F.date_format(at, "HH:mm"), F.lit(".\n"),
        F.lit("Why it matters: Someone may be using this computer without permission.\n"), F.lit("Do this next: Ask the person who uses it whether they did this."),
    )


def tokens_estimate(text: Column) -> Column:
    return F.floor(F.char_length(text) / 4).cast("int")


def parse_lines(summary: Column) -> Column:
    """The three parts of a well-formed summary, else null."""
    lines = F.split(summary, "\n")
    part = lambda k: F.substring(F.get(lines, F.lit(k)), len(LABELS[k]) + 1, 100_000)
    good = (F.size(lines) == 3) & F.forall(F.array(*[F.get(lines, F.lit(k)).startswith(x) for k, x in enumerate(LABELS)]), lambda x: x)
    return F.when(good, F.struct(part(0).alias("happened"), part(1).alias("matters"), part(2).alias("next")))


def priority_band(score: Column) -> Column:
    return F.when(score >= 85, "critical").when(score >= 65, "high").when(score >= 40, "medium").otherwise("low")
