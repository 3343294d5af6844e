"""URL filtering: fixed host and path rules first, then association rules over URL tokens.

FP-growth's conditional bases give the token combinations of labelled URLs that go with a label; rules below the least
support or confidence are dropped, and so is a rule that a shorter one with at least its confidence implies. An inverted
index holds each rule under the rarest of its tokens; a URL meets the rules of its tokens there and those are checked in
full. The surest rule wins (confidence, support, length, then block before allow); without one the default verdict holds.

A null URL, or one without ://, has empty host and path and gets the default. Equal URLs have equal verdicts; repeated
rows are judged each. Labelled URLs without a label are not mined. An empty table gives no rows; columns other than id
and url are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import materialize

#: (verdict, host, path): a rule fits its host and subdomains where the path starts with the rule's.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.6
#: More mined rules, or sets to grow, than this are joined by shuffle, not broadcast.
MOST_BROADCAST = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as host and path) and its verdict, or nulls."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [(F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.lit(h + p)), v) for v, h, p in longest]
    name = F.coalesce(*[f for f, _ in fits])
    verdict = F.coalesce(*[F.when(f.isNotNull(), F.lit(v)) for f, v in fits])
    return name, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, host labels, top-level domain, path parts, query keys and fragment; numbers count as one."""
    plain = lambda xs, kind: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(kind), F.regexp_replace(x, "[0-9]+", "0")))
    query = F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&")
    parts = F.concat(
        plain(F.array(F.regexp_extract(url, r"(?s)^(.*?)://", 1)), "scheme:"),
        plain(F.array(F.element_at(F.split(host, r"\."), -1)), "tld:"),
        plain(F.split(host, r"\."), "host:"),
        plain(F.split(path, "/"), "path:"),
        plain(F.transform(query, lambda q: F.substring_index(q, "=", 1)), "query:"),
        plain(F.array(F.regexp_extract(url, r"(?s)#(.*)$", 1)), "part:"),
    )
    return F.coalesce(F.array_distinct(parts), F.array().cast("array<string>"))


def mine(labelled: DataFrame, *, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """labelled(tokens, label) -> rules(tokens, label, confidence, support), counted over whole transactions.

    Conditional bases of all sets of one length grow together. A set grows only where a longer rule can be surer than all
    shorter ones: it has fewer transactions than each of its parts, and a label with the least support in some, not all,
    of them. All that is left out is implied by a shorter rule, so tokens that go together do not multiply sets."""
    total = labelled.count()
    none = labelled.sparkSession.range(0).select(F.array().cast("array<string>").alias("tokens"), F.lit("").alias("label"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support"))
    if not total:
        return none
    least = math.ceil(min_support * total)
    single = labelled.select(F.explode(F.array_distinct("tokens")).alias("t")).groupBy("t").count().filter(F.col("count") >= least)
    kept = {r["t"]: r["count"] for r in single.collect()}  # at most tokens-a-URL / min_support
    if not kept:
        return none
    order = F.array(*[F.lit(t) for t in sorted(kept, key=lambda t: (kept[t], t))])
    items = F.filter(F.transform(order, lambda t, k: F.when(F.array_contains("tokens", t), k)), lambda k: k.isNotNull())
    base = materialize(labelled.select(items.alias("items"), "label").groupBy("items", "label").agg(F.count("*").alias("w")), "url-sets")
    base = base.select(F.explode("items").alias("t"), "items", "label", "w").withColumn("set", F.array("t"))
    bound, found, length = None, none, 0
    while True:
        length += 1
        base = base.select("set", F.filter("items", lambda k: k > F.col("t")).alias("items"), "label", "w")
        base = materialize(base.groupBy("set", "items", "label").agg(F.sum("w").alias("w")), "url-bases")
        level = base.groupBy("set", "label").agg(F.sum("w").alias("w")).groupBy("set").agg(F.sum("w").alias("n"), F.collect_list(F.struct("label", "w")).alias("by"))
        if bound is not None:
            level = level.join(bound, "set").filter(F.col("n") < F.col("of_part")).drop("of_part")
        grows = F.exists("by", lambda x: x["label"].isNotNull() & (x["w"] >= least) & (x["w"] < F.col("n"))) & (F.col("n") < total)
        level = materialize(level.withColumn("grows", grows), "url-level")
        said = level.select("set", "n", F.explode("by").alias("x")).select("set", "x.label", (F.col("x.w") / F.col("n")).alias("confidence"), (F.col("x.w") / F.lit(total)).alias("support"), "x.w")
        said = said.filter(F.col("label").isNotNull() & (F.col("w") >= least) & (F.col("confidence") >= min_confidence))
        found = found.union(said.select(F.array_sort(F.transform("set", lambda k: F.get(order, k))), "label", "confidence", "support"))
        alive = level.filter("grows").select("set", "n")
        # A set grows by what its siblings end in, where all its parts grow too.
        last, stem = F.element_at("set", -1), F.slice("set", 1, length - 1)
        pairs = alive.select(stem.alias("stem"), "set").join(alive.select(stem.alias("stem"), last.alias("t")), "stem").filter(last < F.col("t"))
        longer = pairs.select(F.concat("set", F.array("t")).alias("longer"))
        part = longer.select("longer", F.explode("longer").alias("out")).select("longer", F.array_except("longer", F.array("out")).alias("set"))
        whole = part.join(alive, "set").groupBy("longer").agg(F.count("*").alias("parts"), F.min("n").alias("of_part")).filter(F.col("parts") == length + 1)
        bound = materialize(whole.select(F.col("longer").alias("set"), "of_part"), "url-longer")
        if bound.isEmpty():
            break
        ends = bound.groupBy(F.slice("set", 1, length).alias("set")).agg(F.collect_list(last).alias("ends"))
        if bound.count() <= MOST_BROADCAST:
            ends = F.broadcast(ends)
        base = base.join(ends, "set").withColumn("items", F.array_intersect("items", "ends"))
        base = base.withColumn("t", F.explode("items")).withColumn("set", F.concat("set", F.array("t")))
    found = materialize(found, "url-rules")
    # A longer rule says nothing new where a shorter one is as sure: the index keeps the shorter.
    part = found.select(F.explode("tokens").alias("out"), "tokens", "label", "confidence").select(F.array_except("tokens", F.array("out")).alias("tokens"), F.col("tokens").alias("longer"), "label", F.col("confidence").alias("of_longer"))
    implied = part.join(found, ["tokens", "label"]).filter(F.col("confidence") >= F.col("of_longer")).select(F.col("longer").alias("tokens"), "label").distinct()
    return materialize(found.join(implied, ["tokens", "label"], "left_anti"), "url-rules-pruned")


def index(rules: DataFrame) -> DataFrame:
    """rules by the token of each that is in the fewest rules."""
    each = rules.withColumn("token", F.explode("tokens"))
    count = each.groupBy("token").agg(F.count("*").alias("n"))
    rarest = each.join(count, "token").groupBy("tokens", "label").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    return rules.join(rarest, ["tokens", "label"])


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, labelled: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and the mined rule behind a verdict (mined, confidence).

    labelled(url, label): what the rules are mined from; by default the URLs that a fixed rule judges, with its verdict:
    mining then carries the fixed rules over to URLs that share tokens with what they judge.
    """
    url = F.col(url_col).cast("string")
    name, said = rule(F.col("host"), F.col("path"), rules)
    pages = pages.select(F.col(id_col).alias("page_id"), url.alias("url")).withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    pages = pages.withColumn("rule", name).withColumn("said", said)
    if labelled is None:
        labelled = pages.filter(F.col("rule").isNotNull()).select("url", "host", "path", F.col("said").alias("label"))
    else:
        labelled = labelled.filter(F.col("label").isNotNull()).withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    labelled = labelled.select(tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"), "label")
    mined = mine(labelled)
    by_token = materialize(index(mined), "url-index")
    if by_token.count() <= MOST_BROADCAST:
        by_token = F.broadcast(by_token)
    open_urls = pages.filter(F.col("rule").isNull() & F.col("url").isNotNull()).select("url", "host", "path").distinct()
    open_urls = open_urls.select("url", tokens(F.col("url"), F.col("host"), F.col("path")).alias("own"))
    met = open_urls.withColumn("token", F.explode("own")).join(by_token, "token").filter(F.size(F.array_except("tokens", "own")) == 0)
    best = F.max(F.struct("confidence", "support", F.size("tokens").alias("length"), (F.col("label") == "block").alias("blocks"), "label", "tokens"))
    best = met.groupBy("url").agg(best.alias("best"))
    out = pages.join(best, "url", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", "best.label", F.lit(default)).alias("verdict"), F.col("best.tokens").alias("mined"), "best.confidence")
