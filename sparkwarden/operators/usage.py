"""Counters: sliding rates, daily usage, quotas, budgets, failure fractions, load shedding."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.session import ship_package

BUCKET_SECONDS, BUCKETS = 6, 10


def bucket(at: Column, seconds: int = BUCKET_SECONDS) -> Column:
    return F.floor(F.unix_timestamp(at.cast("timestamp")) / seconds).cast("long")


def rate_buckets(rows: DataFrame, keys: list[str], at: str, amount: Column) -> DataFrame:
    """Units of each key in each bucket, and the sum of the last BUCKETS buckets: the rate of 60 seconds."""
    sums = rows.groupBy(*keys, bucket(F.col(at)).alias("bucket")).agg(F.sum(amount).alias("units"))
    frame = Window.partitionBy(*keys).orderBy("bucket").rangeBetween(-(BUCKETS - 1), 0)
    return sums.withColumn("rate", F.sum("units").over(frame))


def sliding_sum(rows: DataFrame, keys: list[str], at: str, amount: Column, seconds: int = 60) -> DataFrame:
    """rows with the units of the last `seconds` seconds up to each."""
    stamp = F.unix_timestamp(F.col(at).cast("timestamp"))
    return rows.withColumn("rate", F.sum(amount).over(Window.partitionBy(*keys).orderBy(stamp).rangeBetween(-(seconds - 1), 0)))


def daily_usage(rows: DataFrame, keys: list[str], at: str, metric: Column, amount: Column) -> DataFrame:
    return rows.groupBy(*keys, F.to_date(at).alias("day"), metric.alias("metric")).agg(F.sum(amount).alias("value"))


def usage_2d(usage: DataFrame, today) -> DataFrame:
    """Today and yesterday by the calendar."""
    day = F.lit(today).cast("date")
    return usage.filter(F.col("day").between(F.date_sub(day, 1), day)).groupBy("tenant_id", "metric").agg(F.sum("value").alias("value"))


def admit_by_quota(requests: DataFrame, keys: list[str], at: str, order: str, limit: Column) -> DataFrame:
    """requests with `admitted`: the first `limit` of each key and day; -1 is without limit."""
    n = F.row_number().over(Window.partitionBy(*keys, F.to_date(at)).orderBy(at, order))
    return requests.withColumn("admitted", (limit < 0) | (n <= limit))


def running_budget(calls: DataFrame, keys: list[str], at: str, order: str, tokens: Column, cap: int, day: str | None = None) -> DataFrame:
    """calls with what their day had spent before them, and whether that leaves room. `day`: a column of calls that holds
    the date of `at`, by which rows that are dealt and sorted already stay so."""
    before = Window.partitionBy(*keys, F.to_date(at) if day is None else day).orderBy(at, order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(tokens).over(before), F.lit(0))
    return calls.withColumn("spent_before", spent).withColumn("allowed", spent < cap)


def failing_rules(evaluations: DataFrame, at: str = "at", order: str = "id", *, fraction: float = 0.05, tenants: int = 3, least: int = 200, seconds: int = 300, buckets: int = 10) -> DataFrame:
    """Rules to switch off: each once, at the first failure (rule_id, tenant_id, error, at, id) at which the last `seconds`
    had `least` evaluations or more, `fraction` of them or more failed, and for `tenants` tenants or more.

    The window slides by buckets: those that started within it count, the current one up to the failure. Sums of whole
    buckets come from one row for each, so only rows of one bucket are ordered by time. A tenant counts from a failure
    until the window has passed its last one, so tenants are a running sum of such beginnings and ends; nothing holds a
    set of them. Failures without a tenant count as failures only."""
    width = seconds // buckets * 1_000_000
    rows = evaluations.select("rule_id", "tenant_id", F.coalesce("error", F.lit(False)).alias("error"), F.col(at).alias("_at"), F.col(order).alias("_id"), F.unix_micros(F.col(at).cast("timestamp")).alias("_t"))
    rows = rows.withColumn("_bucket", F.floor(F.col("_t") / width))
    by_tenant = Window.partitionBy("rule_id", "tenant_id").orderBy("_t", "_id")
    until = (F.col("_bucket") + buckets) * width  # the last moment at which a failure counts
    failed = rows.filter("error").withColumn("_until", until).withColumns({"_before": F.lag("_until").over(by_tenant), "_after": F.lead("_t").over(by_tenant)})
    named = F.col("tenant_id").isNotNull()
    begins = (named & (F.col("_before").isNull() | (F.col("_t") > F.col("_before")))).cast("int")
    ends = failed.filter(named & (F.col("_after").isNull() | (F.col("_after") > F.col("_until"))))
    log = rows.filter("not error").withColumns({"_one": F.lit(1), "_tenants": F.lit(0)})
    log = log.unionByName(failed.withColumns({"_one": F.lit(1), "_tenants": begins}).drop("_until", "_before", "_after"))
    log = log.unionByName(ends.select("rule_id", F.lit(False).alias("error"), F.col("_until").alias("_t"), (F.col("_bucket") + buckets).alias("_bucket"), F.lit(0).alias("_one"), F.lit(-1).alias("_tenants")), allowMissingColumns=True)
    whole = log.groupBy("rule_id", "_bucket").agg(F.sum("_one").alias("_n"), F.sum(F.col("error").cast("int")).alias("_e"), F.sum("_tenants").alias("_d"))
    of_rule = Window.partitionBy("rule_id").orderBy("_bucket")
    for k in (buckets - 1, buckets):  # at the start of a bucket, the one that started `seconds` before still counts
        back = of_rule.rangeBetween(-k, -1)
        whole = whole.withColumns({f"_n{k}": F.coalesce(F.sum("_n").over(back), F.lit(0)), f"_e{k}": F.coalesce(F.sum("_e").over(back), F.lit(0))})
    whole = whole.withColumn("_known", F.coalesce(F.sum("_d").over(of_rule.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n", "_e", "_d")
    # Rows of a moment come before the ends of that moment, as these still count at it.
    within = Window.partitionBy("rule_id", "_bucket").orderBy("_t", F.desc("_one"), "_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = log.withColumns({"_own": F.sum("_one").over(within), "_own_e": F.sum(F.col("error").cast("int")).over(within), "_own_d": F.sum("_tenants").over(within)}).filter("error")
    seen = seen.join(whole, ["rule_id", "_bucket"])
    pick = lambda c: F.when(F.col("_t") % width == 0, F.col(f"_{c}{buckets}")).otherwise(F.col(f"_{c}{buckets - 1}"))
    seen = seen.withColumns({"samples": F.col("_own") + pick("n"), "_errors": F.col("_own_e") + pick("e"), "tenants_affected": (F.col("_known") + F.col("_own_d")).cast("int")})
    over = (F.col("samples") >= least) & (F.col("_errors") >= fraction * F.col("samples")) & (F.col("tenants_affected") >= tenants)
    first = F.min_by(F.struct(F.col("_at").alias("at"), "samples", F.round(F.col("_errors") / F.col("samples"), 6).alias("error_fraction"), "tenants_affected"), F.struct("_t", "_id"))
    return seen.filter(over).groupBy("rule_id").agg(first.alias("_d")).select("rule_id", "_d.*")


def pipeline_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tenant_id", "stage", "outcome").agg(F.count("*").alias("n"), F.percentile_approx("seconds", [0.5, 0.95]).alias("seconds"))


def drop_deltas(reports: DataFrame) -> DataFrame:
    """Drops since the device's last report; a counter that fell was started anew."""
    before = F.lag("dropped").over(Window.partitionBy("device_id", "class").orderBy("at", "dropped"))
    return reports.withColumn("delta", F.when(before.isNull() | (F.col("dropped") < before), F.col("dropped")).otherwise(F.col("dropped") - before))


# What is shed first when a buffer is full.
SHED_FIRST = ("network", "process", "auth")


def shed(buffered: DataFrame, keys: list[str], cap_bytes: int) -> DataFrame:
    """What stays of a full buffer of (class, segment, seq, bytes): whole segments go, the oldest of the class that is shed
    first, until the rest fits. Segments, not rows, are ordered."""
    rank = F.coalesce(*[F.when(F.col("class") == c, F.lit(k)) for k, c in enumerate(SHED_FIRST)], F.lit(len(SHED_FIRST)))
    segments = buffered.groupBy(*keys, "class", "segment").agg(F.sum("bytes").alias("_bytes"), F.max("seq").alias("_last"))
    by = Window.partitionBy(*keys).orderBy(rank.desc(), F.desc("_last"), "class", "segment").rowsBetween(Window.unboundedPreceding, 0)
    kept = segments.withColumn("_upto", F.sum("_bytes").over(by)).filter(F.col("_upto") <= cap_bytes).select(*keys, "class", "segment")
    return buffered.join(kept, [*keys, "class", "segment"], "left_semi")


def merged_in_order(*queues: DataFrame) -> DataFrame:
    """The queues' rows in the global order of seq."""
    out = queues[0]
    for q in queues[1:]:
        out = out.unionByName(q)
    return out.orderBy("seq")


def metering_daily(calls: DataFrame) -> DataFrame:
    """Calls, tokens, cost and the 95th percentile of latency by day and model."""
    return calls.groupBy(F.to_date("created_at").alias("day"), "model_id").agg(
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.count("*").alias("calls"), F.sum("cost_usd").alias("cost_usd"),
        F.expr("percentile_cont(0.95) within group (order by latency_ms)").alias("p95_latency_ms"),
    )


def metering_range(calls: DataFrame, tenant_id: str, start, end) -> DataFrame:
    """metering_daily() of a tenant's calls from start to end, both included."""
    return metering_daily(calls.filter((F.col("tenant_id") == tenant_id) & F.col("created_at").between(F.lit(start), F.lit(end)))).orderBy("day", "model_id")


def with_cost(calls: DataFrame, prices: DataFrame, fallback: tuple[str, str] = ("3.00", "15.00")) -> DataFrame:
    """calls with cost_usd by the longest prefix of prices(prefix, rate_in, rate_out: dollars a million tokens) that fits.

    A price list is small; it is checked before it is broadcast. Models are few, so prefixes are matched to them, not to calls.
    """
    if prices.limit(10_001).count() > 10_000:
        raise ValueError("more than 10,000 prices")
    models = calls.select("model_id").distinct()
    fits = models.join(F.broadcast(prices), models["model_id"].startswith(prices["prefix"]))
    best = fits.groupBy("model_id").agg(F.max_by(F.struct("rate_in", "rate_out"), F.length("prefix")).alias("_rate"))
    rows = calls.join(best, "model_id", "left")
    dec = lambda c: c.cast("decimal(18,6)")
    total = F.col("tokens_in") * F.coalesce(dec(F.col("_rate.rate_in")), dec(F.lit(fallback[0]))) + F.col("tokens_out") * F.coalesce(dec(F.col("_rate.rate_out")), dec(F.lit(fallback[1])))
    return rows.withColumn("cost_usd", F.bround(total / 1_000_000, 6).cast("decimal(12,6)")).drop("_rate")


def admit_by_capacity(enrolments: DataFrame, seats: DataFrame) -> DataFrame:
    """enrolments(tenant_id, at, id) with `admitted`: as many in order as seats(tenant_id, cap, used) has left."""
    n = F.row_number().over(Window.partitionBy("tenant_id").orderBy("at", "id"))
    rows = enrolments.withColumn("_n", n).join(seats, "tenant_id", "left")
    return rows.withColumn("admitted", F.coalesce(F.col("_n") + F.col("used") <= F.col("cap"), F.lit(False))).drop("_n", "cap", "used")


def _in_order(rows: DataFrame, keys: list[str], order: list[str], make, taken: list[str], out: str, kind: str) -> DataFrame:
    """rows with `out`, told by a fresh make() for each group of keys from its columns `taken`, asked in order. Batches of
    a group follow each other, so only one state is held."""
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            said = []
            groups = zip(*[batch[k].astype(object).where(batch[k].notna(), None) for k in keys])
            for group, args in zip(groups, zip(*[batch[c] for c in taken])):
                if state is None or group != now:
                    now, state = group, make()
                said.append(state(*args))
            yield batch.assign(**{out: said})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, f"{fields}, `{out}` {kind}")


def _meet(rows: DataFrame, known: DataFrame, key: str, at: str) -> DataFrame:
    """rows with what known(key, at, ...) tells of their key and time; null keys meet, null times do not."""
    other = known.withColumnsRenamed({key: "_key", at: "_at"})
    return rows.join(other, F.col(key).eqNullSafe(F.col("_key")) & (F.col(at) == F.col("_at")), "left").drop("_key", "_at")


def admit_by_rate(batches: DataFrame, key: str, at: str, order: str, amount: Column, limit: int) -> DataFrame:
    """batches with `admitted`: a whole batch is refused if it would bring its key over the limit of the last BUCKETS
    buckets; refused batches take nothing, so each answer depends on those before it. Amounts are not negative, null is 0;
    a batch without time is refused.

    Where all that was offered in a bucket and the BUCKETS - 1 before it fits the limit, everything is admitted whatever
    came before. So only contested buckets are answered in order, each stretch of them apart, after the buckets that
    still count at its start; sums of buckets, not batches, tell which these are."""
    class Sliding:
        def __init__(self):
            self.held, self.total = deque(), 0

        def __call__(self, b: int, n: int) -> bool:
            while self.held and self.held[0][0] <= b - BUCKETS:
                self.total -= self.held.popleft()[1]
            if self.total + n > limit:
                return False
            self.held.append((b, n))
            self.total += n
            return True

    rows = batches.withColumns({"_bucket": bucket(F.col(at)), "_amount": F.coalesce(amount, F.lit(0))})
    by = Window.partitionBy(key).orderBy("_bucket")
    sums = rows.filter("_bucket is not null").groupBy(key, "_bucket").agg(F.sum("_amount").alias("_units"))
    sums = sums.withColumn("_contested", F.sum("_units").over(by.rangeBetween(-(BUCKETS - 1), 0)) > limit)
    sums = sums.withColumn("_next", F.min(F.when(F.col("_contested"), F.col("_bucket"))).over(by.rangeBetween(0, BUCKETS - 1)))
    before = F.last(F.when(F.col("_next").isNotNull(), F.col("_bucket")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.col("_next").isNotNull() & F.coalesce(F.col("_next") - (BUCKETS - 1) > before, F.lit(True))
    sums = sums.withColumn("_starts", starts)
    stretch = F.last(F.when(F.col("_starts"), F.col("_bucket")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    known = sums.select(key, "_bucket", F.when(F.col("_next").isNotNull(), stretch).alias("_stretch"))
    met = _meet(rows, known, key, "_bucket")
    free = met.filter("_stretch is null").withColumn("admitted", F.col("_bucket").isNotNull())
    told = _in_order(met.filter("_stretch is not null"), [key, "_stretch"], [at, order], Sliding, ["_bucket", "_amount"], "admitted", "boolean")
    return free.unionByName(told).drop("_bucket", "_amount", "_stretch")


def admit_by_fixed_window(requests: DataFrame, key: str, at: str, order: str, limit: int, seconds: int = 60) -> DataFrame:
    """requests with `admitted`: at most `limit` in a window that starts with the first request after the last window;
    a request without time is refused.

    Windows start at whole seconds, so they are found from a key's distinct seconds, in stretches without a pause that
    ends any window; the requests of each window are then counted apart from those of others."""
    class Fixed:
        def __init__(self):
            self.start = None

        def __call__(self, second: int) -> int:
            if self.start is None or second >= self.start + seconds:
                self.start = second
            return self.start

    rows = requests.withColumn("_second", F.unix_timestamp(F.col(at).cast("timestamp")))
    by = Window.partitionBy(key).orderBy("_second")
    asked = rows.filter("_second is not null").select(key, "_second").distinct()
    pause = F.coalesce(F.col("_second") - F.lag("_second").over(by) >= seconds, F.lit(True))
    asked = asked.withColumn("_pause", pause)
    asked = asked.withColumn("_stretch", F.last(F.when(F.col("_pause"), F.col("_second")), ignorenulls=True).over(by)).drop("_pause")
    starts = _in_order(asked, [key, "_stretch"], ["_second"], Fixed, ["_second"], "_start", "bigint").drop("_stretch")
    met = _meet(rows, starts, key, "_second").withColumn("_spread", F.when(F.col("_start").isNull(), F.xxhash64(order)))
    n = F.row_number().over(Window.partitionBy(key, "_start", "_spread").orderBy(at, order))
    return met.withColumn("admitted", n <= limit).withColumn("admitted", F.col("admitted") & F.col("_start").isNotNull()).drop("_second", "_start", "_spread")


def backoff_seconds(attempt: Column, jitter: Column, base: float = 1.0, most: float = 300.0) -> Column:
    """Waiting time before a retry: doubled with each attempt up to a bound, times a jitter from 0.5 to 1.5."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), F.least(attempt, F.lit(30)))) * (0.5 + jitter)
