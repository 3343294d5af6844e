"""Order-dependent admission against plain loops."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sparkwarden.operators import usage

T0 = datetime(2026, 7, 8)


def requests(n=400):
    rng, at, rows = random.Random(9), T0, []
    for k in range(n):
        at += timedelta(seconds=rng.choice([0, 0, 1, 3, 20, 90]))
        rows.append((rng.choice("ab"), at, k, rng.randrange(0, 6)))
    return rows


def test_sliding_rate(spark):
    rows, got_sum = requests(), {}
    df = spark.createDataFrame(rows, "tenant string, at timestamp, id long, n long")
    got = {r.id: r.admitted for r in usage.admit_by_rate(df, "tenant", "at", "id", F.col("n"), 10).collect()}
    for tenant in "ab":
        taken = []
        for t, at, k, n in rows:
            if t != tenant:
                continue
            b = int((at - datetime(1970, 1, 1)).total_seconds()) // 6
            used = sum(m for c, m in taken if c > b - 10)
            got_sum[k] = used + n <= 10
            if got_sum[k]:
                taken.append((b, n))
    assert got == got_sum and len(set(got.values())) == 2


def test_fixed_window(spark):
    rows, want, state = requests(), {}, {}
    df = spark.createDataFrame(rows, "tenant string, at timestamp, id long, n long")
    got = {r.id: r.admitted for r in usage.admit_by_fixed_window(df, "tenant", "at", "id", 3).collect()}
    for t, at, k, _ in rows:
        start, n = state.get(t, (None, 0))
        if start is None or at >= start + timedelta(seconds=60):
            start, n = at, 0
        state[t] = (start, n + 1)
        want[k] = n < 3
    assert got == want


def test_admission_over_busy_and_idle_times(spark):
    """Calm and contested times in turn, with null keys and times, at several limits: as plain loops tell."""
    rng, at, rows = random.Random(4), T0, []
    for k in range(1500):
        at += timedelta(seconds=rng.choice([0, 1, 2]) if (k // 100) % 2 else rng.choice([2, 9, 25, 58, 60, 61, 130]))
        rows.append((rng.choice(["a", "a", "b", None]), at if k % 50 else None, k, rng.randrange(0, 6) if k % 7 else None))
    df = spark.createDataFrame(rows, "tenant string, at timestamp, id long, n long")
    for limit in (4, 12, 40):
        by_rate = {r.id: r.admitted for r in usage.admit_by_rate(df, "tenant", "at", "id", F.col("n"), limit).collect()}
        by_window = {r.id: r.admitted for r in usage.admit_by_fixed_window(df, "tenant", "at", "id", limit).collect()}
        want_rate, want_window = {}, {}
        for tenant in ("a", "b", None):
            taken, start, asked = [], None, 0
            for t, when, k, n in rows:
                if t != tenant:
                    continue
                if when is None:
                    want_rate[k] = want_window[k] = False
                    continue
                second = int((when - datetime(1970, 1, 1)).total_seconds())
                b = second // 6
                want_rate[k] = sum(m for c, m in taken if c > b - 10) + (n or 0) <= limit
                if want_rate[k]:
                    taken.append((b, n or 0))
                if start is None or second >= start + 60:
                    start, asked = second, 0
                asked += 1
                want_window[k] = asked <= limit
        assert by_rate == want_rate and len(set(by_rate.values())) == 2
        assert by_window == want_window


def test_costs_quotas_and_shedding(spark):
    calls = spark.createDataFrame([("big-model-2", 1_000_000, 0), ("big", 1, 1), ("other", 1_000_000, 1_000_000), ("big-x", 3, 0)], "model_id string, tokens_in long, tokens_out long")
    prices = spark.createDataFrame([("big", "1.00", "2.00"), ("big-model", "4.00", "8.00")], "prefix string, rate_in string, rate_out string")
    assert {r.model_id: float(r.cost_usd) for r in usage.with_cost(calls, prices).collect()} == {"big-model-2": 4.0, "big": 0.000003, "other": 18.0, "big-x": 0.000003}
    q = spark.createDataFrame([("t", T0 + timedelta(hours=h), h) for h in range(4)], "tenant string, at timestamp, id long")
    assert [r.admitted for r in usage.admit_by_quota(q, ["tenant"], "at", "id", F.lit(2)).orderBy("id").collect()] == [True, True, False, False]
    assert all(r.admitted for r in usage.admit_by_quota(q, ["tenant"], "at", "id", F.lit(-1)).collect())
    kept = usage.shed(spark.createDataFrame([("d", c, str(k // 4), k, 10) for k, c in enumerate(["network", "process", "auth", "network", "auth", "process", "process"])], "d string, class string, segment string, seq long, bytes long"), ["d"], 45)
    assert sorted(r.seq for r in kept.collect()) == [2, 4, 5, 6]  # the older process segment goes with both network rows


def test_failing_rules_slide_and_are_told_once(spark):
    rng = random.Random(9)
    rows = [(f"r{rng.randrange(3)}", f"t{rng.randrange(6)}", rng.random() < 0.06, T0 + timedelta(seconds=rng.randrange(2000)), k) for k in range(3000)]
    rows += [("exact", f"t{k % 7}", k % 20 == 19, T0 + timedelta(seconds=k), 10_000 + k) for k in range(240)]
    df = spark.createDataFrame(rows, "rule_id string, tenant_id string, error boolean, at timestamp, id long")
    got = {r.rule_id: (r.samples, round(r.error_fraction, 6), r.tenants_affected) for r in usage.failing_rules(df, tenants=2, least=100).collect()}
    expected = {}
    for rule in ("r0", "r1", "r2", "exact"):
        seen = []
        for r in sorted((r for r in rows if r[0] == rule), key=lambda r: (r[3], r[4])):
            now = (r[3] - T0).total_seconds()  # T0 starts a bucket
            seen.append((now // 30 * 30, r[2], r[1]))
            live = [s for s in seen if s[0] >= now - 300]
            bad = [s for s in live if s[1]]
            if r[2] and rule not in expected and len(live) >= 100 and len(bad) >= 0.05 * len(live) and len({s[2] for s in bad}) >= 2:
                expected[rule] = (len(live), round(len(bad) / len(live), 6), len({s[2] for s in bad}))
    assert got == expected and len(expected) >= 3 and expected["exact"][:2] == (100, 0.05)
