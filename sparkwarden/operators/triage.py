"""Triage of alerts: context, a scorer's answer, checks, one more try, budget, and the score made anew.

The scorer is a function of columns to a column (the deterministic one below), or a pandas UDF that asks a model; it is
applied to a batch of alerts, in `foreachBatch` of a stream as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions.summary import fake_summary, read_answer, summary_errors, tokens_estimate
from sparkwarden.operators.alerts import rescore
from sparkwarden.operators.queue import with_context
from sparkwarden.operators.usage import running_budget

DAILY_TOKENS = 2_000_000
UNREADABLE = "output: no JSON object with summary and ai_severity"
#: (context, alert's columns) -> the answer's text.
Scorer = Callable[[Column], Column]


def deterministic(context: Column) -> Column:
    """A fixed answer from the alert alone: its own severity and a plain summary."""
    text = fake_summary(F.col("entity_hostname"), F.col("entity_user"), F.col("occurrence_count"), F.col("last_seen"))
    return F.to_json(F.struct(text.alias("summary"), F.col("severity").alias("ai_severity")))


def triage(alerts: DataFrame, links: DataFrame, events: DataFrame, scorer: Scorer = deterministic, again: Scorer | None = None, *, daily_tokens: int = DAILY_TOKENS) -> DataFrame:
    """alerts with summary, ai_severity, tokens_in, tokens_out and outcome: ok, invalid (both tries failed the checks) or
    over_budget (the tenant's day had spent its tokens before). `again` is asked where the first answer fails; by default
    the same. Its context says, as `correction`, what was wrong with the first answer. A scorer gets a null context where
    it is not to answer, and costs nothing there.

    Each try costs the tokens that go in and come out; skipped alerts cost nothing. Spending only grows, so the alerts
    that are let through are the first ones of a day, up to the one that used the budget up. Alerts whose predecessors'
    contexts alone are over it are not asked at all."""
    rows = with_context(alerts, links, events).withColumns({"_in": tokens_estimate(F.col("context")), "_day": F.to_date("last_seen")})
    # Both budgets go by this day: what is dealt and sorted for the first stays so for the second.
    rows = running_budget(rows, ["tenant_id"], "last_seen", "alert_id", F.col("_in"), daily_tokens, "_day").withColumnRenamed("allowed", "_asked").drop("spent_before")

    def attempt(df: DataFrame, ask: Scorer, name: str, asked: Column, given: Column) -> DataFrame:
        read = df.withColumn("_own", F.col("context")).withColumn("context", F.when(asked, given)).withColumn(f"_text_{name}", ask(F.col("context")))
        read = read.withColumn(f"_text_{name}", F.when(F.col("context").isNotNull(), F.col(f"_text_{name}"))).withColumn(f"_in_{name}", F.coalesce(tokens_estimate(F.col("context")), F.lit(0)))
        read = read.withColumn("context", F.col("_own")).drop("_own").withColumn(f"_answer_{name}", read_answer(F.col(f"_text_{name}")))
        errors = summary_errors(F.col(f"_answer_{name}.summary"), F.col("entity_hostname"), F.col("entity_user"))
        return read.withColumn(f"_errors_{name}", F.when(F.col(f"_answer_{name}").isNull(), F.array(F.lit(UNREADABLE))).otherwise(errors)).withColumn(f"_good_{name}", F.size(f"_errors_{name}") == 0)

    rows = attempt(rows, scorer, "first", F.col("_asked"), F.col("context"))
    correction = F.to_json(F.struct(F.concat_ws("; ", "_errors_first").alias("correction")))
    corrected = F.concat(F.expr("left(context, length(context) - 1)"), F.lit(","), F.substring(correction, 2, 1_000_000))
    rows = attempt(rows, again or scorer, "second", F.col("_asked") & ~F.col("_good_first"), corrected)
    out = F.coalesce(tokens_estimate(F.col("_text_first")), F.lit(0)) + F.coalesce(tokens_estimate(F.col("_text_second")), F.lit(0))
    rows = rows.withColumn("tokens_in", F.col("_in_first") + F.col("_in_second")).withColumn("tokens_out", out)
    rows = running_budget(rows, ["tenant_id"], "last_seen", "alert_id", F.col("tokens_in") + F.col("tokens_out"), daily_tokens, "_day")
    allowed = F.col("allowed") & F.col("_asked")
    answer = F.when(allowed, F.when(F.col("_good_first"), F.col("_answer_first")).when(F.col("_good_second"), F.col("_answer_second")))
    outcome = F.when(~allowed, "over_budget").when(answer.isNull(), "invalid").otherwise("ok")
    spent = [F.when(allowed, F.col(c)).otherwise(0).cast("bigint").alias(c) for c in ("tokens_in", "tokens_out")]
    rows = rows.withColumns({"_answer": answer, "outcome": outcome})
    return rows.select(*[c for c in alerts.columns if c not in ("summary", "ai_severity")], "_answer.summary", "_answer.ai_severity", *spent, "outcome")


def apply_triage(alerts: DataFrame, triaged: DataFrame) -> DataFrame:
    """Alerts with their summary, the model's severity and the new score."""
    good = triaged.filter("outcome = 'ok'")
    return rescore(alerts, good).join(good.select("alert_id", "summary"), "alert_id", "left")
