"""Bounded retry and isolation of bad rows: one row that a handler fails on must not hold up the rest of its micro-batch.

A handler is a function from rows to what they give; it fails when its result is written. A batch that fails is cut in two
by a hash of its rows, and so on, until what fails stands alone: the rest is done, and the row waits with its count of
tries. Once it has waited `idle_s` it is tried again with the next batch, or by sweep() if none comes. At the last try it
becomes a dead letter.

A step (a micro-batch or a sweep) first writes its results and dead letters, then what waits; that last folder is its
commit, so a step that is repeated after a crash either does nothing or writes everything anew. Starts of a step are
counted: rows of a batch that has ended the driver as often as there are tries become dead letters too.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkwarden.storage import create_once, names_in

MAX_ATTEMPTS, IDLE_S = 5, 60.0
#: Runs of the handler in one step. What still fails then waits without counting a try: when nearly all rows fail, the
#: handler is at fault, not the rows.
MOST_RUNS = 256
LEDGER = "_key long, _attempts int, _error string, _tried_at double"
Handler = Callable[[DataFrame], DataFrame]


class Retries:
    """Handles the rows of a stream with bounded retry. Folders under `base`: out and dead_letters by step, waiting (the
    last step's is valid), work (parts of a batch that was cut), starts."""

    def __init__(self, spark: SparkSession, rows: StructType, handler: Handler, base: str, *, attempts: int = MAX_ATTEMPTS, idle_s: float = IDLE_S, most_runs: int = MOST_RUNS, clock: Callable[[], float] = time.time):
        self.spark, self.handler, self.base = spark, handler, base.rstrip("/")
        self.attempts, self.idle_s, self.most_runs, self.clock = attempts, idle_s, most_runs, clock
        self.columns = rows.names
        self.kept = StructType(rows.fields + StructType.fromDDL(LEDGER).fields)

    def _steps(self) -> list[str]:
        """Committed steps, the last one last: `<number>-<what>`."""
        names = names_in(self.spark, f"{self.base}/waiting")
        return [n for n in names if "_SUCCESS" in names_in(self.spark, f"{self.base}/waiting/{n}")]

    def waiting(self) -> DataFrame:
        """Rows that failed and wait, with their tries and last error."""
        steps = self._steps()
        read = self.spark.read.schema(self.kept)
        return read.parquet(f"{self.base}/waiting/{steps[-1]}") if steps else self.spark.createDataFrame([], self.kept)

    def dead_letters(self) -> DataFrame:
        """Rows that were given up, with code, tries and last error, of committed steps."""
        schema = StructType(self.kept.fields + StructType.fromDDL("code string").fields)
        paths = [f"{self.base}/dead_letters/{s}" for s in self._steps()]
        found = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return found.select(*self.columns, "code", F.col("_attempts").alias("attempts"), F.col("_error").alias("error"))

    def results(self) -> DataFrame:
        """What the handler gave in committed steps; fails while there are none."""
        return self.spark.read.parquet(*[f"{self.base}/out/{s}" for s in self._steps()])

    def step(self, batch: DataFrame, batch_id: int) -> None:
        """The work of a micro-batch, for foreachBatch."""
        self._step(batch, f"batch{batch_id}")

    def sweep(self) -> None:
        """Try what has waited long enough, without a new batch."""
        self._step(self.spark.createDataFrame([], StructType(self.kept.fields[: len(self.columns)])), f"sweep{len(self._steps())}")

    def _step(self, batch: DataFrame, what: str) -> None:
        done = self._steps()
        if any(s.split("-")[1] == what for s in done):
            return
        name, now = f"{len(done):08d}-{what}", self.clock()
        starts = f"{self.base}/starts/{name}"
        start = len(names_in(self.spark, starts)) + 1
        create_once(self.spark, f"{starts}/{start}")
        key = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in self.columns])))
        fresh = batch.select(*self.columns, key.alias("_key"), F.lit(0).alias("_attempts"), F.lit(None).cast("string").alias("_error"), F.lit(now).alias("_tried_at"))
        waits = self.waiting()
        late = F.col("_tried_at") + self.idle_s <= now
        work = f"{self.base}/work/{name}-{start}"
        fresh.unionByName(waits.filter(late)).write.mode("overwrite").parquet(f"{work}/rows")
        rows = self.spark.read.schema(self.kept).parquet(f"{work}/rows")
        if start > self.attempts:
            parts, failed = [], [(rows, f"{start - 1} starts of this step did not end", "MAX_DELIVERY_ATTEMPTS_EXCEEDED")]
        else:
            parts, failed = self._isolate(rows, work)
        out = self.handler(rows.limit(0).select(*self.columns)) if not parts else reduce(DataFrame.unionByName, [self.spark.read.parquet(p) for p in parts])
        out.write.mode("overwrite").parquet(f"{self.base}/out/{name}")
        none = self.spark.createDataFrame([], StructType(self.kept.fields + StructType.fromDDL("code string").fields))
        tried = [part.withColumns({"_attempts": F.col("_attempts") + (0 if code is None else 1), "_error": F.lit(error), "_tried_at": F.lit(now), "code": F.lit(code).cast("string")}) for part, error, code in failed]
        ended = reduce(DataFrame.unionByName, tried, none).withColumn("_over", (F.col("_attempts") >= self.attempts) & F.col("code").isNotNull() | (F.col("code") == "MAX_DELIVERY_ATTEMPTS_EXCEEDED"))
        over = F.coalesce("_over", F.lit(False))
        ended.filter(over).drop("_over").write.mode("overwrite").parquet(f"{self.base}/dead_letters/{name}")
        still = ended.filter(~over).drop("_over", "code").unionByName(waits.filter(~late))
        still.write.mode("overwrite").parquet(f"{self.base}/waiting/{name}")

    def _isolate(self, rows: DataFrame, work: str) -> tuple[list[str], list[tuple[DataFrame, str, str | None]]]:
        """Folders of what was done, and what failed: (rows, error, code; no code if it was not tried by itself)."""
        done: list[str] = []
        failed: list[tuple[DataFrame, str, str | None]] = []
        parts, runs = [(rows, 0)], 0
        while parts:
            part, bit = parts.pop(0)
            path = f"{work}/part{runs}"
            runs += 1
            try:
                self.handler(part.select(*self.columns)).write.mode("overwrite").parquet(path)
                done.append(path)
                continue
            except Exception as cause:  # whatever a handler may raise
                error = f"{type(cause).__name__}: {str(cause).splitlines()[0] if str(cause) else ''}"[:1000]
            if part.select("_key").distinct().limit(2).count() < 2:
                failed.append((part, error, "HANDLER_FAILED"))
            elif runs + len(parts) + 2 > self.most_runs:
                failed.append((part, error, None))
            else:
                halves = [part.filter(F.shiftright("_key", bit).bitwiseAND(F.lit(1)) == side) for side in (0, 1)]
                parts += [(half, bit + 1) for half in halves if not half.isEmpty()]
        return done, failed


def run_with_retries(stream: DataFrame, retries: Retries, checkpoint: str):
    """Handle a stream until all that is there now is read; returns the query."""
    return stream.writeStream.foreachBatch(retries.step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
