"""A buffer of events between a collector and its receiver: segmented logs that jobs append to, read and commit.

    <path>/append=<name>/class=<class>/segment=<n>/part-*.txt    lines `<20 digits> <json>`, each ended by a line feed
    <path>/_commits/<n>                                          how far the receiver has accepted, in order
    <path>/_drops/<n>                                            what was shed, by class, and the last number ever given

An append is there once its folder is complete (its _SUCCESS), so one that died leaves nothing that is read and may be made
again under its name. Numbers rise over all classes in the order of arrival, so the logs merge back into that order. A last
line without a line feed is torn and cut; other lines that are no event are skipped and counted. Accepted events
that a reader died upon are delivered again: receivers know events by their id.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwarden.operators.usage import SHED_FIRST
from sparkwarden.storage import create_once, names_in, remove, text_of, written

SEGMENT_BYTES, MAX_BYTES = 4 * 1024 * 1024, 256 * 1024 * 1024
BATCH_EVENTS, BATCH_BYTES = 1000, 5 * 1024 * 1024
FILES = "path string, length long, content binary, append string, class string, segment long"


class Buffer:
    """The buffer under `path`. One writer and one reader at a time; both may be other sessions."""

    def __init__(self, spark: SparkSession, path: str, *, segment_bytes: int = SEGMENT_BYTES, max_bytes: int = MAX_BYTES):
        self.spark, self.path, self.segment_bytes, self.max_bytes = spark, path.rstrip("/"), segment_bytes, max_bytes

    # ---- logs of small files

    def _log(self, name: str) -> list[dict]:
        return [json.loads(text_of(self.spark, f"{self.path}/{name}/{n}")) for n in names_in(self.spark, f"{self.path}/{name}")]

    def _add(self, name: str, entry: dict) -> None:
        at = len(names_in(self.spark, f"{self.path}/{name}"))
        if not create_once(self.spark, f"{self.path}/{name}/{at:08d}", json.dumps(entry)):
            raise RuntimeError(f"another job has written to {name}")

    def committed(self) -> int:
        """The number up to which events were accepted."""
        return max([c["upto"] for c in self._log("_commits")], default=0)

    def dropped(self) -> dict[str, int]:
        """Events shed so far, by class; usage.drop_deltas makes reports of it."""
        out: dict[str, int] = {}
        for entry in self._log("_drops"):
            for name, n in entry["dropped"].items():
                out[name] = out.get(name, 0) + n
        return out

    # ---- reading

    def files(self) -> DataFrame:
        """Segments of complete appends, by bounded file; without `content` only the listing is read."""
        appends = [n for n in names_in(self.spark, self.path) if n.startswith("append=") and "_SUCCESS" in names_in(self.spark, f"{self.path}/{n}")]
        schema = self.spark.createDataFrame([], FILES)
        if not appends:
            return schema
        read = self.spark.read.format("binaryFile").option("basePath", self.path).option("pathGlobFilter", "*.txt").load([f"{self.path}/{a}" for a in appends])
        if "class" not in read.columns:  # appends of no rows
            return schema
        return read.select(*[F.col(f.name).cast(f.dataType) for f in schema.schema.fields])

    def _lines(self) -> DataFrame:
        """Lines with their parts; a torn end is a line of its own."""
        # Cut as bytes, one character each: split() would put U+FFFD for what is no UTF-8, a torn character for one.
        parts = F.split(F.decode("content", "ISO-8859-1"), "\n", -1)
        # The end is marked within the array: what is told of a segment beside its lines is worked out again for each line.
        marked = lambda line, torn: F.struct(line.alias("line"), F.lit(torn).alias("torn"))
        whole = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda line: marked(line, False))
        lines = self.files().select("append", "class", "segment", F.inline(F.concat(whole, F.array(marked(F.element_at(parts, -1), True)))))
        lines = lines.withColumn("line", F.encode("line", "ISO-8859-1").cast("string"))
        torn = F.col("torn")
        body = F.substring("line", 22, 1 << 30)
        ok = F.is_valid_utf8("line") & F.rlike("line", F.lit(r"^[0-9]{20} \{")) & F.try_parse_json(F.when(F.is_valid_utf8("line"), body)).isNotNull()
        seq = F.when(ok, F.substring("line", 1, 20).try_cast("bigint"))
        return lines.filter(~torn | (F.col("line") != "")).select("append", "class", "segment", "torn", F.when(~torn, seq).alias("seq"), body.alias("body"), (F.octet_length("line") + 1).cast("long").alias("bytes"))

    def events(self) -> DataFrame:
        """All whole events that are stored: append, class, segment, seq, body, bytes."""
        return self._lines().filter("seq is not null").drop("torn")

    def damage(self) -> DataFrame:
        """What is not read, by class: torn ends and corrupt lines."""
        return self._lines().filter("seq is null").groupBy("class").agg(F.count_if("torn").alias("torn"), F.count_if(~F.col("torn")).alias("corrupt"))

    def pending(self) -> DataFrame:
        return self.events().filter(F.col("seq") > self.committed())

    def next_batch(self, max_events: int = BATCH_EVENTS, max_bytes: int = BATCH_BYTES) -> DataFrame:
        """The oldest events that wait, over all classes, within both limits; one that is too large stands alone. Nothing is
        consumed. Only the `max_events` oldest are ordered."""
        first = self.pending().orderBy("seq").limit(max_events)
        size = F.octet_length("body") + 1
        upto = F.sum(size).over(Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
        return first.withColumn("_upto", upto).filter((F.col("_upto") <= max_bytes) | (F.col("_upto") == size)).select("seq", "class", "body")

    # ---- accepting, shedding, appending

    def commit(self, upto: int) -> None:
        """The receiver has accepted all events up to this number; segments that hold nothing else are removed."""
        if upto < self.committed():
            raise ValueError("what was accepted cannot be taken back")
        self._add("_commits", {"upto": upto})
        over = self.events().groupBy("append", "class", "segment").agg(F.max("seq").alias("last")).filter(F.col("last") <= upto)
        self._remove(over)

    def _remove(self, segments: DataFrame) -> None:
        for s in segments.select("append", "class", "segment").collect():  # at most max_bytes / segment_bytes, and a few
            remove(self.spark, f"{self.path}/append={s.append}/class={s['class']}/segment={s.segment}")

    def last(self) -> int:
        """The last number that was given, also where its segment is gone."""
        stored = self.events().agg(F.max("seq")).first()[0] or 0
        return max(stored, self.committed(), *[d["last"] for d in self._log("_drops")], 0)

    def _shed(self, need: int, classes: list[str]) -> None:
        """Drop whole segments until `need` more bytes fit: of the class that is shed first, the oldest first. Counts are
        written before anything goes."""
        size = self.files().groupBy("append", "class", "segment").agg(F.sum("length").alias("size"))
        excess = (size.agg(F.sum("size")).first()[0] or 0) + need - self.max_bytes
        if excess <= 0:
            return
        own = self.events().groupBy("append", "class", "segment").agg(F.min("seq").alias("first"), F.count_if(F.col("seq") > self.committed()).alias("n"))
        rank = F.coalesce(*[F.when(F.col("class") == c, F.lit(k)) for k, c in enumerate(classes)], F.lit(len(classes)))
        before = F.sum("size").over(Window.orderBy(rank, "class", "first", "append", "segment").rowsBetween(Window.unboundedPreceding, -1))
        # A row for each segment; the cap bounds their number.
        gone = size.join(own, ["append", "class", "segment"], "left").withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < excess)
        gone = written(gone, "buffer-shed")
        lost = {r["class"]: r.n for r in gone.groupBy("class").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect()}
        self._add("_drops", {"dropped": lost, "last": self.last()})
        self._remove(gone)

    def append(self, events: DataFrame, name: str, order: list[str], *, class_col: str = "class", shed_first: tuple = SHED_FIRST) -> int:
        """Append events(body as JSON, class) in the order of columns that tell all rows apart; returns how many there are.
        An append whose name is complete already does nothing. If the buffer would grow beyond its cap, older segments are
        shed; an append that is larger than the whole buffer is refused.

        Rows are numbered by ranges: each range counts for itself, and only the ranges' counts pass through one task."""
        place = f"{self.path}/append={name}"
        if "_SUCCESS" in names_in(self.spark, place):
            return 0
        ranges = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = events.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
        rows = rows.select(F.coalesce(F.col(class_col), F.lit("other")).alias("class"), "body", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_k"))
        rows = written(rows.withColumn("bytes", (F.octet_length("body") + 22).cast("long")), "buffer-rows").filter("body is not null")
        total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
        if total.bytes > self.max_bytes:
            raise ValueError(f"{total.bytes} bytes do not fit into a buffer of {self.max_bytes}")
        self._shed(total.bytes, list(shed_first))
        counts = rows.groupBy("_p").agg(F.count("*").alias("_n"))
        counts = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
        sizes = rows.groupBy("class", "_p").agg(F.sum("bytes").alias("_b"))
        sizes = sizes.select("class", "_p", F.coalesce(F.sum("_b").over(Window.partitionBy("class").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_size"))
        # One row for each range, and for each range and class.
        rows = rows.withColumn("_own", F.row_number().over(Window.partitionBy("_p").orderBy("_k"))).join(F.broadcast(counts), "_p").join(sizes, ["class", "_p"])
        within = F.sum("bytes").over(Window.partitionBy("class", "_p").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))
        seq = F.lit(self.last()) + F.col("_before") + F.col("_own")
        rows = rows.select("class", seq.alias("seq"), F.floor((F.col("_size") + within - F.col("bytes")) / self.segment_bytes).alias("segment"), "body")
        line = F.concat(F.lpad(F.col("seq").cast("string"), 20, "0"), F.lit(" "), "body")
        lines = rows.repartition("class", "segment").sortWithinPartitions("class", "segment", "seq").select("class", "segment", line.alias("value"))
        lines.write.mode("overwrite").option("lineSep", "\n").partitionBy("class", "segment").text(place)
        return total.n


def drain(buffer: Buffer, send: Callable[[DataFrame], bool], **limits: int) -> int:
    """Send batch after batch until nothing waits or the receiver refuses one; returns the batches it accepted."""
    sent = 0
    while True:
        batch = written(buffer.next_batch(**limits), "buffer-batch")
        upto = batch.agg(F.max("seq")).first()[0]
        if upto is None or not send(batch):
            return sent
        buffer.commit(upto)
        sent += 1
