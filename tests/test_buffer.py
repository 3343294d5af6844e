"""The segmented buffer: order over classes, crashes, torn and corrupt lines, commits, shedding."""

import os
from glob import glob

import pytest
from pyspark.sql import functions as F

from sparkwarden.sources.buffer import Buffer, drain

CLASSES = ("network", "process", "auth")


def events(spark, first, n):
    rows = spark.range(first, first + n).withColumn("class", F.element_at(F.array(*map(F.lit, CLASSES)), (F.col("id") % 3 + 1).cast("int")))
    return rows.withColumn("body", F.to_json(F.struct("id", F.lit("a\nbé").alias("text"))))


def ids(df):
    return [r.id for r in df.orderBy("seq").select(F.get_json_object("body", "$.id").cast("int").alias("id")).collect()]


def test_order_over_classes_and_appends(spark, tmp_path):
    b = Buffer(spark, str(tmp_path / "b"), segment_bytes=400)
    assert b.next_batch().isEmpty() and b.last() == 0 and b.damage().isEmpty()
    assert b.append(events(spark, 0, 40).orderBy(F.rand(1)), "1", ["id"]) == 40 and b.append(events(spark, 40, 20), "2", ["id"]) == 20
    assert b.append(events(spark, 40, 20), "2", ["id"]) == 0  # made again under its name
    assert b.append(events(spark, 0, 0), "3", ["id"]) == 0
    got = b.events()
    assert ids(got) == list(range(60)) and sorted(r.seq for r in got.collect()) == list(range(1, 61))
    sizes = got.groupBy("append", "class", "segment").agg(F.sum("bytes").alias("n"), F.count("*").alias("rows")).collect()
    assert len(sizes) > 6 and max(r.n for r in sizes) <= 400 + 60
    assert ids(Buffer(spark, str(tmp_path / "b")).next_batch(max_events=7)) == list(range(7))  # another session
    one = got.filter("seq = 1").first().bytes - 21
    assert ids(b.next_batch(max_bytes=3 * one)) == [0, 1, 2] and ids(b.next_batch(max_bytes=1)) == [0]


def test_commits_survive_and_remove_consumed_segments(spark, tmp_path):
    b = Buffer(spark, str(tmp_path / "b"), segment_bytes=120)
    b.append(events(spark, 0, 30), "1", ["id"])
    before = len(glob(f"{tmp_path}/b/append=1/class=*/segment=*"))
    batches = []
    assert drain(b, lambda df: batches.append(ids(df)) or len(batches) < 3, max_events=8) == 2
    assert batches == [list(range(8)), list(range(8, 16)), list(range(16, 24))]
    again = Buffer(spark, str(tmp_path / "b"))
    assert again.committed() == 16 and ids(again.next_batch(max_events=2)) == [16, 17]  # the refused batch comes again
    assert 0 < len(glob(f"{tmp_path}/b/append=1/class=*/segment=*")) < before
    with pytest.raises(ValueError):
        again.commit(3)
    again.commit(30)
    assert again.pending().isEmpty() and again.last() == 30
    again.append(events(spark, 30, 2), "2", ["id"])
    assert sorted(r.seq for r in again.pending().collect()) == [31, 32]  # numbers are never given twice


def test_an_append_that_died_is_not_read_and_may_be_made_again(spark, tmp_path):
    b = Buffer(spark, str(tmp_path / "b"))
    b.append(events(spark, 0, 9), "1", ["id"])
    b.append(events(spark, 9, 9), "2", ["id"])
    os.remove(tmp_path / "b" / "append=2" / "_SUCCESS")
    assert ids(b.events()) == list(range(9))
    b.append(events(spark, 9, 9), "2", ["id"])
    assert ids(b.events()) == list(range(18)) and b.last() == 18


def test_torn_and_corrupt_lines(spark, tmp_path):
    b = Buffer(spark, str(tmp_path / "b"))
    b.append(events(spark, 0, 9), "1", ["id"])
    [file] = glob(f"{tmp_path}/b/append=1/class=auth/segment=0/part-*.txt")
    with open(file, "ab") as f:
        f.write(b'no event\n00000000000000000077 {"id": 77\n99999999999999999999 {"id":1}\n00000000000000000078 {"id":"\xff"}\n\n00000000000000000079 {"id":79}\n00000000000000000080 {"id":80}')
    for crc in glob(f"{tmp_path}/b/append=1/class=auth/segment=0/.*.crc"):
        os.remove(crc)
    assert ids(b.events()) == [*range(9), 79]
    assert {r["class"]: (r.torn, r.corrupt) for r in b.damage().collect()} == {"auth": (1, 5)}
    with open(file, "ab") as f:
        f.write("é".encode()[:1])  # a torn character
    assert ids(b.events()) == [*range(9), 79] and b.last() == 79


def test_a_full_buffer_sheds_the_oldest_of_the_class_that_matters_least(spark, tmp_path):
    one = events(spark, 0, 1).select(F.octet_length("body") + 22).first()[0]
    b = Buffer(spark, str(tmp_path / "b"), segment_bytes=3 * one, max_bytes=34 * one)
    b.append(events(spark, 0, 10), "1", ["id"])
    b.append(events(spark, 10, 20), "2", ["id"])
    assert not b.dropped()
    b.append(events(spark, 30, 12), "3", ["id"])
    lost = b.dropped()
    assert set(lost) == {"network"} and lost["network"] >= 8
    kept = ids(b.events())
    network = [i for i in range(30) if i % 3 == 0]
    assert [i for i in kept if i % 3] == [i for i in range(42) if i % 3] and [i for i in kept if i % 3 == 0 and i < 30] == network[lost["network"]:]
    assert sum(os.path.getsize(f) for f in glob(f"{tmp_path}/b/append=*/class=*/segment=*/*.txt")) <= 34 * one
    with pytest.raises(ValueError):
        b.append(events(spark, 100, 50), "4", ["id"])
    assert ids(b.events()) == kept


def test_a_segment_is_cut_once_and_not_for_each_line(spark, tmp_path):
    b = Buffer(spark, str(tmp_path / "b"))
    b.append(events(spark, 0, 3), "1", ["id"])
    plan = b.events()._jdf.queryExecution().optimizedPlan().toString()
    above, generate = plan.split("Generate ", 1)
    assert "split(" not in above and "content" not in above and "split(" in generate.splitlines()[0]
