"""Journals after writers that were killed, and marks of hot keys."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ruleloom.operators import audit
from ruleloom.sources import journal


@pytest.fixture(scope="module")
def session(spark):
    spark.dataSource.register(journal.Journal)
    return spark


def append(session, folder, texts, parts=3):
    session.createDataFrame([(t, 1) for t in texts], "text string, other int").repartition(parts).write.format("journal").mode("append").save(str(folder))


def lines(session, folder):
    return sorted((r["text"], r["problem"]) for r in session.read.format("journal").load(str(folder)).collect() if r["text"] is not None)


def test_lines_come_back_with_numbers_and_problems(session, tmp_path):
    append(session, tmp_path / "j", [f'{{"k": {i}}}' for i in range(500)] + ["no", "[1]", "", None, '{"t": "two\nlines"}'])
    append(session, tmp_path / "j", ['{"k": 500}'])
    got = session.read.format("journal").load(str(tmp_path / "j"))
    assert got.where("problem is null").count() == 502 and sorted(r["problem"] for r in got.where("problem is not null").collect()) == ["not an object", "not json"]
    assert got.groupBy("file").agg(F.count("*").alias("n"), F.max("line_no").alias("m"), F.min("line_no").alias("l")).where("l < 1 or m < n").count() == 0
    assert session.read.format("journal").load(str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="only appended"):
        session.createDataFrame([("{}",)], "text string").write.format("journal").mode("overwrite").save(str(tmp_path / "j"))


def test_a_killed_writer_leaves_nothing_torn(session, tmp_path):
    folder = tmp_path / "j"
    append(session, folder, ['{"k": 1}', '{"k": 2}'])
    before = lines(session, folder)
    # killed while a task wrote, after parts had their names, and inside the log line
    (folder / "_part-x.jsonl").write_text('{"k": 3}\n{"k"')
    (folder / "part-y.jsonl").write_text('{"k": 4}\n')
    with open(folder / journal.LOG, "ab") as f:
        f.write(b'{"run": "z", "parts": [{"file": "part-y.jsonl", "si')
    assert lines(session, folder) == before
    append(session, folder, ['{"k": 5}'])  # the torn line is cut off first
    assert lines(session, folder) == sorted([*before, ('{"k": 5}', None)])
    assert all(line.endswith("}") for line in (folder / journal.LOG).read_text().splitlines())
    assert journal.repair(str(folder)) == ["_part-x.jsonl", "part-y.jsonl"] and journal.repair(f"file:{folder}") == []
    assert lines(session, folder) == sorted([*before, ('{"k": 5}', None)])


def test_a_writer_that_fails_commits_nothing(session, tmp_path):
    folder = tmp_path / "j"
    append(session, folder, ['{"k": 1}'])
    bad = session.range(40, numPartitions=4).select(F.when(F.col("id") == 35, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.lit("{}")).alias("text"))
    with pytest.raises(Exception):
        bad.write.format("journal").mode("append").save(str(folder))
    assert lines(session, folder) == [('{"k": 1}', None)] and len(journal.committed(str(folder))) == 1


def test_a_changed_part_is_told(session, tmp_path):
    folder = tmp_path / "j"
    append(session, folder, ['{"k": 1}', '{"k": 2}'], parts=2)
    first = journal.committed(str(folder))[0]["file"]
    with open(os.path.join(folder, first), "r+b") as f:
        f.write(b'{"K"')
    got = session.read.format("journal").load(str(folder)).collect()
    assert sorted(r["problem"] or "" for r in got) == ["", "damaged part"]


def test_marks_of_a_hot_key_are_carried_from_bucket_to_bucket(spark):
    rng = np.random.default_rng(0)
    marks = [(["hot", None, "b"][int(k)], int(t), int(m)) for k, t, m in zip(rng.choice(3, 300, p=[0.8, 0.1, 0.1]), rng.integers(0, 5_000, 300), rng.integers(0, 10**6, 300))] + [("hot", None, 7)]
    rows = [(i, ["hot", None, "c"][int(k)], int(t)) for i, (k, t) in enumerate(zip(rng.choice(3, 2_000, p=[0.9, 0.05, 0.05]), rng.integers(-50, 5_200, 2_000)))] + [(5_000, "hot", None)]
    due = {i: max(((mt, m) for mk, mt, m in marks if mk == k and mt is not None and t is not None and mt <= t), default=(0, None))[1] for i, k, t in rows}
    r, m = spark.createDataFrame(rows, "i long, k string, t long").repartition(5), spark.createDataFrame(marks, "k string, t long, m long").repartition(3)
    for bucket in (None, F.floor(F.col("t") / 100)):
        assert {x["i"]: x["m"] for x in audit.as_of(r, m, "k", "t", "m", bucket).collect()} == due
