import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siftline.sources import lines

SHAPE = "id long, text string, n double"


@pytest.fixture
def folder(spark, tmp_path):
    lines.register(spark)
    return str(tmp_path / "data")


def read(spark, path, size=128 << 20):
    return spark.read.format("siftline_lines").schema(SHAPE).option("path", path).option("range_bytes", size).load()


def append(df, path, **options):
    df.write.format("siftline_lines").mode("append").options(path=path, **options).save()


def files(path):
    return sorted(f for f in os.listdir(path) if not f.startswith("_")), [f for _, _, found in os.walk(f"{path}/_staging") for f in found]


def test_ranges_read_each_line_once(spark, folder):
    rows = [(i, "é\n" * (i % 7) + "x" * (i % 50), None if i % 3 else i / 2) for i in range(300)]
    append(spark.createDataFrame(rows, SHAPE).repartition(4), folder)
    for size in (900, 10**6):
        assert sorted(tuple(r) for r in read(spark, folder, size).collect()) == rows
    append(spark.createDataFrame(rows[:5], SHAPE), folder)
    assert read(spark, folder).count() == 305
    assert read(spark, folder + "/none").count() == 0


def test_every_boundary_of_ranges(spark, folder):
    os.makedirs(folder)
    with open(f"{folder}/a.jsonl", "w") as f:
        f.write("".join(json.dumps({"id": i}) + "\n" for i in range(12)) + "\n" + json.dumps({"id": 12}))
    for size in (3, 10, 11, 13):
        got = [x[0] for p in lines.LinesReader(folder, read(spark, folder).schema, size).partitions() for x in lines.LinesReader(folder, read(spark, folder).schema, size).read(p)]
        assert got == list(range(13))


def test_failed_and_repeated_jobs_leave_each_row_once(spark, folder):
    rows = spark.range(0, 40, 1, 4).select("id", F.lit("x").alias("text"), F.lit(1.0).alias("n"))
    append(rows, folder, job="one")
    append(rows, folder, job="one")  # the same job again
    assert read(spark, folder).count() == 40
    broken = rows.withColumn("text", F.when(F.col("id") == 35, F.raise_error(F.lit("lost"))).otherwise(F.lit("y")))
    with pytest.raises(PySparkException):
        append(broken, folder, job="two")
    assert read(spark, folder).count() == 40 and files(folder)[1] == []
    append(rows, folder, job="two")
    assert read(spark, folder).groupBy("id").count().where("count = 2").count() == 40


def test_lost_tasks_are_not_moved(folder):
    writer = lines.LinesWriter(folder, ["id"], "job")
    os.makedirs(f"{folder}/_staging/job")
    staged = []
    for attempt in range(2):  # two attempts of partition 0: only the one that the driver hears of counts
        path = f"{folder}/_staging/job/0-{attempt}"
        with open(path, "w") as f:
            f.write(json.dumps({"id": attempt}) + "\n")
        staged.append(path)
    writer.commit([lines.Staged(staged[1], 0), None])
    writer.commit([lines.Staged(staged[1], 0), None])  # the commit again
    found, left = files(folder)
    assert len(found) == 1 and left == [] and json.load(open(f"{folder}/{found[0]}")) == {"id": 1}
