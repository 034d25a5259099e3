import pathlib

import pytest
from pyspark.sql import functions as F

from talkweave.sources import buckets

SCHEMA = "conversation_id string, n int, body string"


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = [(f"c{i % 40}", i, "old") for i in range(400)] + [(None, 1000, "old")]
    buckets.write_buckets(spark.createDataFrame(rows, SCHEMA), path, ["conversation_id"], ("conversation_id", "n"), 16)
    return path


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in pathlib.Path(path).rglob("*.parquet")}


def rows_of(spark, path):
    return sorted((tuple(r) for r in buckets.read_buckets(spark, path).collect()), key=str)


def test_only_touched_buckets_are_written(spark, stored):
    before, old = files(stored), rows_of(spark, stored)
    new = spark.createDataFrame([("c3", 1, "new"), ("c3", 2, "new")], SCHEMA)
    gone = spark.createDataFrame([("c3",), ("c7",), ("never seen",)], "conversation_id string")
    touched = buckets.replace_in_place(spark, stored, new, gone)
    want = [r for r in old if r[0] not in ("c3", "c7")] + [("c3", 1, "new"), ("c3", 2, "new")]
    assert rows_of(spark, stored) == sorted(want, key=str)
    part = lambda name: int(name.split("/")[0].split("=")[1])
    after = files(stored)
    assert len(touched) <= 3
    assert {k: v for k, v in before.items() if part(k) not in touched} == {k: v for k, v in after.items() if part(k) not in touched}
    assert not {k for k in before if part(k) in touched} & set(after)
    buckets.replace_in_place(spark, stored, new, gone)  # given again, it changes nothing
    assert rows_of(spark, stored) == sorted(want, key=str)


def test_a_failed_change_leaves_the_table(spark, stored):
    before, old = files(stored), rows_of(spark, stored)
    bad = spark.createDataFrame([("c1", 1, "x")], SCHEMA).withColumn("body", F.raise_error(F.lit("no model")).cast("string"))
    with pytest.raises(Exception, match="no model"):
        buckets.replace_in_place(spark, stored, bad).clear()
    assert files(stored) == before and rows_of(spark, stored) == old


def test_a_bucket_may_become_empty(spark, stored):
    all_names = buckets.read_buckets(spark, stored).select("conversation_id")
    only = spark.createDataFrame([("c5", 0, "kept")], SCHEMA)
    buckets.replace_in_place(spark, stored, only, all_names.where("conversation_id <> 'c6'"))
    left = rows_of(spark, stored)
    assert [r for r in left if r[0] not in ("c6", None)] == [("c5", 0, "kept")]
    assert len([r for r in left if r[0] == "c6"]) == 10 and ((None, 1000, "old") in left)


def test_upsert_in_place(spark, tmp_path):
    path = str(tmp_path / "t")
    buckets.write_buckets(spark.createDataFrame([(i, "old") for i in range(100)], "k int, v string"), path, ["k"], ("k",), 8)
    batch = spark.createDataFrame([(5, "first", 1), (5, "last", 2), (200, "new", 1)], "k int, v string, at int")
    assert len(buckets.upsert_in_place(spark, path, batch, ["k"], "at")) <= 2
    got = dict(map(tuple, buckets.read_buckets(spark, path).collect()))
    assert got == {**{i: "old" for i in range(100)}, 5: "last", 200: "new"}
    assert buckets.upsert_in_place(spark, path, batch.limit(0), ["k"], "at") == []


def test_refusals(spark, stored, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x")], SCHEMA)
    with pytest.raises(Exception, match="(?i)exist"):
        buckets.write_buckets(rows, stored, ["conversation_id"], ("n",))
    with pytest.raises(ValueError, match="bucket"):
        buckets.write_buckets(rows, str(tmp_path / "x"), ["conversation_id"], ("n",), 0)
    rows.write.parquet(str(tmp_path / "plain"))
    with pytest.raises(ValueError, match="not a table in buckets"):
        buckets.read_buckets(spark, str(tmp_path / "plain"))
