import os

import pytest
from pyspark.sql import functions as F

from lakekit.api import ChangeFeed, OperationMetrics, read_changes
from lakekit.constants import CHANGE_FEED_PROPERTY
from lakekit.errors import ChangeFeedError, ValidationError, VersionNotFoundError
from lakekit.operators.op_metrics import covers, equalities
from lakekit.operators.versions import version_ranges
from lakekit.storage.table import LakeTable

from .conftest import rows

BASE = [(1, "Male", 25), (2, "Male", 25), (3, "Female", 35)]
UPDATES = [(1, "Male", 35), (2, "Male", 100), (2, "Male", 101), (2, "Male", 102), (4, "Female", 18), (1, "Other", 55), (2, "Male", 65), (2, "Other", 66), (2, "Other", 67), (4, "Female", 25), (4, "Other", 45), (2, "Male", 45), (2, "Other", 67)]
DDL = "id int, gender string, age int"


def make(spark, path, on=True):
    return LakeTable.write(spark.createDataFrame(BASE, DDL).coalesce(1), str(path), properties={CHANGE_FEED_PROPERTY: "true"} if on else None)


def upsert(t, row, cond="source.id = target.id"):
    t.merge(t.spark.createDataFrame([row], t.schema), cond).when_matched_update_all().when_not_matched_insert_all().execute()


def feed(t, on):
    t.set_properties({CHANGE_FEED_PROPERTY: "true" if on else "false"})


@pytest.fixture(scope="module")
def long_table(spark, tmp_path_factory):
    """v0 write, v1-12 merges, v13 merge without effect; the commit of v0 is deleted."""
    t = make(spark, tmp_path_factory.mktemp("feed") / "t")
    for u in UPDATES[:12]:
        upsert(t, u)
    t.merge(spark.createDataFrame([(1, "x", 1)], DDL), "source.id = target.id and false").when_matched_update_all().execute()
    upsert(t, UPDATES[12])
    os.unlink(f"{t.log.dir}/{0:020d}.json")
    return t


def test_commit_gone(long_table):
    late, early = ChangeFeed.of(long_table.path, 11, 12), ChangeFeed.of(long_table.path, 0, 5)
    assert late.earliest_commit_versions() == (11, 12) and late.available_log_versions() == (11, 12) and late.available_change_versions() == (11, 12)
    assert late.dry_run() == late
    assert late.read().select("_commit_version").distinct().count() == 2
    assert early.earliest_commit_versions() == (1, 14) and early.available_log_versions() == (10, 14)
    assert early.read_available_log().select("_commit_version").distinct().count() == 4  # v13 changed nothing
    with pytest.raises(VersionNotFoundError):
        early.read()
    assert ChangeFeed.of(long_table.path, 11).end == 14


def test_change_files_gone(long_table):
    path = [r[0] for r in long_table.log.actions(12, 12).filter("cdc is not null").select("cdc.path").collect()]
    hidden = {f"{long_table.path}/{p}": f"{long_table.path}/{p}.hidden" for p in path}
    for a, b in hidden.items():
        os.rename(a, b)
    f = ChangeFeed.of(long_table.path, 12, 14)
    with pytest.raises(ChangeFeedError, match="gone"):
        f.read()
    assert ChangeFeed.of(long_table.path, 10, 14).available_change_versions() == (10, 14)
    assert f.available_change_versions() is None  # v13 has no change files, the end isn't probed
    for a, b in hidden.items():
        os.rename(b, a)
    assert f.available_change_versions() == (12, 14)


def test_images(spark, tmp_path):
    t = make(spark, tmp_path / "t")
    upsert(t, (1, "Other", 99))
    t.delete("id = 2")
    LakeTable.write(spark.createDataFrame([(7, None, 1)], DDL), t.path, mode="append")
    t.update({"age": "age + 1"}, "id = 3")
    got = rows(read_changes(spark, t.path, 0, 4).drop("_commit_timestamp"))
    assert got == sorted([*[(*r, "insert", 0) for r in BASE], (1, "Male", 25, "update_preimage", 1), (1, "Other", 99, "update_postimage", 1), (2, "Male", 25, "delete", 2), (7, None, 1, "insert", 3), (3, "Female", 35, "update_preimage", 4), (3, "Female", 36, "update_postimage", 4)], key=repr)
    t.compact()
    assert rows(read_changes(spark, t.path, 5, 5)) == []  # compaction changes no data


def test_inserts_of_a_partitioned_table(spark, tmp_path):
    t = LakeTable.write(spark.createDataFrame([*BASE, (4, "a+b c", 1)], DDL).coalesce(1), str(tmp_path / "t"), partition_by=["gender"], properties={CHANGE_FEED_PROPERTY: "true"})
    LakeTable.write(spark.createDataFrame([(9, "a+b c", 2)], DDL).coalesce(1), t.path, mode="append")
    want = [(1, "Male"), (2, "Male"), (3, "Female"), (4, "a+b c"), (9, "a+b c")]
    assert rows(read_changes(spark, t.path, 0, 1).select("id", "gender")) == want
    t.compact()
    assert rows(t.to_df().select("id", "gender")) == want and t.files().count() == 3


def test_on_and_off(spark, tmp_path):
    t = make(spark, tmp_path / "t")
    for u in UPDATES[:2]:
        upsert(t, u)
    feed(t, False)  # v3
    upsert(t, UPDATES[2])
    feed(t, True)  # v5
    upsert(t, UPDATES[3])
    LakeTable.write(spark.createDataFrame([(9, "A", 1)], DDL), t.path, mode="append")  # v7: an append is in the feed (Q4)
    feed(t, False)  # v8
    f = ChangeFeed.of(t.path, 0, 8)
    assert [on for _, on in f.status()] == [True, True, True, False, False, True, True, True, False]
    assert f.enabled_versions() == [0, 1, 2, 5, 6, 7] and f.disabled_versions() == [3, 4, 8]
    assert f.enabled_ranges() == [(0, 2), (5, 7)] and f.disabled_ranges() == [(3, 4), (8, 8)]
    assert f.available_log_versions() is None
    with pytest.raises(ChangeFeedError, match="not enabled"):
        f.read()
    assert {r[0] for r in f.read_enabled_ranges().select("_commit_version").distinct().collect()} == {0, 1, 2, 6, 7}
    assert ChangeFeed.of(t.path, 0, 2).available_log_versions() == (0, 2)
    assert ChangeFeed.of(t.path, 0, 2).dry_run().available_change_versions() == (1, 2)
    with pytest.raises(AssertionError):
        ChangeFeed.of(t.path, 4, 8).available_change_versions()
    with pytest.raises((AssertionError, ChangeFeedError)):
        f.dry_run()
    assert ChangeFeed.of(t.path, 3, 3).enabled_ranges() is None


def test_session_default_and_disabled_at_once(spark, tmp_path):
    spark.conf.set("spark.lakekit.defaults.enableChangeDataFeed", "true")
    t = make(spark, tmp_path / "t", on=False)
    spark.conf.unset("spark.lakekit.defaults.enableChangeDataFeed")
    assert t.change_feed_on()
    feed(t, False)
    upsert(t, UPDATES[0])
    assert ChangeFeed.of(t.path, 0, 2).enabled_ranges() is None


def test_ranges(spark):  # Q3
    v = spark.createDataFrame([(x,) for x in (0, 1, 2, 3, 8, 10, 11, 11)], "version long")
    assert rows(version_ranges(v)) == [(0, 3), (10, 11), (8, 8)]
    assert rows(version_ranges(v.limit(0))) == []


def test_count_metrics(spark, tmp_path):
    data = [(1, "Male", 25, "IND"), (2, "Female", 35, "USA"), (3, "Female", 45, "IND"), (4, "Male", 18, "USA")]
    t = LakeTable.write(spark.createDataFrame(data, DDL + ", country string"), str(tmp_path / "t"), partition_by=["country"])
    for u in ((1, "Male", 35, "IND"), (2, "Male", 100, "USA"), (5, "Male", 101, "IND"), (4, "Female", 18, "USA")):
        upsert(t, u, f"source.id = target.id and target.country = '{u[3]}'")
    t.delete("id = 2 and country == 'USA'")
    LakeTable.write(spark.createDataFrame([(6, "Male", 1, "USA")], t.schema), t.path, mode="append")
    t.set_properties({"a": "b"})
    t.update({"age": "0"}, "country = 'USA' and id = 4")
    t.compact()
    m = OperationMetrics(t.path)
    assert m.as_list() == [(8, 0, 0, 1, 0), (6, 0, 1, 0, 1), (5, 1, 0, 0, 0), (4, 0, 0, 1, 1), (3, 0, 1, 0, 1), (2, 0, 0, 1, 1), (1, 0, 0, 1, 1), (0, 0, 4, 0, 4)]
    usa = [(8, 0, 0, 1, 0), (6, 0, 1, 0, 1), (5, 1, 0, 0, 0), (4, 0, 0, 1, 1), (2, 0, 0, 1, 1), (0, 0, 2, 0, 2)]
    assert m.as_list("country = 'USA'") == usa == m.as_list("country=USA")
    assert m.as_list("country = 'usa'")[-1] == (0, 0, 0, 0, 0)  # values of writes are compared with case
    assert m.as_list("country = 'US'")[-1] == (0, 0, 0, 0, 0)  # Q5: no part of a value matches
    assert m.written_rows("country = 'USA'", 0) == 2
    assert OperationMetrics(t.path, 5, 6).as_list() == [(6, 0, 1, 0, 1), (5, 1, 0, 0, 0)]
    with pytest.raises(ValidationError):
        m.as_list("country = 'USA' OR country = 'IND'")


def test_conditions():  # Q6
    assert equalities("a.country#12 = 'USA' AND `gender` == \"F\" and age > 5") == {"country": "USA", "gender": "F"}
    assert covers('["(country#1 = USA)"]', "country = 'usa'") and not covers("country = 'USA'", "country = 'IND'") and not covers(None, "a = 1") and not covers("a = 1", "")


def test_concurrent_commits(spark, tmp_path):
    from lakekit.errors import ConcurrentCommitError

    t = make(spark, tmp_path / "t")
    t.log.commit(1, "WRITE", [])
    with pytest.raises(ConcurrentCommitError):
        t.log.commit(1, "WRITE", [])
    assert t.history().count() == 2 and t.history().filter(F.col("version") == 1).count() == 1
