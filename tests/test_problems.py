import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lakekit.common import hot_slices, salted_join
from lakekit.errors import ConcurrentCommitError
from lakekit.operators import merkle
from lakekit.operators.compaction import bin_report, plan_bins, small_files
from lakekit.operators.history import islands, statements
from lakekit.operators.live_files import live_files
from lakekit.operators.merkle import MerkleTracker, due_changes
from lakekit.operators.replay import replay
from lakekit.streaming.apply import ChangeApplier

from .conftest import rows

# ---------------------------------------------------------------- helpers


def test_salted_join_and_slices(spark):
    big = spark.createDataFrame([(1, i) for i in range(200)] + [(2, 5), (None, 6)], "k int, v int")
    small = spark.createDataFrame([(1, "a"), (3, "c"), (None, "n")], "k int, s string")
    assert salted_join(big, small, ["k"], ["v"]).count() == 200
    assert salted_join(big, small, ["k"], ["v"], "left").count() == 202
    assert rows(salted_join(big, small, ["k"], ["v"], "left_anti")) == [(2, 5), (None, 6)]
    s = hot_slices(big, ["k"], "v", max_rows=50, slices=8)
    got = s.groupBy("k").agg(F.count_distinct("__slice").alias("n"), F.max("__slice").alias("m")).collect()
    assert {r["k"]: r["n"] for r in got}[1] == 8 and {r["k"]: r["m"] for r in got}[2] == 0 and s.count() == 202
    bounds = s.filter("k = 1").groupBy("__slice").agg(F.min("v").alias("a"), F.max("v").alias("b")).orderBy("__slice").collect()
    assert all(x["b"] < y["a"] for x, y in zip(bounds, bounds[1:], strict=False))


# ---------------------------------------------------------------- replay

CHANGES = "k int, x int, y string, op string, seq long"


def machine(data, partial):
    state, done = {}, defaultdict(lambda: -1)
    for k, x, y, op, seq in sorted({d for d in data if d[0] is not None and d[4] is not None}, key=lambda d: (d[0], d[4])):
        op = op.strip().lower()
        if op not in ("insert", "update_postimage", "delete") or seq <= done[k]:
            continue
        done[k] = seq
        if op == "delete":
            state.pop(k, None)
        elif partial and op != "insert" and k in state:
            state[k] = (x if x is not None else state[k][0], y if y is not None else state[k][1], seq)
        else:
            state[k] = (x, y, seq)
    return sorted([(k, *v) for k, v in state.items()], key=repr)


def feed(seed, n):
    rng = random.Random(seed)
    data = []
    for seq in range(n):
        k = rng.choice([1, 1, 1, 2, 3, 4, None])
        op = rng.choice(["insert", "update_postimage", " Update_Postimage", "update_postimage", "delete", "junk", "DELETE "])
        row = (k, rng.choice([None, 1, 2]), rng.choice([None, "a", "b"]), op, seq)
        data += [row] * rng.choice([1, 1, 2]) + ([(k, 0, "old", "update_preimage", seq)] if "pdate" in op else [])
    rng.shuffle(data)
    return data


@pytest.mark.parametrize("partial", [False, True])
def test_replay_against_a_state_machine(spark, partial):
    data = [(k + 10 * s if k else k, *r) for s in range(6) for k, *r in feed(s, 40)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # many runs of one key
    try:
        got = rows(replay(spark.createDataFrame(data, CHANGES), ["k"], "seq", "op", ["x", "y"], partial))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == machine(data, partial)


def test_replay_goes_on_from_a_state(spark):
    base = spark.createDataFrame([(1, 5, "a", 10), (2, 6, "b", 10)], "k int, x int, y string, seq long")
    new = spark.createDataFrame([(1, None, "z", "update_postimage", 11), (2, 9, "q", "insert", 9), (3, 1, None, "insert", 1)], CHANGES)
    assert rows(replay(new, ["k"], "seq", "op", ["x", "y"], True, base)) == [(1, 5, "z", 11), (2, 6, "b", 10), (3, 1, None, 1)]
    assert rows(replay(new.limit(0), ["k"], "seq", "op", ["x", "y"])) == []


def test_stream_of_changes(spark, tmp_path):
    data = feed(3, 30)
    src = tmp_path / "src"
    for i in range(0, len(data), 25):
        spark.createDataFrame(data[i : i + 25], CHANGES).coalesce(1).write.mode("append").parquet(str(src))
    a = ChangeApplier(spark, str(tmp_path / "t"), ["k"], "seq", "op", ["x", "y"])
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 2).parquet(str(src))
    a.start(stream, str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert rows(a.records().select("k", "x", "y", "seq")) == machine(data, False)
    before = rows(a.records())
    a.apply(spark.createDataFrame(data[:25], CHANGES))  # the same once more
    assert rows(a.records()) == before


# ---------------------------------------------------------------- history


@pytest.mark.parametrize("max_rows", [4, 200_000])
def test_history_against_brute_force(spark, max_rows):
    rng = random.Random(2)
    day = lambda n: None if n is None else f"2020-01-{n:02d} 00:00:00"
    snap = [(rng.choice([1, 2, 3, None]), rng.choice(["A", "B", None]), a, rng.choice([None, a + rng.randint(1, 4)])) for a in (rng.randint(1, 20) for _ in range(25))]
    snap = list({(k, a): (k, v, a, e) for k, v, a, e in snap}.values())
    ups = [(i, rng.choice([1, 1, 1, 4, None]), rng.choice(["A", "B", None]), rng.randint(1, 25)) for i in range(40)]
    said = {}
    for k, _, _, e in snap:
        if e:
            said[k, e] = (0, None)
    for k, v, a, _ in snap:
        said[k, a] = (1, v)
    for _, k, v, a in ups:
        said[k, a] = (1, v)
    want, last = [], {}
    for (k, t), s in sorted(((x, s) for x, s in said.items() if x[0] is not None)):
        if k in last and last[k][1] == s:
            continue
        if k in last and last[k][1][0]:
            want.append((k, last[k][1][1], day(last[k][0]), day(t), False))
        last[k] = (t, s)
    want += [(k, s[1], day(t), None, True) for k, (t, s) in last.items() if s[0]]
    ts = lambda c: F.to_timestamp(c)
    s = spark.createDataFrame([(k, v, day(a), day(e)) for k, v, a, e in snap], "pkey int, attr string, a string, e string").select("pkey", "attr", ts("a").alias("effective_time"), ts("e").alias("end_time"))
    u = spark.createDataFrame([(i, k, v, day(a)) for i, k, v, a in ups], "update_no long, pkey int, attr string, a string").select("update_no", "pkey", "attr", ts("a").alias("effective_time"))
    got = islands(statements(s.union(s), u.union(u)), max_rows=max_rows).withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("effective_time", "end_time")})
    assert rows(got) == sorted(want, key=repr)
    assert rows(islands(statements(s.limit(0), u.limit(0)))) == []


# ---------------------------------------------------------------- incremental


def test_due_changes_against_brute_force(spark):
    rng = random.Random(4)
    data = [(rng.choice(["t", "u", None]), rng.choice([1, 2, None]), rng.randint(0, 40), rng.choice([None, *range(1, 60)])) for _ in range(400)]
    runs = [(rng.choice(["t", "u"]), a, a + rng.randint(-2, 15), rng.choice(["succeeded", " Succeeded", "failed", "running", None]), rng.randint(1, 60)) for a in (rng.randint(0, 40) for _ in range(30))] + [("t", None, 5, "succeeded", 50), ("u", 3, None, "succeeded", 9)]
    taken = lambda t, v, at: at is not None and any(r[0] == t and r[1] is not None and r[2] is not None and r[1] <= v <= r[2] and (r[3] or "").strip().lower() == "succeeded" and at <= r[4] for r in runs)
    groups = defaultdict(bool)
    for t, i, v, at in data:
        if t is not None and i is not None:
            groups[t, i, v] |= taken(t, v, at)
    sec = lambda c: F.timestamp_seconds(c).alias(c)
    d = spark.createDataFrame(data, "table_path string, id int, _commit_version long, landed_at int").select("table_path", "id", "_commit_version", sec("landed_at"))
    r = spark.createDataFrame(runs, "table_path string, startingVersion long, endingVersion long, status string, started_at int").select("table_path", "startingVersion", "endingVersion", "status", sec("started_at"))
    assert rows(due_changes(d, r)) == sorted([k for k, t in groups.items() if not t], key=repr)
    assert len(rows(due_changes(d, r.limit(0)))) == len(groups) and rows(due_changes(d.limit(0), r)) == []


def test_tracker(spark, tmp_path):
    one = spark.createDataFrame([("t", i, f"v{i}") for i in range(100)] + [("t", None, "lost"), (None, 1, "lost")], "t string, n long, v string")
    m = MerkleTracker(spark, str(tmp_path / "m"), ["t"], "n", width=10)
    p = m.pending(one)
    assert p.due.count() == 100 and p.generation == -1  # a run that fails here has taken nothing
    assert m.run(one).count() == 100 and m.run(one).count() == 0
    two = one.filter("n is null or n <> 7").union(spark.createDataFrame([("t", 7, "changed"), ("t", 500, "new"), ("u", 1, "new")], one.schema))
    late = m.pending(one.filter("n < 50"))
    want = [("t", 500, "new"), ("t", 7, "changed"), ("u", 1, "new")]
    assert rows(m.run(two)) == want
    with pytest.raises(ConcurrentCommitError):
        m.publish(late)  # another run was first
    assert rows(m.output(2)) == want and m.removed(2).count() == 1  # and what it published is as it was
    assert m.run(two).count() == 0 and m.generation() == 3
    assert rows(MerkleTracker(spark, str(tmp_path / "n"), ["t"], "n").run(one.limit(0))) == []


def test_tracker_survives_a_crash_while_publishing(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("t", i) for i in range(40)], "t string, n long")
    m = MerkleTracker(spark, str(tmp_path / "m"), ["t"], "n", width=4)
    m.run(df.filter("n < 20"))

    def fail(*_):
        raise OSError("gone")

    monkeypatch.setattr(m.files, "create", fail)
    with pytest.raises(OSError):
        m.run(df)
    monkeypatch.undo()
    assert m.generation() == 0 and sorted(r[1] for r in rows(m.run(df))) == list(range(20, 40))


def test_tracker_merges_folders_and_reports_what_went(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "MERGE_AFTER", 2)
    frame = lambda some: spark.createDataFrame([("t", i) for i in some], "t string, n long")
    m = MerkleTracker(spark, str(tmp_path / "m"), ["t"], "n", width=4, copies=False)
    assert [len(rows(m.run(frame(x)))) for x in (range(20), range(24), [*range(28), 27], range(10))] == [20, 4, 4, 0]
    assert [m.removed(g).count() for g in (2, 3)] == [0, 18]


def test_tracker_delivers_reverts_and_added_copies(spark, tmp_path):
    frame = lambda data: spark.createDataFrame([("t", 5, "same", None), *data], "t string, n long, v string, w string")
    m = MerkleTracker(spark, str(tmp_path / "m"), ["t"], "n", width=10)
    due = lambda *data: rows(m.run(frame(data)))
    a, b = ("t", 7, "A", None), ("t", 7, "B", None)
    assert due(a) == [("t", 5, "same", None), a]
    assert due(b) == [b] and due(a) == [a]  # A -> B -> A
    assert due(a, a, a) == [a, a] and due() == []  # copies added, all taken away
    assert due(("t", 7, None, "A"), ("t", 700, "far", None)) == [("t", 7, None, "A"), ("t", 700, "far", None)]
    assert due(a) == [a]  # a value that moves to another column


# ---------------------------------------------------------------- files


def test_live_and_small_files(spark):
    data = [
        ("t", 0, "add", "a", {"country": "X"}, 10, 1), ("t", 0, "add", "a", {"country": "X"}, 10, 1), ("t", 1, "remove", "a", {}, None, None), ("t", 2, "add", "a", {"country": "X"}, 12, -1), ("t", 0, "add", "b", {"country": "X"}, 5, None),
        ("t", 0, "add", "c", {"country": "x"}, 5, 5), ("t", 0, "add", "d", {"country": "X"}, None, 5), ("t", 0, "add", "e", {"country": "X"}, -1, 5), ("t", 0, "add", "f", {"country": "X"}, 16_777_216, 5),
        ("t", 0, "add", "g", {"gender": None, "country": "X"}, 1, 1), ("t", 3, "add", "h", {"country": "X", "gender": None}, 2, 1), ("t", 0, "remove", "i", {}, 1, 1), ("u", 0, "add", "j", None, 1, 1), ("t", 0, "add", None, {}, 1, 1),
    ]
    df = spark.createDataFrame(data, "table_path string, version long, action string, path string, partitionValues map<string,string>, size long, numRecords long")
    live = live_files(df)
    assert rows(live.filter("path = 'a'")) == [("t", "country=X", "a", 12, None)]
    assert {r["path"]: r["part"] for r in live.collect()} == {"a": "country=X", "b": "country=X", "c": "country=x", "d": "country=X", "e": "country=X", "f": "country=X", "g": "country=X/gender=null", "h": "country=X/gender=null", "j": ""}
    assert sorted(r["path"] for r in small_files(live).collect()) == ["a", "b", "g", "h"]
    assert rows(small_files(live.limit(0))) == []


def test_bins(spark):
    rng = random.Random(6)
    files = spark.createDataFrame([("t", "p", f"f{i}", rng.randint(1, 40), 3) for i in range(500)] + [("t", "q", "x", 5, None), ("t", "q", "y", 5, 2)], "table_path string, part string, path string, size long, numRecords long")
    for limit in (20_000, 100):
        bins = plan_bins(files, target=100, max_files=limit)
        assert bins.count() == 502 and bins.groupBy("part", "bin").agg(F.sum("size").alias("s")).agg(F.max("s")).first()[0] < 140
        r = {x["part"]: x for x in bin_report(bins).collect()}
        assert r["p"]["files_before"] == 500 and r["p"]["num_records"] == 1500 and r["p"]["files_after"] <= r["p"]["size_in_bytes"] / 60 and r["q"]["files_after"] == 1
