"""Streams with timers, of two sides and into snapshots: equal to the batch, whatever comes twice or late."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lexmill.streaming import idle, indexing, pairing

START = dt.datetime(2024, 1, 1)


def _at(seconds):
    return START + dt.timedelta(seconds=seconds)


def _stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(folder))


def _run(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"check-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert not q.exception()
    return q


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_idle_gaps_by_timers_equal_the_batch(spark, tmp_path, rocks):
    rng = random.Random(1)
    rows = [(u, _at(t)) for u in range(5) for t in sorted(rng.sample(range(0, 20_000), 30))] + [(9, _at(50)), (9, _at(50))]
    rows.sort(key=lambda r: r[1])
    batches = [rows[i : i + 40] for i in range(0, len(rows), 40)]
    for b in batches[1:]:  # some come late, within the watermark
        k = batches.index(b)
        if b[0][1] - batches[k - 1][-1][1] < dt.timedelta(seconds=300):
            batches[k - 1][-1], b[0] = b[0], batches[k - 1][-1]
    batches.append([(99, _at(40_000))])  # moves the watermark past all
    for i, b in enumerate(batches):
        spark.createDataFrame(b, "user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b{i:02}"))
    stream = spark.readStream.schema("user_id long, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    _run(idle.idle_gaps(stream, 600), tmp_path, "gaps")
    got = sorted((r.user_id, r.since, r.due) for r in spark.table("gaps").where("user_id < 99").collect())
    whole = spark.createDataFrame([r for b in batches for r in b], "user_id long, ts timestamp")
    want = sorted((r.user_id, r.since, r.due) for r in idle.idle_gaps(whole, 600).where("user_id < 99").collect())
    assert got == want and len(want) > 20 and (9, _at(50), _at(650)) in want


def test_paired_streams_equal_the_batch(spark, tmp_path, rocks):
    rng = random.Random(2)
    began = [(f"c{i}", _at(60 * i)) for i in range(40)]
    ended = [(f"c{i}", _at(60 * i + rng.choice([5, 600, 3599, 3600, 3601]))) for i in range(0, 40, 2)] + [("lost", _at(1000))]
    began += began[:5]
    ended += ended[:3] * 2
    end = [("last", _at(90_000))]
    for name, rows, column in (("a", began, "began_at"), ("b", ended, "ended_at")):
        for i, part in enumerate((rows[:20], rows[20:], end)):
            spark.createDataFrame(part, f"call string, {column} timestamp").coalesce(1).write.parquet(str(tmp_path / name / str(i)))
    read = lambda n, c: spark.readStream.schema(f"call string, {c} timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / n))
    _run(pairing.paired(read("a", "began_at"), read("b", "ended_at"), ["call"]), tmp_path, "pairs")
    key = lambda r: (r.call, str(r.began_at), str(r.ended_at), r.state)
    got = sorted(map(key, spark.table("pairs").where("call <> 'last'").collect()))
    batch = pairing.paired(spark.createDataFrame(began, "call string, began_at timestamp"), spark.createDataFrame(ended, "call string, ended_at timestamp"), ["call"])
    want = sorted(map(key, batch.collect()))
    assert got == want and {x[3] for x in want} == {"done", "running", "unknown start"}


def test_snapshots_ignore_replayed_batches(spark, tmp_path):
    run = indexing.upserting(spark, str(tmp_path / "index"))
    held = indexing.Snapshots(spark, str(tmp_path / "index"))
    files = lambda *rows: spark.createDataFrame([(p, _at(t), x) for p, t, x in rows], "path string, modified timestamp, text string")
    state = lambda: (sorted((r.path, r.sha256) for r in held.documents().collect()), sorted((r.path, r.ordinal, r.body) for r in held.chunks().collect()))
    assert held.committed() == [] and state() == ([], [])
    run(files(("a", 1, "one\ntwo"), ("b", 1, "x"), ("b", 2, "y"), ("c", 1, None)), 0)
    first = state()
    assert [c[0::2] for c in first[1]] == [("a", "one\ntwo"), ("b", "y")] and len(first[0]) == 3
    run(files(("a", 9, "other")), 0)
    assert state() == first
    run(files(("a", 3, "changed"), ("b", 4, "y"), ("d", 1, "new")), 1)
    second = state()
    assert [c[0::2] for c in second[1]] == [("a", "changed"), ("b", "y"), ("d", "new")]
    run(files(("a", 3, "changed"), ("b", 4, "y"), ("d", 1, "new")), 1)
    run(files(), 2)
    assert state() == second and held.committed() == [0, 1, 2]
    # a batch that wrote its tables but failed before it was committed
    held.spark.range(1).write.parquet(str(tmp_path / "index" / "snapshot-3" / "documents"))
    assert state() == second
    held.prune()
    assert state() == second
    for i, rows in enumerate(([("e", _at(1), "stream")], [("a", _at(9), "again")])):
        spark.createDataFrame(rows, "path string, modified timestamp, text string").coalesce(1).write.parquet(str(tmp_path / "files" / str(i)))
    stream = spark.readStream.schema("path string, modified timestamp, text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "files"))
    q = stream.writeStream.foreachBatch(indexing.upserting(spark, str(tmp_path / "streamed"))).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    assert sorted(r.path for r in indexing.Snapshots(spark, str(tmp_path / "streamed")).documents().collect()) == ["a", "e"]
