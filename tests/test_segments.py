"""Landed frames: cursors for offsets, one task a slice, each frame once over stops and restarts."""

import json

import pytest
from pyspark.sql import functions as F

from kithgraph.sources import frames, segments
from kithgraph.streaming.eventstore import EventStore
from kithgraph.streaming.streams import drained
from tests.test_eventstore import folded, rows, some_frames


def sliced(lines):
    return [(x, "likes" if frames.LIKE in x else "rest") for x in lines if x.startswith("{") and "time_us" in x]


def landed(spark, tmp_path, lines, tasks=3):
    segments.land(spark.createDataFrame(sliced(lines), "value string, slice string"), f"{tmp_path}/in", tasks)


def taken(spark, tmp_path, **options):
    """Frames that a run of the stream takes in, by trigger."""
    seen = []
    drained(segments.landed_stream(spark, f"{tmp_path}/in", **options), lambda b, n: seen.append((n, b.rdd.getNumPartitions(), [tuple(r) for r in b.collect()])), f"{tmp_path}/state")
    return seen


def test_stop_and_restart_gives_each_frame_once(spark, tmp_path):
    lines = some_frames(240, 4)
    landed(spark, tmp_path, lines[:150])
    first = taken(spark, tmp_path)
    assert len(first) == 1 and first[0][1] == 2
    assert taken(spark, tmp_path) == []
    landed(spark, tmp_path, lines[150:])
    later = taken(spark, tmp_path)
    got = [r for _, _, own in first + later for r in own]
    assert sorted(r[0] for r in got) == sorted(x for x, _ in sliced(lines)) and {r[2] for r in got} == {"likes", "rest"}
    assert [n for n, _, _ in later] == [1] and taken(spark, tmp_path) == []


def test_start_and_slices(spark, tmp_path):
    lines = some_frames(120, 6)
    landed(spark, tmp_path, lines)
    times = sorted(json.loads(x)["time_us"] for x, s in sliced(lines) if s == "likes")
    start = times[len(times) // 2]
    got = [r for _, _, own in taken(spark, tmp_path, slices=["likes"], start=start) for r in own]
    assert sorted(r[1] for r in got) == [t for t in times if t >= start]
    batch = spark.read.format("frames").option("path", f"{tmp_path}/in").load()
    assert batch.count() == len(sliced(lines)) and batch.rdd.getNumPartitions() == 2
    assert spark.read.format("frames").option("path", f"{tmp_path}/in").option("start", start).option("slices", "likes").load().count() == len(got)


def test_a_store_over_landed_frames(spark, tmp_path):
    """The low watermark and replay start come from the slices' own cursors."""
    lines = some_frames(200, 7)
    landed(spark, tmp_path, lines[:120])
    store = EventStore(spark, f"{tmp_path}/store", ["likes", "rest"], 2)
    run = lambda: store.ingest(segments.landed_stream(spark, f"{tmp_path}/in").drop("time_us"), f"{tmp_path}/state")
    run()
    low = store.watermark()
    assert low == min(max(json.loads(x)["time_us"] for x, s in sliced(lines[:120]) if s == name) for name in ("likes", "rest"))
    landed(spark, tmp_path, lines[120:])
    run()
    assert {k: rows(v) for k, v in store.tables().items()} == folded(spark, [x for x, _ in sliced(lines)]) and store.watermark() > low


def test_unordered_and_foreign_input(spark, tmp_path):
    assert segments.cursor_of("no json") is None and segments.cursor_of("[1]") is None and segments.cursor_of('{"time_us":"7"}') == 7
    with pytest.raises(ValueError):
        segments.local("hdfs://x/y")
    df = spark.createDataFrame([('{"time_us":5}', "a"), ('{"time_us":4}', "a")], "value string, slice string").coalesce(1)
    segments.register(spark)
    with pytest.raises(Exception, match="order of time"):
        df.select("value", F.lit(0).cast("long").alias("time_us"), "slice").write.format("frames").mode("append").option("path", f"{tmp_path}/x").save()
    assert not [f for f in (tmp_path / "x" / "a").iterdir() if not f.name.startswith(".")]


def test_segments_appear_in_order_of_time(tmp_path, monkeypatch):
    """Whatever order the tasks end in, a stream that looks between two renames misses nothing."""
    writer, seen = segments.Writer({"path": str(tmp_path)}), []
    parts = [writer.write([{"value": json.dumps({"time_us": t}), "slice": "a"} for t in range(k, k + 10)]) for k in (120, 9, 1000, 30)]
    real = segments.os.rename
    monkeypatch.setattr(segments.os, "rename", lambda a, b: (real(a, b), seen.append([f[0] for f in segments.Segments({"path": str(tmp_path)}).files("a")])))
    writer.commit([parts[0], None, *parts[1:]])
    assert seen == [[9], [9, 30], [9, 30, 120], [9, 30, 120, 1000]]
    writer.abort([writer.write([{"value": '{"time_us":1}', "slice": "a"}])])
    assert len(list((tmp_path / "a").iterdir())) == 4
