import os
import threading
import time

import pytest

from cairn.operators import store
from cairn.streaming.deltas import stream_deltas


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_reader_keeps_the_old_snapshot(spark, tmp_path):
    one, two, path = spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(2,), (3,)], "id long"), str(tmp_path / "p")
    assert store.publish(one, path) == 1
    with pytest.raises(FileExistsError):
        store.publish(two, path)
    held = store.read_published(spark, path)
    assert store.publish(two, path, replace=True) == 2
    assert [r.id for r in held.collect()] == [1]
    assert sorted(r.id for r in store.read_published(spark, path).collect()) == [2, 3]
    assert store.retire(spark, path, 3600) == []
    assert len(store.retire(spark, path, -1)) == 1 and store.retire(spark, path, -1) == []
    assert sorted(r.id for r in store.read_published(spark, path).collect()) == [2, 3]
    (tmp_path / "p" / "config.json").write_text("{}")
    assert "config.json" not in store.reset(spark, path, ["config.json"]) and os.listdir(path) == ["config.json"]
    with pytest.raises(FileNotFoundError):
        store.read_published(spark, path)


def test_of_two_racing_writers_one_loses_cleanly(spark, tmp_path):
    path, done = str(tmp_path / "p"), []
    store.publish(spark.createDataFrame([(0,)], "id long"), path)

    def write(n):
        try:
            done.append((n, store.publish(spark.createDataFrame([(n,)], "id long"), path, replace=True, seen=1)))
        except store.Lost:
            done.append((n, None))

    threads = [threading.Thread(target=write, args=(n,)) for n in (1, 2, 3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    won = [n for n, number in done if number]
    assert len(won) == 1 and [r.id for r in store.read_published(spark, path).collect()] == won
    assert len([d for d in os.listdir(path) if d.startswith("data-")]) == 2 and store.manifest(spark, path)["number"] == 2


def test_slices_that_do_not_change_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c d", 3), (None, 4)], "project string, v int")
    store.publish_slices(rows.where("project is not null"), path, "project")
    before = files_of(path)
    held = store.read_published(spark, path)
    assert store.publish_slices(spark.createDataFrame([("b", 7), ("b", 8), ("e", 9)], rows.schema), path, "project", gone=["c d"]) == 2
    after = files_of(path)
    assert {k: v for k, v in after.items() if k in before} == before
    assert sorted((r.project, r.v) for r in store.read_published(spark, path).collect()) == [("a", 1), ("b", 7), ("b", 8), ("e", 9)]
    assert sorted(r.v for r in held.collect()) == [1, 2, 3]


def test_two_makers_of_one_key(spark, tmp_path):
    root, made = str(tmp_path), []

    def late():
        """Another maker comes first while this one is at work."""
        if not made:
            made.append(store.materialise(spark, root, "t", "k", lambda: spark.createDataFrame([(1,)], "id long")))
        return spark.createDataFrame([(2,)], "id long")

    table, hit = store.materialise(spark, root, "t", "k", late)
    assert not hit and [r.id for r in table.collect()] == [r.id for r in made[0][0].collect()] == [1]
    assert store.materialise(spark, root, "t", "k", lambda: 1 / 0)[1]
    assert len([d for d in os.listdir(tmp_path / "t") if d.startswith("made-")]) == 1


def test_versions_outside_the_window(spark, tmp_path):
    path = str(tmp_path / "v")
    with pytest.raises(ValueError):
        store.publish(spark.range(1), path, version=4)
    store.publish(spark.range(1), path, version=5)
    assert store.read_published(spark, path).count() == 1


def test_input_hash_changes_with_content_alone(spark):
    rows = [("p", f"f{i}", f"h{i % 9}") for i in range(40)]
    of = lambda rs: {r.project: r.hash for r in store.input_hash(spark.createDataFrame(rs, "project string, path string, content_hash string")).collect()}
    assert of(rows) == of(rows[::-1]) != of([("p", "f0", "other"), *rows[1:]])


def test_a_lost_snapshot_stops_the_stream(spark, tmp_path):
    schema, ck = "id long, v string", tmp_path / "ck"

    def go(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.01)
        stream_deltas(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "id", str(tmp_path / "out"), str(ck)).awaitTermination()

    go([(1, "a")])
    os.rename(ck / "snapshots" / "epoch=0", tmp_path / "gone")
    with pytest.raises(Exception, match="snapshot of epoch 0"):
        go([(1, "a"), (2, "b")])
