"""The embedding queue with retries, dead letters and a replayed batch; first sights of a stream."""

import json
import time

import numpy as np
import pytest

from tessera.operators import ivf
from tessera.streaming import embedding, queues

pytest.importorskip("google.protobuf")


def put(folder, name, rows):
    (folder / f"{name}.tmp").write_text("\n".join(json.dumps(r) for r in rows))
    (folder / f"{name}.tmp").rename(folder / f"{name}.json")


def test_waits_double():
    assert [embedding.wait_ms(n) for n in (1, 2, 3, 20)] == [1000, 2000, 4000, 60_000]


def test_embedding_queue(spark, tmp_path):
    def vector(text):
        """A plain stand-in for a model: fails on demand."""
        if "never" in text:
            raise ValueError("no such input")
        return np.array([len(text), text.count("a") + 1.0, 1.0])

    stored = spark.createDataFrame([(100 + i, [float(i), 1.0, 1.0]) for i in range(1, 30)], "id long, embedding array<double>")
    index = ivf.build(stored, str(tmp_path / "index"))
    source = tmp_path / "in"
    source.mkdir()
    put(source, "a", [{"id": 1, "content": "banana", "at": 1}, {"id": 1, "content": "a longer banana", "at": 2}, {"id": 2, "content": "never works", "at": 1}, {"id": 3, "content": "  ", "at": 1}])
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out, saved = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def start(sink):
        queue = spark.readStream.schema("id long, content string, at long").json(str(source))
        return embedding.ready(queue, vector).writeStream.foreachBatch(sink).option("checkpointLocation", saved).trigger(processingTime="1 second").start()

    sink, calls = embedding.linked(index, out), []

    def crashes(df, batch_id):
        calls.append(batch_id)
        sink(df, batch_id)
        if len(calls) == 1:
            raise RuntimeError("the driver is lost after the batch was written")

    try:
        first = start(crashes)
        with pytest.raises(Exception):
            first.awaitTermination(60)
        second = start(crashes)
        put(source, "b", [{"id": 4, "content": "cabana", "at": 1}])
        shapes = {"ready": "id long, embedding array<double>, attempts int", "dead": "id long, attempts int, error string", "links": "from_id long, to_id long"}
        read = lambda kind: spark.read.schema(shapes[kind]).parquet(f"{out}/{kind}/batch=*").collect() if list((tmp_path / "out" / kind).glob("batch=*/_SUCCESS")) else []
        end = time.time() + 120
        while time.time() < end and second.isActive and (len(read("dead")) < 1 or len(read("ready")) < 2):
            time.sleep(2)
        second.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert calls[:2] == [0, 0]  # the batch came again
    assert sorted((r.id, r.attempts, r.embedding[0]) for r in read("ready")) == [(1, 1, 15.0), (4, 1, 6.0)]
    assert [(r.id, r.attempts, r.error) for r in read("dead")] == [(2, 3, "no such input")]
    links = [(r.from_id, r.to_id) for r in read("links")]
    assert len(links) == len(set(links)) and {a for a, _ in links} == {1, 4} and all(100 < b < 130 for _, b in links)


def test_first_seen_of_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    schema = "session_id string, item long, ts timestamp"
    put(source, "a", [{"session_id": "s", "item": 1, "ts": "2024-01-01T00:00:00Z"}, {"session_id": "s", "item": 1, "ts": "2024-01-01T01:00:00Z"}, {"session_id": "t", "item": 1, "ts": "2024-01-01T01:00:00Z"}])
    put(source, "b", [{"session_id": "s", "item": 1, "ts": "2024-01-01T02:00:00Z"}, {"session_id": "s", "item": 2, "ts": "2024-01-01T02:00:00Z"}])
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    query = queues.first_seen(events, ["session_id", "item"], "ts").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.session_id, r["item"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("s", 1), ("s", 2), ("t", 1)]
