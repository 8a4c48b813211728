"""The log source: splits, tails, filters, statistics, and a stream over files that grow."""

import random

import pytest

from tessera.sources import logs


def made(n, seed=0):
    rng = random.Random(seed)
    lines, want = ["a line of no record"], []
    for i in range(n):
        level = rng.choice(["info", "WARN", "error"])
        text = [f"message {i} é" + "x" * rng.choice([0, 5, 300])] + [f"  at step {k}" for k in range(rng.choice([0, 0, 3]))]
        lines += [f"2024-01-0{1 + i % 3} 10:00:{i % 60:02d} [{level}]: {text[0]}", *text[1:], *([""] if rng.random() < 0.2 else [])]
        want.append((level.lower(), "\n".join(text)))
    return lines, want


@pytest.fixture
def source(spark):
    spark.dataSource.register(logs.LogSource)
    return spark.read.format("applog")


def test_splits_lose_and_double_nothing(source, tmp_path):
    lines, want = made(60)
    (tmp_path / "a.log").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.log").write_text("2024-01-01 [info]: alone")
    (tmp_path / "_temporary").write_text("2024-01-01 [info]: hidden")
    for split in (7, 64, 1000, 1 << 20):
        got = source.option("split", split).load(str(tmp_path)).orderBy("file", "pos").collect()
        assert [(r.level, r.message) for r in got] == [*want, ("info", "alone")]
    assert len({r.pos for r in got[:-1]}) == 60 and got[-1].at == "2024-01-01"
    assert source.load(f"file://{tmp_path}/b.log").count() == 1


def test_tail_filters_and_statistics(source, tmp_path, monkeypatch):
    monkeypatch.setattr(logs, "CHUNK", 64)
    lines, want = made(200, 3)
    path = tmp_path / "a.log"
    path.write_text("\n".join(lines))
    whole = source.load(str(path))
    for n in (1, 5, 33):
        last = [x for x in lines if x.strip()][-n:]
        heads = sum("]: " in x for x in last)
        got = source.option("tail", n).load(str(path)).orderBy("pos").collect()
        assert [(r.level, r.message) for r in got] == (want[-heads:] if heads else [])
    assert source.option("tail", 10**6).load(str(path)).count() == 200
    source.option("tail", 0)
    assert logs.selected(whole, "ERROR", "MESSAGE 1").count() == sum(level == "error" and "message 1" in m for level, m in want)
    from pyspark.sql import functions as F

    by = {r.level: r for r in logs.statistics(whole, F.lit("2024-01-02")).collect()}
    assert {k: r.n for k, r in by.items()} == {k: sum(x == k and i % 3 == 1 for i, (x, _) in enumerate(want)) for k in by}
    assert len(logs.recent_errors(whole, 4).collect()) == 4


def test_stream_gives_each_record_once(spark, source, tmp_path):
    folder, out, saved = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    folder.mkdir()
    path = folder / "a.log"

    def run():
        stream = spark.readStream.format("applog").load(str(folder))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", saved).trigger(availableNow=True).start().awaitTermination(120)
        return sorted((r.pos, r.message) for r in spark.read.schema(logs.SCHEMA).parquet(out).collect())

    path.write_text("2024-01-01 [info]: one\n  more of one\n2024-01-01 [info]: two\n")
    assert [m for _, m in run()] == ["one\n  more of one"]
    with path.open("a") as f:
        f.write("  more of two\n2024-01-01 [error]: three\n2024-01-01 [info]: four")
    assert [m for _, m in run()] == ["one\n  more of one", "two\n  more of two", "three"]
    assert len(run()) == 3
