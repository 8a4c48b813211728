"""Imports, snapshot writes and the maintenance stages on hand-made rows."""

import random

from pyspark.sql import functions as F

from tessera.operators import consolidate, write
from tessera.operators.scope import Scope
from tessera.sources import jsonl
from tessera.sources.views import NOW_H, view

F_SCHEMA = "id long, key_id string, content_hash string, importance double, is_anchor boolean, created_h long, valid_to_h long, access_count long, accessed_h long, topic string, workspace string"


def rows(spark, *given):
    return spark.createDataFrame([(i, k, h, imp, anchor, c, None, 1, None, "t", ws) for i, k, h, imp, anchor, c, ws in given], F_SCHEMA)


def test_jsonl_round_trip(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"id": "a", "content": "x", "topic": "t"}\nnot json\n{"content": "no topic"}\n{"content": "y", "topic": "t", "importance": 0.9}\n{"id": "a", "content": "again", "topic": "t"}\n')
    good, bad = jsonl.read(spark, str(tmp_path / "in.json"))
    assert good.count() == 2 and bad.count() == 2
    known = good.where("id = 'a'").select("id")
    assert jsonl.read(spark, str(tmp_path / "in.json"), known)[0].count() == 1
    jsonl.write(good, str(tmp_path / "out"), confirm_full=True)
    assert jsonl.read(spark, str(tmp_path / "out"))[0].count() == 2


def test_logs_join_continuations(spark, tmp_path):
    (tmp_path / "a.log").write_text("2024-01-01 10:00:00 [error]: boom\n  at x\n2024-01-01 10:00:01 [info]: fine\n")
    got = jsonl.logs(spark, str(tmp_path / "a.log"), level="ERROR").collect()
    assert [(r.at, r.message) for r in got] == [("2024-01-01 10:00:00", "boom\n  at x")]


def test_upsert_and_quota(spark):
    old = rows(spark, (1, "k", "h", 0.2, False, 5, None), (2, "k", "g", 0.2, False, 5, None))
    new = rows(spark, (7, "k", "h", 0.9, True, 6, None), (8, None, "h", 0.1, False, 6, None))
    got = {r.id: (r.importance, r.is_anchor) for r in write.upsert(old, new).collect()}
    assert got == {1: (0.9, True), 2: (0.2, False), 8: (0.1, False)}
    limits = spark.createDataFrame([("k", 3)], "key_id string, quota long")
    more = rows(spark, (10, "k", "a", 0.1, False, 9, None), (11, "k", "b", 0.1, False, 8, None), (12, "z", "c", 0.1, False, 8, None))
    assert {r.id for r in write.within_quota(more, old, limits).collect()} == {11, 12}


def test_amend_delete_touch_link(spark):
    f = rows(spark, (1, "k", "h", 0.2, False, 5, None), (2, "k", "g", 0.4, False, 5, None))
    after, before, _ = write.amend(f, spark.createDataFrame([(1, 0.7)], "id long, importance double"), ["importance"])
    assert {r.id: r.importance for r in after.collect()} == {1: 0.7, 2: 0.4} and [r.importance for r in before.collect()] == [0.2]
    links = spark.createDataFrame([(1, 2, "related", 1.0), (2, 3, "related", 1.0)], "from_id long, to_id long, relation_type string, weight double")
    left, edges = write.delete(f, links, spark.createDataFrame([(1,)], "id long"))
    assert left.count() == 1 and [(r.from_id, r.to_id) for r in edges.collect()] == [(2, 3)]
    assert {r.id: (r.access_count, r.accessed_h) for r in write.touch(f, spark.createDataFrame([(1, 9), (1, 8)], "id long, at_h long")).collect()} == {1: (3, 9), 2: (1, None)}
    new = spark.createDataFrame([(1, 2, "caused_by", 0.5)], links.schema)
    assert {(r.from_id, r.to_id): (r.relation_type, r.weight) for r in write.link(links, new).collect()} == {(1, 2): ("caused_by", 1.0), (2, 3): ("related", 1.0)}
    gone = {r.id: (r.importance, r.valid_to_h) for r in write.supersede(f, spark.createDataFrame([(2, 1)], "old long, new long"), 50).collect()}
    assert gone == {1: (0.2, None), 2: (0.2, 50)}


def test_workspace_inference(spark):
    f = rows(spark, *((i, "k", str(i), 0.5, False, 1, "w") for i in range(4)), (9, "k", "9", 0.5, False, 1, None))
    assert write.infer_workspace(f).where("workspace = 'w'").count() == 5


def test_maintenance_stages(spark, sf):
    s = consolidate.Snapshot(view(spark, sf, "fragments").drop("keywords"), view(spark, sf, "links"), view(spark, sf, "vectors"), NOW_H)
    after, report = consolidate.run(s)
    assert [r["stage"] for r in report] == [n for n, _ in consolidate.STAGES] and not any(r["error"] for r in report)
    counts = {r["stage"]: r["fragments"] for r in report}
    places = list(counts)
    for before, stage in zip(places, places[1:]):  # only splitting adds rows
        assert counts[stage] > counts[before] if stage == "split_long_fragments" else counts[stage] <= counts[before], stage
    assert counts["expired_delete"] <= counts["ttl_transition"] and counts["merge_duplicates"] < counts["split_long_fragments"]
    assert after.fragments.where(F.col("is_anchor")).count() >= s.fragments.where("is_anchor").join(after.fragments.select("id"), "id", "left_semi").count()
    bad = consolidate.run(s, [("broken", lambda s: 1 / 0), *consolidate.STAGES[:1]])[1]
    assert bad[0]["error"] and not bad[1]["error"]
    assert Scope().apply(after.fragments).count() > 0


def test_assertion_candidates_by_places(spark):
    """the ten newest of a week by places, not by pairs; the row itself, tenants of null, equal hours and the window's ends."""
    rng = random.Random(21)
    rows = [(i, rng.choice(["t", "u", None]), rng.choice(["k", None]), rng.randrange(0, 900, rng.choice([1, 84])), rng.choice([None, None, 5]), rng.choice(["observed", "verified"]), " ".join(rng.sample("abcdef", 4))) for i in range(400)]
    f = spark.createDataFrame(rows, "id long, topic string, key_id string, created_h long, valid_to_h long, assertion_status string, content string")
    want = {}
    for a in rows[::5]:
        near = sorted((b for b in rows if b[1] is not None and b[1] == a[1] and b[2] == a[2] and b[0] != a[0] and b[4] is None and abs(b[3] - a[3]) <= 168), key=lambda b: (-b[3], b[0]))[:10]
        like = [b for b in near if len(set(a[6].split()) & set(b[6].split())) / len(set(a[6].split()) | set(b[6].split())) > 0.5]
        want[a[0]] = ("inferred" if any(b[5] == "verified" for b in like) else "observed", sorted(b[0] for b in like))
    got = write.assertion_status(f, f.where("id % 5 = 0"), floor=0.5)
    assert {r.id: (r.status, r.candidates) for r in got.collect()} == want
