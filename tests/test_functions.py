"""Hand-made cases of expressions, greedy selections and stateful folds."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import scores, text, vectors
from tessera.operators import graph, greedy, knn, search
from tessera.operators.scope import Scope
from tessera.streaming import adaptive, queues, sessions


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_rrf_by_rank(spark):
    layer = lambda ids: spark.createDataFrame([(i, k + 1) for k, i in enumerate(ids)], "id string, rank int")
    got = search.rrf([(layer(["b"]), 2.0), (layer(["a", "b"]), 1.0), (layer(["b", "c"]), 1.0)]).orderBy(F.desc("rrf")).collect()
    assert [r.id for r in got][0] == "b" and {r.id for r in got} == {"a", "b", "c"} and len(got) == 3


def test_slot_trim():
    assert greedy.slot_trim([90, 20, 40], [None, "supplement", "exact"], 100) == [False, True, True]
    kept = greedy.slot_trim([40, *[10] * 6, 40], ["exact", *[None] * 6, "exact"], 100)
    assert kept[0] and not kept[-1] and sum(kept[1:7]) == 6
    assert greedy.slot_trim([60, 50, 10], [None, None, None], 100) == [True, False, False]  # no tags: a prefix
    assert greedy.slot_trim([60, 10, 20], ["exact", "exact", None], 100) == [True, True, True]  # the first exact row stops its slot, then competes
    assert greedy.slot_trim([30, 30, 40], ["exact", "supplement", None], 60) == [True, True, False]


def test_mmr_prefers_new_words():
    assert greedy.mmr_order([1.0, 0.99, 0.8], [{"a", "b"}, {"a", "b"}, {"c"}]) == [0, 2, 1]
    assert greedy.mmr_order([0.1, 0.9, 0.8, 1.0], [{"a"}, {"a"}, {"b"}, {"c"}], near=[True, True, True, False]) == [0, 2, 1, 3]
    assert greedy.mmr_order([0.1, 0.9], [{"a"}, {"b"}], near=[False, True]) == [0, 1]


def test_cursors():
    assert search.from_cursor(search.cursor(30, 7)) == (30, 7)
    assert search.from_cursor(None) == search.from_cursor("not one") == (0, None)


def test_core_memory_guarantees_types(spark):
    rows = spark.createDataFrame([("k", 1, "fact", 0.9, 10), ("k", 2, "fact", 0.8, 10), ("k", 3, "error", 0.1, 10), ("k", 4, "fact", 0.7, 10)], "owner string, id long, type string, score double, chars int")
    assert {r.id for r in greedy.core_memory(rows, {"fact": 2}).collect()} == {1, 2, 3}


def test_semantic_duplicates(spark):
    schema = "topic string, a long, b long, a_h long, b_h long, a_anchor boolean, b_anchor boolean"
    got = greedy.resolve_duplicates(spark.createDataFrame([("t", 1, 2, 5, 9, False, False), ("t", 3, 4, 1, 2, True, False), ("t", 2, 5, 9, 10, False, False)], schema)).collect()
    assert {(r.kept, r.dropped) for r in got} == {(5, 2)}  # 1 meets only 2, which is gone; 3 is an anchor


def test_scope(spark):
    f = spark.createDataFrame([(1, None, 42, 5, None), (2, "A", 99, 5, None), (3, "B", None, 5, None), (4, "A", 42, 5, 9)], "id long, workspace string, case_id long, valid_from_h long, valid_to_h long")
    ids = lambda s: {r.id for r in s.apply(f).collect()}
    assert ids(Scope(workspace="A")) == {1, 2} and ids(Scope(equal={"case_id": 42})) == {1}
    assert ids(Scope(as_of_h=8)) == {1, 2, 3, 4} and ids(Scope(as_of_h=9)) == {1, 2, 3} and ids(Scope(as_of_h=4)) == set()


def test_decay(spark):
    d = lambda imp, age, anchor=False: scores.decayed(F.lit(imp), F.lit(age), F.lit(100.0), F.lit(anchor))
    r = one(spark, a=d(0.8, 0), b=d(0.8, 100), c=d(0.8, 100_000), e=d(0.8, 100_000, True))
    assert r.a == pytest.approx(0.8) and r.b == pytest.approx(0.4) and r.c == 0.05 and r.e == 0.8


def test_overlaps(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    r = one(spark, o=scores.overlap(a("x", "y"), a("y")), e=scores.jaccard(a(), a()), j=scores.jaccard(a("x", "y"), a("y", "z")))
    assert r.o == 0.5 and r.e == 1.0 and r.j == pytest.approx(1 / 3)


def test_vectors(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    r = one(spark, c=vectors.cosine(v(1.0, 0.0), v(1.0, 1.0)), z=vectors.cosine(v(0.0, 0.0), v(1.0, 1.0)), m=vectors.cosine(v(1.0), v(1.0, 1.0)), n=vectors.l2_normalise(v(3.0, 4.0)))
    assert r.c == pytest.approx(2**-0.5) and r.z == 0 and r.m is None and r.n == [0.6, 0.8]


def test_redaction(spark):
    r = one(spark, t=text.redact(F.lit("mail a.b@c.org key sk-abcdefghijklmnop1234 password: hunter2 call 010-1234-5678")))
    assert r.t == "mail [REDACTED_EMAIL] key [REDACTED_KEY] password=[REDACTED] call [REDACTED_PHONE]"


def test_keywords(spark):
    df = spark.createDataFrame([(1, "UserService calls user_name twice, twice the cache and the cache and cache"), (2, ""), (3, None)], "id long, t string")
    got = {r.id: r.keywords for r in text.keywords(df, "id", "t").collect()}
    assert got[1][:3] == ["UserService", "user_name", "cache"] and "the" not in got[1] and got[2] == [] and got[3] == []


def test_korean_keywords_lose_particles(spark):
    df = spark.createDataFrame([(1, "서버에서 캐시를 캐시는 값이 서버까지 the Cache cache")], "id long, t string")
    assert text.keywords(df, "id", "t").first().keywords == ["서버", "캐시", "cache", "값이"]


def test_sentences_pack(spark):
    r = one(spark, p=text.packed_sentences(F.lit("One. Two! Three?\nFour"), 10))
    assert r.p == ["One. Two!", "Three?", "Four"]


def test_modalities_and_anchors(spark):
    r = one(spark, m=text.modalities(F.lit("확인해야 한다. 곧 제출할 예정이다")), a=text.missing_anchors(F.lit("v1.2 in 30% of 5"), F.lit("30% of them")))
    assert r.m == ["future", "obligation"] and r.a == ["1.2", "5"]


@pytest.mark.parametrize("phrase, day", [("3일 전", "2026-03-25"), ("1주 전", "2026-03-21"), ("3주 전", "2026-03-07"), ("2개월 전", "2026-01-28"), ("1개월 전", "2026-02-28"), ("1년 전", "2025-03-28"), ("yesterday", "2026-03-27")])
def test_dates(phrase, day):
    assert text.parse_dates(phrase, dt.date(2026, 3, 28))[0].isoformat() == day
    assert text.parse_dates("whenever", dt.date(2026, 3, 28)) is None


def test_reachability_and_cycles(spark):
    e = spark.createDataFrame([(1, 2, "caused_by"), (2, 3, "resolved_by"), (3, 1, "related"), (5, 6, "caused_by")], "from_id long, to_id long, relation_type string")
    got = {(r.root, r.id, r.depth) for r in graph.reachable(e, spark.createDataFrame([(1,)], "id long")).collect()}
    assert got == {(1, 1, 0), (1, 2, 1), (1, 3, 2)}
    assert graph.would_cycle(e, spark.createDataFrame([(3, 1), (6, 1)], "from_id long, to_id long")).count() == 1
    chains = {(r.root, r.id, r.is_resolved) for r in graph.causal_chains(e).collect()}
    assert chains == {(1, 1, True), (1, 2, True), (1, 3, True), (5, 5, False), (5, 6, False)}


def test_causal_queries_follow_long_weak_chains(spark, monkeypatch):
    from tessera.plans import core

    step = lambda a, b, kind="caused_by": (a, b, kind, 1.0)
    links = [step(100 + k, 101 + k) for k in range(24)] + [step(124, 125, "resolved_by")] + [step(200 + k, 200 + (k + 1) % 15) for k in range(15)]
    tables = {
        "links": spark.createDataFrame(links, "from_id long, to_id long, relation_type string, weight double"),
        "fragments": spark.createDataFrame([(115, "fact", "open"), (300, "fact", "open"), (301, "error", None)], "id long, type string, resolution_status string"),
    }
    monkeypatch.setattr(core, "view", lambda spark, sf_dir, name: tables[name])
    assert {(r.root, r.id, r.depth, r.is_resolved) for r in core.g06(spark, "").collect()} == {(100, 100 + k, k, True) for k in range(26)}
    assert {(r.from_id, r.to_id) for r in core.g05(spark, "").collect()} == {(a, b) for a, b, *_ in links if a >= 200}
    assert {r.id for r in core.g07(spark, "").collect()} == {300, 301}


def test_knn_blocks_agree(spark):
    import random

    rng = random.Random(4)
    v = spark.createDataFrame([(i, "t", [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)], "id long, topic string, embedding array<double>")
    key = lambda d: {(r.a, r.b) for r in d.collect()}
    assert key(knn.similar_pairs(v, 0.5, 7)) == key(knn.similar_pairs(v, 0.5, 1000)) != set()


def test_sessions():
    idle, age = sessions.IDLE_US, sessions.AGE_US
    _, seg = sessions.fold(None, [0, idle, 2 * idle + 1])
    assert seg == [1, 1, 2]
    step = idle - 1
    _, seg = sessions.fold(None, [k * step for k in range(age // step + 2)])
    assert seg[0] == 1 and seg[-1] == 2


def test_adaptive_pieces():
    assert adaptive.adapt(0.4, 49, 0.0) == 0.4 and adaptive.adapt(0.4, 50, 0.0) == 0.39 and adaptive.adapt(0.10, 90, 0.0) == 0.10 and adaptive.adapt(0.6, 90, 9) == 0.6
    assert adaptive.evict([(1, 0.9, 300), (2, 0.5, 200), (3, 0.5, 100)]) == [(1, 0.9, 300), (3, 0.5, 100)]
    assert adaptive.activation(0.0, None, 5.0) == pytest.approx(0.3 * 86_400**-0.5) and adaptive.activation(1.0, 4.5, 5.0) == pytest.approx(1.0)
    assert adaptive.adapt(0.4, 50, 8.0) == 0.4 and adaptive.adapt(0.4, 50, 8.1) == 0.41
    state, hits = (float("-inf"), 0), []
    for t in (0, 10, 900, 1800):
        state, hit = adaptive.sampled(state, t, 0.1)
        hits.append(hit)
    assert hits == [True, False, True, False]
    link = (1.9, 0.98, None, False, float("-inf"))
    (w, c, q, gone, _), done = adaptive.reconsolidate(link, "reinforce", 0)
    assert (w, c, q, gone, done) == (2.0, 1.0, None, False, True)
    quarantined, done = adaptive.reconsolidate((0.2, 0.05, None, False, float("-inf")), "quarantine", 10)
    assert done and quarantined == (0.0, 0.0, "soft", False, 10)
    assert adaptive.reconsolidate(quarantined, "decay", 69)[1] is False and adaptive.reconsolidate(quarantined, "decay", 70)[1] is True
    assert adaptive.reconsolidate(quarantined, "restore", 11)[0][:3] == (0.3, 0.05, "released")
    assert adaptive.reconsolidate((1.0, 0.5, None, True, 0.0), "reinforce", 99) == ((1.0, 0.5, None, True, 0.0), False)


def test_queue_retries_and_buries(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps({"id": i}) for i in range(5)))
    queues.drain(spark, str(src), "id long", lambda df: df.withColumn("ok", F.col("id") != 3), str(tmp_path / "done"), str(tmp_path / "dead"), str(tmp_path / "cp"))
    assert {r.id for r in spark.read.parquet(str(tmp_path / "done")).collect()} == {0, 1, 2, 4}
    assert [(r.id, r.attempts) for r in spark.read.parquet(str(tmp_path / "dead")).collect()] == [(3, 3)]


def test_stream_windows_and_segments(spark, tmp_path):
    src = tmp_path / "ev"
    rows = [("s", i, dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m), 1.0) for i, m in enumerate((0, 10, 100))]
    spark.createDataFrame(rows, "session_id string, id long, ts timestamp, value double").write.parquet(str(src))
    stream = spark.readStream.schema("session_id string, id long, ts timestamp, value double").parquet(str(src))
    q = sessions.segment_stream(stream).writeStream.format("memory").queryName("segs").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.id, r.segment) for r in spark.table("segs").collect()} == {(0, 1), (1, 1), (2, 2)}
