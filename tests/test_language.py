"""Tokens by language, claims and their backfill, topics, records of searches."""

import uuid

import pytest
from pyspark.sql import functions as F

from tessera.functions import dates, morphemes, records, tokens
from tessera.operators import claims, topics
from tessera.sources.scratch import shared_dir

# Pairs published with the algorithm.
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop
tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit
conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope
callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good
revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend
adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll""".split()


def test_stems():
    s = morphemes.Stemmer(most=20)
    assert [(w, s.stem(w)) for w in STEMS[::2]] == list(zip(STEMS[::2], STEMS[1::2]))
    assert s.stem("by") == "by" and len(s.known) <= 20


def test_segments():
    assert morphemes.segments("한국어abc 漢字カナ123") == [("hangul", "한국어"), ("latin", "abc"), ("han", "漢字"), ("kana", "カナ"), ("other", "123")]
    assert morphemes.segments("query-api_v2 L3, 42 things") == [("latin", "query-api_v2"), ("latin", "L3"), ("other", ", 42 "), ("latin", "things")]
    assert morphemes.segments("  \n ") == [] and morphemes.segments(None) == []


def test_tokens():
    a = morphemes.Analyser()
    assert a.tokens("임베딩 비용을 줄였다 query-api calls", 10) == ["임베딩", "비용", "줄였다", "queri", "api", "call"]
    assert "을" not in a.tokens("비용을", 10) and a.tokens("에서 나", 10) == []
    assert "中文" in a.tokens("中文分词", 10) and a.tokens("アイ", 10) == ["ア", "イ"]
    assert morphemes.Analyser(["中文", "分词器"]).tokens("中文分词器好", 10) == ["中文", "分词器", "好"]
    assert a.tokens("red two three red", 2) == ["red", "two"] and a.tokens(None, 3) == []


def test_tokens_of_columns(spark):
    rows = [(1, "The runners were running"), (2, None), (3, ""), (4, "running the runners " * 5000), (5, "getUserName calls snake_case and calls twice")]
    df = spark.createDataFrame(rows, "id long, t string")
    got = {r.id: r for r in df.select("id", morphemes.morphemes(F.col("t")).alias("m"), morphemes.keywords(F.col("t"), 3).alias("k")).collect()}
    assert got[1].m == ["runner", "run"] and got[4].m == ["run", "runner"] and got[2].m == got[3].m == got[2].k == []
    assert got[5].k == ["getUserName", "snake_case", "calls"]


SAID = [("캐시로 사용한다", "positive"), ("캐시로 사용하지 않는다", "negative"), ("아마도 큐가 적합할 것으로 보임", "uncertain"), ("접근 금지", "negative"), ("The provider is supported", "positive"), ("It possibly remains", "uncertain"),
        ("Do not use the old constant", "negative"), ("Enable the index", "positive"), ("It might be enabled", "uncertain"), ("nothing said", "uncertain"), ("사용 하지않음", "negative")]


def test_claims(spark):
    df = spark.createDataFrame([(i, "k", t, "topic ") for i, (t, _) in enumerate(SAID)] + [(90, None, "word Other use", None), (91, "k", "  \n", "t"), (92, "k", None, "t"), (93, "k", "x", None)], "id long, key_id string, content string, topic string")
    got = {r.id: r for r in claims.extract(df).collect()}
    assert [got[i].polarity for i in range(len(SAID))] == [p for _, p in SAID]
    assert (got[0].subject, got[0].predicate, got[0].confidence, got[1].confidence, got[9].predicate, got[9].confidence) == ("topic", "사용한다", 0.7, 0.75, "mentions", 0.4)
    assert (got[90].subject, got[90].object, got[90].predicate) == ("word", "use", "use") and (got[93].subject, got[93].object) == ("unknown", None)
    assert not {91, 92} & set(got)


def test_backfill_goes_on_where_it_ended(spark, sf):
    from tessera.sources.views import view

    f = view(spark, sf, "fragments").select("id", "key_id", "valid_to_h", "topic", F.when(F.col("id") % 9 != 0, F.concat("content", F.when(F.col("id") % 2 == 0, F.lit(" do not use")).otherwise(F.lit(" applies")))).alias("content"))
    f = f.unionByName(spark.createDataFrame([(5000, "k9", None, "t", " \n")], f.schema))
    path = f"{shared_dir(spark)}/claims-{uuid.uuid4().hex}"
    assert claims.claims_of(spark, path) is None
    first = claims.backfill(f, path, batch=20, batches=1)
    (spark.range(1).write.parquet(f"{path}/batch-cut"))
    where, fs = claims._folder(spark, f"{path}/batch-cut/_SUCCESS")
    fs.delete(where, False)  # a batch whose executor was lost has no such mark
    rest = claims.backfill(f, path, batch=20)
    active = f.where("valid_to_h is null and content is not null").count()
    assert 0 < first["examined"] < active and first["examined"] + rest["examined"] == active and rest["batches"] > 1
    want = claims.extract(f.where("valid_to_h is null")).where("confidence >= 0.5")
    assert sorted(claims.claims_of(spark, path).collect()) == sorted(want.collect())
    assert claims.backfill(f, path)["examined"] == 0


def test_topics(spark):
    pool = spark.createDataFrame([("query-cache", 5), ("cache-policy", 9), ("billing", 2), ("query-plan-cost", 1), ("cachet", 1)], "topic string, n long")
    asked = spark.createDataFrame([("cache-query",), ("cach",), ("bill",), ("nothing",), ("billing",), (" ",)], "asked string")
    got = {}
    for r in topics.suggest(pool, asked, limit=2).orderBy("asked", "rank").collect():
        got.setdefault(r.asked, []).append((r.topic, r.similarity))
    assert got["cache-query"][0] == ("query-cache", 1.0) and got["cach"] == [("cache-policy", None), ("query-cache", None)]
    assert got["bill"] == [("billing", None)] and not {"nothing", "billing", " "} & set(got)
    assert topics.suggest(pool.limit(0), asked).count() == 0


def test_records(spark):
    paths = spark.createDataFrame([("L1:5 → L2:10 → RRF",), ("L2:3 → L3kw:2",), ("",), (None,)], "p string").select(records.search_path(F.col("p")).alias("r")).collect()
    assert [tuple(r.r) for r in paths] == [(5, 10, 0, True), (0, 3, 2, False), (0, 0, 0, False), (0, 0, 0, False)]
    rows = spark.createDataFrame([("t", None, None), (None, ["k"], None), (None, [], "x"), ("t", ["k"], None), (None, None, None), ("", [], "")], "t string, k array<string>, o string")
    assert [r.kind for r in rows.select(records.query_type(F.col("t"), F.col("k"), F.col("o")).alias("kind")).collect()] == ["text", "keywords", "topic", "mixed", "keywords", "keywords"]
    of = lambda *ids: spark.createDataFrame([(i,) for i in ids], "session_id string")
    assert [r.session_id for r in records.pending_sessions(of("a#1", "a#2", "b#1", "c#1"), of("a#1"), of("c")).orderBy("session_id").collect()] == ["a#2", "b#1"]




@pytest.mark.parametrize(
    "phrase, day",
    [("3일 전", "2026-03-25"), ("1주 전", "2026-03-21"), ("2개월 전", "2026-01-28"), ("1달 전", "2026-02-28"), ("1년 전", "2025-03-28"), ("오늘", "2026-03-28"), ("어제", "2026-03-27"), ("그제", "2026-03-26"), ("이번 주", "2026-03-23"), ("지난 주", "2026-03-16"),
     ("이번 달", "2026-03-01"), ("지난 달", "2026-02-01"), ("지난 월요일", "2026-03-23"), ("지난 토요일", "2026-03-21"), ("지난 일요일", "2026-03-22"), ("2026-01-05", "2026-01-05"), ("soon", None), ("", None), (None, None)],
)
def test_said_times(spark, phrase, day):
    now = F.lit("2026-03-28 15:30:00").cast("timestamp_ntz")
    got = spark.range(1).select(F.date_format(dates.said_time(F.lit(phrase).cast("string"), now), "yyyy-MM-dd HH").alias("d")).first().d
    assert got == (f"{day} 00" if day else None)


def test_said_months_run_over(spark):
    now = F.lit("2026-03-31 01:00:00").cast("timestamp_ntz")
    r = spark.range(1).select(dates.said_time(F.lit("1개월 전"), now).cast("string").alias("d"), dates.said_range(F.lit("어제"), F.lit(None).cast("string"), now).alias("r"), dates.said_time(F.lit("2026-03-02T04:05:06"), now).cast("string").alias("t")).first()
    assert r.d == "2026-03-03 00:00:00" and str(r.r.since) == "2026-03-30 00:00:00" and r.r.until is None and r.t == "2026-03-02 04:05:06"


def test_token_counts(spark):
    """Merging against a loop that always merges the first pair of least rank."""
    ranks = {bytes([b]): b for b in range(256)}
    for k, token in enumerate(["th", "he", "the", " t", " the", "in", "ing", "er", "é", "aa", "aaaa"]):
        ranks[token.encode()] = 300 + k

    def brute(piece):
        parts = [bytes([b]) for b in piece.encode()]
        while True:
            found = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not found:
                return len(parts)
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    merger = tokens.Merger(ranks, most=3)
    for piece in ("the", " the", "thething", "singer", "éé", "aaaaaaa", "xyz", " their"):
        assert merger.word(piece.encode()) == brute(piece)
    rows = [(1, "the singer's thing, 42!  there"), (2, None), (3, ""), (4, "aaaa " * 3000)]
    df = spark.createDataFrame(rows, "id long, t string")
    want = {i: sum(map(brute, merger.pattern.findall(t or ""))) for i, t in rows}
    assert {r.id: r.n for r in df.select("id", tokens.token_count(spark, F.col("t"), ranks).alias("n")).collect()} == want
    assert [r.n for r in df.select(tokens.token_count(spark, F.col("t")).alias("n")).collect()] == [8, 0, 0, 3750]


def test_sessions_samples_and_cases(spark):
    rows = [(3, 0, 30_000_000, None), (3, 0, 29_999_999, 0), (0, 0, 10**9, 0), (2, 0, 10**9, 0), (5, 0, 10**9, 1), (5, None, 10**9, 0), (None, 0, 10**9, 0)]
    df = spark.createDataFrame(rows, "c long, s long, l long, f long")
    assert [r.ok for r in df.select(records.worth_reflecting(F.col("c"), F.col("s"), F.col("l"), F.col("f")).alias("ok")).collect()] == [True, False, False, False, False, False, False]
    df = spark.createDataFrame([(10.0, 4.0, 3.0), (1.0, 4.0, 3.0), (10.0, None, 3.0), (10.0, 4.0, 0.0)], "now double, before double, s double")
    assert [r.x for r in df.select(records.rate(F.col("now"), F.col("before"), F.col("s"), 60).alias("x")).collect()] == [120.0, 0.0, 0.0, 0.0]
    df = spark.createDataFrame([("a", 1, None, None), ("b", 1, None, None), (None, 1, None, None), ("a", None, "soft", None), ("a", 1, "soft", "open"), ("a", 1, "hard", "open"), ("a", 1, None, "resolved")], "k string, c int, q string, s string")
    got = [r.b for r in df.select(records.blocked_because(F.col("k"), F.lit("a"), F.col("c"), F.col("q"), F.col("s")).alias("b")).collect()]
    assert got == [None, "tenant", "tenant", "no_case", "quarantine", "unresolved", None]
    told = spark.createDataFrame([(1, 7, "error", 5), (2, 7, "fact", 6), (3, 7, "procedure", 6), (4, 7, "error", 7), (5, 7, "procedure", 7), (6, 8, "procedure", 1), (7, None, "error", 1)], "id long, case_id long, type string, created_h long")
    edges = {tuple(r) for r in records.case_edges(records.case_events(told)).collect()}
    assert edges == {(3, 1, "preceded_by"), (4, 3, "preceded_by"), (5, 4, "preceded_by"), (3, 1, "resolved_by"), (5, 1, "resolved_by"), (5, 4, "resolved_by")}


def test_all_or_any(spark):
    from tessera.operators import index

    rows = [("keyword", ns, t, i) for ns, t, i in [("a", "x", 1), ("a", "y", 1), ("a", "x", 2), (None, "x", 3), (None, "y", 4), *(("b", t, i) for t in "xy" for i in (5, 6, 7)), ("b", "x", 8)]] + [("topic", "a", "x", 9)]
    p = spark.createDataFrame(rows, "kind string, ns string, term string, id long")
    got = {tuple(r) for r in index.by_all_or_any(p, ["X", "y"]).collect()}
    assert got == {("a", 1), ("a", 2), (None, 3), (None, 4), ("b", 5), ("b", 6), ("b", 7)}
