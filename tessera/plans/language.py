"""Tokens, claims, topics, and the rules of upkeep and of search records: library code held against SQL written apart from it."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import dates, morphemes, records, tokens
from tessera.operators import claims, consolidate, index, ivf, topics
from tessera.plans.registry import register
from tessera.plans.scoring import _POSTINGS, _UTILITY, quoted, utility, utility_baseline
from tessera.plans.shared import NOW_US
from tessera.sources import logs
from tessera.sources.scratch import shared_dir
from tessera.sources.views import NOW_H, duckdb_sql, view

_TEXTS = "select 'document' as kind, doc_id as id, cast(0 as bigint) as turn, text from @documents union all select 'turn', conv_id, turn, text from @conversations"


def _texts(spark, sf_dir):
    docs, turns = view(spark, sf_dir, "documents"), view(spark, sf_dir, "conversations")
    return docs.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("turn"), "text").unionByName(turns.select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), "turn", "text"))


def _runs_sql(script: str) -> str:
    return f"regexp_extract_all(coalesce(text, ''), '{morphemes.RUNS[script]}')"


@register("x29_script_runs", duckdb_sql(
    "select kind, id, turn, " + ", ".join(f"len({_runs_sql(s)}) as {s}" for s in morphemes.RUNS) + f", sha256(array_to_string({_runs_sql('latin')}, ' ')) as latin_runs from ({_TEXTS}) t"))
def x29(spark, sf_dir):
    """How many runs of each script every text has, and the Latin ones."""
    counts = [F.size(morphemes.runs(F.col("text"), s)).cast("long").alias(s) for s in morphemes.RUNS]
    return _texts(spark, sf_dir).select("kind", "id", "turn", *counts, F.sha2(F.array_join(morphemes.runs(F.col("text"), "latin"), " "), 256).alias("latin_runs"))


@register("x30_morphemes")
def x30(spark, sf_dir):
    """Tokens of documents and conversations by language; stems are beyond SQL."""
    return _texts(spark, sf_dir).select("kind", "id", "turn", F.array_join(morphemes.morphemes(F.col("text")), " ").alias("tokens"))


_PLAIN = "list_slice(list_filter(string_split_regex(regexp_replace(lower(content), '[^A-Za-z0-9_\\sㄱ-ㅎ가-힣]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1 and w not in ({stop})), 1, 10)"


def _marker_sql(markers: list[str]) -> str:
    of = lambda m: m.replace("'", "''")
    return "case " + " ".join(f"when contains(low, '{of(m)}') or contains(tight, '{of(claims.compact(m))}') then '{of(m)}'" for m in markers) + " end"


def _claims_sql(where: str) -> str:
    from tessera.functions.text import PLAIN_STOP_WORDS

    loose = claims.LOOSE.replace("'", "''")
    tokens = _PLAIN.format(stop=quoted(PLAIN_STOP_WORDS))
    marks = ", ".join(f"{_marker_sql(m)} as {n}" for n, m, _ in claims.POLARITIES)
    return (
        f"with t as (select id, key_id, nullif(trim(topic), '') as topic, lower(content) as low, regexp_replace(lower(content), '{loose}', '', 'g') as tight, {tokens} as tokens from @fragments where regexp_matches(content, '\\S') and {where}), "
        f"m as (select *, {marks} from t), "
        f"s as (select *, coalesce(topic, tokens[1], 'unknown') as subject, list_filter(tokens, lambda w: w in ({quoted(claims.POSITIVE + claims.NEGATIVE)}))[1] as named from m) "
        "select id, key_id, subject, coalesce(uncertain, negative, positive, named, 'mentions') as predicate, case when len(tokens) > 1 then list_filter(tokens, lambda w: w <> subject)[-1] end as object, "
        "case when uncertain is not null then 'uncertain' when negative is not null then 'negative' when positive is not null then 'positive' else 'uncertain' end as polarity, "
        "case when uncertain is not null then 0.5e0 when negative is not null then 0.75e0 when positive is not null then 0.7e0 else 0.4e0 end as confidence from s"
    )


@register("x35_claims", duckdb_sql(_claims_sql("true")))
def x35(spark, sf_dir):
    return claims.extract(view(spark, sf_dir, "fragments")).drop("extractor", "rule_version")


@register("m22_claims_backfill", duckdb_sql(f"select * from ({_claims_sql('valid_to_h is null')}) c where confidence >= 0.5"))
def m22(spark, sf_dir):
    """The claims table that a backfill from nothing leaves."""
    path = f"{shared_dir(spark)}/claims-{uuid.uuid4().hex}"
    claims.backfill(view(spark, sf_dir, "fragments"), path)
    return claims.claims_of(spark, path).drop("extractor", "rule_version")


_ASKED = "select distinct lower(p_type) || '-' || split_part(p_name, ' ', 2) as asked from @part"


@register("k19_topic_suggestion", duckdb_sql(
    "with t as (select topic, count(*) as n from (select replace(p_name, ' ', '-') as topic from @part) p group by topic order by n desc, topic limit 500), "
    "w as (select topic, n, unnest(list_distinct(list_filter(string_split_regex(lower(topic), '[^a-z0-9]+'), lambda x: x <> ''))) as word from t), "
    "d as (select word, ln(1 + (select count(*) from t) / cast(count(*) as double)) as idf from w group by word), "
    "n as (select topic, sqrt(sum(idf * idf)) as norm from w join d using (word) group by topic), "
    f"a as (select asked, word, coalesce(idf, ln(1 + (select count(*) from t))) as idf from (select asked, unnest(list_distinct(string_split_regex(lower(asked), '[^a-z0-9]+'))) as word from ({_ASKED}) q) x left join d using (word)), "
    "an as (select asked, sqrt(sum(idf * idf)) as norm from a group by asked), "
    "c as (select a.asked, w.topic, round(sum(a.idf / an.norm * d.idf / n.norm), 9) as cosine from a join an using (asked) join w using (word) join d using (word) join n using (topic) group by a.asked, w.topic having round(sum(a.idf / an.norm * d.idf / n.norm), 9) >= 0.5), "
    "l as (select q.asked, t.topic, t.n, c.cosine, case when contains(q.asked, t.topic) or contains(t.topic, q.asked) then 0.75e0 else len(list_filter(string_split(q.asked, '-'), lambda x: list_contains(string_split(t.topic, '-'), x))) / cast(greatest(len(string_split(q.asked, '-')), len(string_split(t.topic, '-'))) as double) end as lex "
    f"from ({_ASKED}) q join t on t.topic <> q.asked left join c on c.asked = q.asked and c.topic = t.topic) "
    "select asked, topic, n, cosine as similarity, rank from (select *, row_number() over (partition by asked order by cosine desc nulls last, case when cosine is null then lex end desc nulls first, n desc, topic) as rank from l where cosine is not null or lex > 0) r where rank <= 3"))  # fmt: skip
def k19(spark, sf_dir):
    """Names made of a part's kind and noun, against the names that parts really have."""
    part = view(spark, sf_dir, "part")
    pool = topics.candidates(part.select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("topic"), F.lit(None).cast("long").alias("valid_to_h")))
    asked = part.select(F.concat(F.lower("p_type"), F.lit("-"), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("asked"))
    return topics.suggest(pool, asked)


# rules of upkeep


@register("a33_utility_baseline", duckdb_sql(f"select round(coalesce(avg({_UTILITY}), 1.0e0), 6) as baseline from @fragments where is_anchor and valid_to_h is null"))
def a33(spark, sf_dir):
    return spark.createDataFrame([(round(utility_baseline(view(spark, sf_dir, "fragments")), 6),)], "baseline double")


@register("a43_gate_preview", duckdb_sql(f"select type, count(*) as n from @fragments where {_UTILITY} < 0.15 and ttl_tier <> 'permanent' and not is_anchor group by type"))
def a43(spark, sf_dir):
    return consolidate.low_utility(view(spark, sf_dir, "fragments"), utility()).groupBy("type").agg(F.count("*").alias("n"))


@register("f36_compression_candidates", duckdb_sql(f"select id, topic from @fragments where accessed_h < {NOW_H - 720} and importance < 0.5 and not is_anchor and valid_to_h is null and id in (select id from @vectors where embedding is not null)"))
def f36(spark, sf_dir):
    return consolidate.compressible(view(spark, sf_dir, "fragments"), view(spark, sf_dir, "vectors"), NOW_H).select("id", "topic")


@register("f37_requeue", duckdb_sql("select id, ema from @fragments where ema > 0.3 and importance < 0.4 and quality_verified is null and ttl_tier <> 'permanent' order by ema desc, id limit 20"))
def f37(spark, sf_dir):
    return consolidate.requeue(consolidate.Snapshot(*(view(spark, sf_dir, n) for n in ("fragments", "links", "vectors")), NOW_H))


_WEEK = 604_800_000_000


@register("f45_pending_sessions", duckdb_sql(
    f"select sid as session_id from (select distinct session_id, us // {_WEEK} as week, session_id || '#' || cast(us // {_WEEK} as varchar(9)) as sid from @search_events) s "
    f"where not exists (select 1 from @tool_feedback t where t.tool_name = 'reflect' and t.session_id = s.session_id and t.us // {_WEEK} = s.week) "
    f"and split_part(sid, '#', 1) not in (select session_id from @search_events where us >= {NOW_US} - 43200000000)"))  # fmt: skip
def f45(spark, sf_dir):
    """Weekly segments of search sessions without a reflection of theirs, whose session isn't active in the last half day."""
    searches, told = view(spark, sf_dir, "search_events"), view(spark, sf_dir, "tool_feedback")
    segment = F.concat("session_id", F.lit("#"), F.expr(f"us div {_WEEK}").cast("string")).alias("session_id")
    return records.pending_sessions(searches.select(segment), told.where("tool_name = 'reflect'").select(segment), searches.where(f"us >= {NOW_US} - 43200000000").select("session_id"))


# records of searches

_ASKS = "select conv_id, turn, case when turn % 3 > 0 then text end as text, case when turn % 2 = 0 then list_slice(list_filter(string_split(text, ' '), lambda w: length(w) > 6), 1, 3) end as keywords, case when turn % 5 = 0 then role end as topic from @conversations"


@register("x38_query_type", duckdb_sql(
    "select conv_id, turn, case when t + k + o = 0 then 'keywords' when t + k + o > 1 then 'mixed' when t = 1 then 'text' when k = 1 then 'keywords' else 'topic' end as kind, case when o = 1 then 'topic' else '' end as filters from "
    f"(select conv_id, turn, case when coalesce(text, '') <> '' then 1 else 0 end as t, case when coalesce(len(keywords), 0) > 0 then 1 else 0 end as k, case when coalesce(topic, '') <> '' then 1 else 0 end as o from ({_ASKS}) a) x"))  # fmt: skip
def x38(spark, sf_dir):
    """Conversation turns asked as text, as keywords, by topic, or several of these."""
    words = F.slice(F.filter(F.split("text", " "), lambda w: F.length(w) > 6), 1, 3)
    asks = view(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 > 0, F.col("text")).alias("text"), F.when(F.col("turn") % 2 == 0, words).alias("keywords"), F.when(F.col("turn") % 5 == 0, F.col("role")).alias("topic"))
    kind = records.query_type(F.col("text"), F.col("keywords"), F.col("topic"))
    return asks.select("conv_id", "turn", kind.alias("kind"), F.array_join(records.filter_keys({"topic": F.col("topic")}), " ").alias("filters"))


@register("x39_search_path", duckdb_sql("select id, l1_count as l1, l2_count as l2, case when result_count % 2 = 0 then l3_count else l3_count + 10 end as l3, used_rrf as rrf from @search_events"))
def x39(spark, sf_dir):
    """Counts read back from the path that a search has left."""
    e = view(spark, sf_dir, "search_events")
    third = F.when(F.col("result_count") % 2 == 0, F.concat(F.lit("L3:"), F.col("l3_count").cast("string"))).otherwise(F.concat(F.lit("L3kw:"), (F.col("l3_count") + 10).cast("string")))
    path = F.concat_ws(" → ", F.when(F.col("l1_count") > 0, F.concat(F.lit("L1:"), F.col("l1_count").cast("string"))), F.concat(F.lit("L2:"), F.col("l2_count").cast("string")), third, F.when(F.col("used_rrf"), F.lit("RRF")))
    return e.select("id", records.search_path(path).alias("p")).select("id", "p.*")


# the stored vector index

_INDEXED = ("agent_id", "key_id", "workspace", "type", "topic", "valid_to_h")
_SCOPED = "(agent_id = 'agent1' or agent_id = 'default') and valid_to_h is null and (workspace = 'en' or workspace is null)"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: cast(z[1] as double) * cast(z[2] as double)))"
_COSINE = "{d} / (sqrt({x}) * sqrt({y}))".format(d=_DOT.format(a="v.embedding", b="q.embedding"), x=_DOT.format(a="v.embedding", b="v.embedding"), y=_DOT.format(a="q.embedding", b="q.embedding"))


def _index(spark, sf_dir):
    """The index over all vectors with the columns that searches filter by, and the vectors of rows with ids divisible by 50 as queries."""
    f, v = view(spark, sf_dir, "fragments").select("id", *_INDEXED), view(spark, sf_dir, "vectors")
    built = ivf.build(v.select("id", "embedding").join(f, "id"), f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", _INDEXED, "key_id")
    return built, v.where("id % 50 = 0").select(F.col("id").alias("qid"), "embedding")


@register("j15_indexed_exact", duckdb_sql(
    f"select qid, id, rank from (select q.id as qid, v.id, row_number() over (partition by q.id order by round({_COSINE}, 9) desc, v.id) as rank from @vectors v join @vectors q on q.id % 50 = 0 where v.id in (select id from @fragments where {_SCOPED})) x where rank <= 10"))
def j15_indexed_exact(spark, sf_dir):
    """Filtered nearest neighbours through the index with every cell probed."""
    built, asked = _index(spark, sf_dir)
    return ivf.search(built, asked, where=F.expr(_SCOPED), exact=True).select("qid", "id", "rank")


@register("j15_indexed_recall")
def j15_indexed_recall(spark, sf_dir):
    """Recall at 10 of the filtered search that probes 16 cells."""
    built, asked = _index(spark, sf_dir)
    found = ivf.search(built, asked, where=F.expr(_SCOPED))
    return ivf.recall(found, ivf.search(built, asked, where=F.expr(_SCOPED), exact=True))


# dates in words, tokens

_PHRASES = {0: "오늘", 1: "어제", 2: "그저께", 3: "이번 주", 4: "지난 주", 5: "이번 달", 6: "지난달"}


@register("x40_said_dates", duckdb_sql(
    "with e as (select event_id, ts, cast(ts as date) as d, cast(date_trunc('month', ts) as date) as m, cast(event_id % 40 as integer) as n, cast(event_id % 12 as integer) as k, cast(event_id % 7 as integer) as w from @events) "
    "select event_id, cast(case k when 0 then d when 1 then d - 1 when 2 then d - 2 when 3 then cast(date_trunc('week', ts) as date) when 4 then cast(date_trunc('week', ts) as date) - 7 when 5 then m when 6 then cast(m - interval 1 month as date) "
    "when 7 then d - n when 8 then d - 7 * n when 9 then cast(m - to_months(n) as date) + cast(day(d) - 1 as integer) when 10 then cast(m - to_months(12 * n) as date) + cast(day(d) - 1 as integer) "
    "else d - (case when cast(isodow(d) as integer) - 1 > w then cast(isodow(d) as integer) - 1 - w else cast(isodow(d) as integer) + 6 - w end) end as timestamp) as since from e"))  # fmt: skip
def x40(spark, sf_dir):
    """What phrases of all kinds mean at the time of each event."""
    n = (F.col("event_id") % 40).cast("string")
    k = F.col("event_id") % 12
    fixed = F.create_map(*(F.lit(x) for kv in _PHRASES.items() for x in kv))[k.cast("int")]
    day = F.create_map(*(F.lit(x) for d, w in dates.DAYS.items() for x in (w, d)))[(F.col("event_id") % 7).cast("int")]
    phrase = F.when(k == 7, F.concat(n, F.lit("일 전"))).when(k == 8, F.concat(n, F.lit("주 전"))).when(k == 9, F.concat(n, F.lit(" 개월 전"))).when(k == 10, F.concat(n, F.lit("년 전"))).when(k == 11, F.concat(F.lit("지난 "), day)).otherwise(fixed)
    return view(spark, sf_dir, "events").select("event_id", dates.said_time(phrase, F.col("ts")).alias("since"))


#: Where the rank table of the token counts lies; without it they are estimates.
RANKS = os.environ.get("TESSERA_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")


@register("x21_bpe_tokens")
def x21_bpe(spark, sf_dir):
    """Tokens of documents and conversations by byte-pair merging."""
    ranks = tokens.read_ranks(RANKS) if os.path.exists(RANKS) else None
    return _texts(spark, sf_dir).select("kind", "id", "turn", tokens.token_count(spark, F.col("text"), ranks).alias("tokens"))


# logs

_LEVEL = "case event_type when 'error' then 'error' when 'purchase' then 'warn' when 'click' then 'debug' else 'info' end"


@register("s24_log_statistics", duckdb_sql(
    f"select {_LEVEL} as level, count(*) as n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as oldest, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as newest, cast(sum(length(props)) as bigint) as chars from @events group by {_LEVEL}"))
def s24(spark, sf_dir):
    """The events written as logs, an error's properties on a line of its own, and read back by the log source."""
    e = view(spark, sf_dir, "events").withColumn("level", F.expr(_LEVEL))
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), F.upper("level"), F.lit("]: "), F.when(F.col("level") == "error", F.lit("failed\n")).otherwise(F.lit("")), "props")
    path = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    e.select(line.alias("value")).write.text(path)
    spark.dataSource.register(logs.LogSource)
    found = spark.read.format("applog").load(path)
    chars = found.groupBy("level").agg(F.sum(F.length(F.regexp_replace("message", "^failed\n", ""))).alias("chars"))
    return logs.statistics(found).join(chars, "level")


# cases, sessions, samples, retention


@register("f27_case_eligibility", duckdb_sql(
    "select f.id, case when f.key_id <> 'k0' then 'tenant' when f.case_id is null then 'no_case' when q.id is not null then 'quarantine' when f.resolution_status <> 'resolved' then 'unresolved' end as blocked "
    "from (select id, key_id, resolution_status, nullif(case_id, 7) as case_id from @fragments) f left join (select distinct to_id as id from @links where relation_type = 'contradicts' and weight >= 3) q on q.id = f.id"))  # fmt: skip
def f27(spark, sf_dir):
    """Why each fragment is no precedent of tenant k0: rows that a strong link contradicts count as softly quarantined, and case 7 as none."""
    doubted = view(spark, sf_dir, "links").where("relation_type = 'contradicts' and weight >= 3").select(F.col("to_id").alias("id")).distinct().withColumn("quarantine", F.lit("soft"))
    f = view(spark, sf_dir, "fragments").join(doubted, "id", "left")
    return f.select("id", records.blocked_because(F.col("key_id"), F.lit("k0"), F.nullif("case_id", F.lit(7)), F.col("quarantine"), F.col("resolution_status")).alias("blocked"))


@register("f38_reflection_gate", duckdb_sql(
    "select s.sid as session_id, s.calls from (select session_id || '#' || cast(us // 14400000000 as varchar(9)) as sid, count(*) as calls, max(us) - min(us) as lasted from @search_events group by sid) s "
    "left join (select session_id || '#' || cast(us // 14400000000 as varchar(9)) as sid, count(*) as n from @tool_feedback where tool_name = 'remember' group by sid) t on t.sid = s.sid where s.calls >= 3 and s.lasted >= 30000000 and coalesce(t.n, 0) = 0"))  # fmt: skip
def f38(spark, sf_dir):
    """Four-hour segments of sessions to be reflected on; what they stored by themselves is told by their feedback on remember."""
    segment = F.concat("session_id", F.lit("#"), F.expr("us div 14400000000").cast("string")).alias("session_id")
    e = view(spark, sf_dir, "search_events").groupBy(segment).agg(F.count("*").alias("calls"), F.min("us").alias("started"), F.max("us").alias("last"))
    own = view(spark, sf_dir, "tool_feedback").where("tool_name = 'remember'").groupBy(segment).agg(F.count("*").alias("fragments"))
    gate = records.worth_reflecting(F.col("calls"), F.col("started"), F.col("last"), F.col("fragments"))
    return e.join(own, "session_id", "left").where(gate).select("session_id", "calls")


@register("w09_previous_sample", duckdb_sql(
    "select id, case when p is null or us <= pu then 0 else round(greatest(total - p, 0) / ((us - pu) / 1000000.0e0) * 60, 2) end as per_minute from (select id, us, total, lag(total) over w as p, lag(us) over w as pu from "
    "(select id, us, session_id, result_count, sum(result_count) over (partition by session_id order by us, id) % 50 as total from @search_events) c window w as (partition by session_id order by us, id)) x"))  # fmt: skip
def w09(spark, sf_dir):
    """Results a minute between a session's searches, from a running counter that starts again at 50."""
    w = Window.partitionBy("session_id").orderBy("us", "id")
    e = view(spark, sf_dir, "search_events").withColumn("total", F.sum("result_count").over(w) % 50)
    return e.select("id", records.rate(F.col("total").cast("double"), F.lag("total").over(w).cast("double"), (F.col("us") - F.lag("us").over(w)) / 1e6, 60).alias("per_minute"))


_TOLD = "select id, case_id, case type when 'error' then 'error_observed' when 'decision' then 'decision_committed' else 'fix_attempted' end as t, row_number() over (partition by case_id order by created_h, id) - 1 as n from @fragments where case_id is not null and type in ('error', 'decision', 'procedure')"


@register("g16_case_edges", duckdb_sql(
    f"with e as ({_TOLD}) select b.id as from_event, a.id as to_event, 'preceded_by' as edge_type from e a join e b on b.case_id = a.case_id and b.n = a.n + 1 "
    "union all select f.id, e.id, 'resolved_by' from e f join e on e.case_id = f.case_id and e.n < f.n where f.t = 'fix_attempted' and e.t = 'error_observed'"))  # fmt: skip
def g16(spark, sf_dir):
    return records.case_edges(records.case_events(view(spark, sf_dir, "fragments")))


@register("u04_keyword_intersection", duckdb_sql(
    f"with m as (select ns, id, count(distinct term) as met from ({_POSTINGS}) p where kind = 'keyword' and term in ('that', 'thble') group by ns, id), e as (select ns, count(*) filter (met = 2) >= 3 as enough from m group by ns) "
    "select m.ns, m.id from m join e on e.ns = m.ns where not enough or met = 2"))  # fmt: skip
def u04(spark, sf_dir):
    """Ids that both keywords have, by tenant; those that either has where there are fewer than three."""
    return index.by_all_or_any(index.postings(view(spark, sf_dir, "fragments")), ["that", "Thble"])


#: Microseconds of the clean-up's "now": ten days after the last event.
_LATER = NOW_US + 10 * 86_400_000_000


@register("c22_event_retention", duckdb_sql(f"select id from @search_events where us >= {_LATER} - 2592000000000"))
def c22(spark, sf_dir):
    """The search events that a clean-up leaves."""
    return consolidate.retained(view(spark, sf_dir, "search_events"), _LATER, 30).select("id")


@register("m23_retention", duckdb_sql(f"select 'search' as kind, id from @search_events where us >= {_LATER} - 2592000000000 union all select 'case', event_id from @case_events where us >= {_LATER} + 4752000000000 - 7776000000000"))
def m23(spark, sf_dir):
    """What is left of search events after 30 days and of case events after 90 (the latter cleaned up 55 days later)."""
    cases = consolidate.retained(view(spark, sf_dir, "case_events"), _LATER + 55 * 86_400_000_000, 90)
    return consolidate.retained(view(spark, sf_dir, "search_events"), _LATER, 30).select(F.lit("search").alias("kind"), "id").unionByName(cases.select(F.lit("case").alias("kind"), F.col("event_id").alias("id")))
