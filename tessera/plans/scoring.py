"""Scores, gates, projections and rules over fragments: library expressions held against SQL written apart from them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import morphemes, scores, text, vectors
from tessera.operators import index, knn, search
from tessera.plans.core import _COS, _PAIRS, _QUERY, _lexical_sql, _query_vector
from tessera.plans.registry import register
from tessera.sources.views import NOW_H, duckdb_sql, view

_HALF = "(case type when 'procedure' then 30 when 'fact' then 60 when 'decision' then 90 when 'error' then 45 when 'preference' then 120 when 'relation' then 90 else 60 end)"
_AGE = f"(({NOW_H} - created_h) / 24.0e0)"
_IDLE = f"(({NOW_H} - accessed_h) / 24.0e0)"
_UTILITY = f"(importance * (1 + ln(greatest(access_count, 1))) / power(greatest(1.0e0, {_AGE} / 30), 0.3e0))"


def age_days():
    return (F.lit(NOW_H) - F.col("created_h")) / 24


def idle_days():
    return (F.lit(NOW_H) - F.col("accessed_h")) / 24


def utility():
    return scores.utility(F.col("importance"), F.col("access_count"), age_days())


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def of_fragments(name: str, column: str, make, sql: str, where: str = ""):
    """A query of (id, column) over the fragments, rounded where it is a double; and its SQL."""
    round_sql = f"round({sql}, 6)" if make.__name__ == "double" else sql

    @register(name, duckdb_sql(f"select id, {round_sql} as {column} from @fragments {where}"))
    def run(spark, sf_dir):
        f = view(spark, sf_dir, "fragments")
        c = make()
        return f.select("id", (F.round(c, 6) if make.__name__ == "double" else c).alias(column))

    return run


def _double(f):
    def double():
        return f()

    return double


of_fragments("x02_ema_update", "ema", _double(lambda: scores.activated(F.col("ema"), (F.lit(NOW_H) - F.col("accessed_h")) * 3600.0)), f"0.3e0 / sqrt(greatest(coalesce(({NOW_H} - accessed_h) * 3600.0e0, 86400), 1)) + 0.7e0 * coalesce(ema, 0)")
of_fragments("x03_ema_boost", "boost", _double(lambda: scores.ema_boost(F.col("ema"))), "0.2e0 - 0.2e0 * exp(-ema)")
of_fragments("x04_utility_score", "utility", _double(utility), _UTILITY)
of_fragments("x05_adaptive_importance", "importance", _double(lambda: scores.adaptive_importance(F.col("importance"), F.col("access_count"), idle_days(), F.col("type"))),
    f"least(1.0e0, greatest(0.05e0, case when importance is null or importance = 0 then 0.5e0 else importance end * (1 + ln(access_count + 1) / 10) * power(2.0e0, -coalesce({_IDLE}, 9999) / {_HALF})))")
of_fragments("x06_dynamic_half_life", "days", _double(lambda: scores.half_life_days(F.col("type"), F.col("ema"))), f"{_HALF} * least(2.0e0, 1 + coalesce(ema, 0) / 2)")
of_fragments("x07_ema_decay", "ema", _double(lambda: scores.activation_decay(F.col("ema"), idle_days(), F.col("is_anchor"))),
    f"case when not is_anchor and ema > 0 and (accessed_h is null or {NOW_H} - accessed_h > 1440) then 0 when not is_anchor and ema > 0.01 and {NOW_H} - accessed_h > 720 then ema / 2 else ema end")
of_fragments("x10_workspace_factor", "factor", _double(lambda: scores.workspace_factor(F.col("workspace"), "en")), "case when workspace is not distinct from 'en' then 1.0e0 else 0.7e0 end")
of_fragments("x11_recency_boost", "boost", _double(lambda: scores.recency_boost(age_days())), f"1 + (greatest(0.1e0, 1 - greatest({_AGE}, 0) * 0.9e0 / 365) - 0.5e0) / 5")
of_fragments("x12_temperature", "temperature", _double(lambda: scores.temperature(F.col("importance"), idle_days(), F.col("access_count"), F.col("source"), scores.workspace_factor(F.col("workspace"), "en"))),
    f"(importance + case when {NOW_H} - accessed_h < 168 then 0.2e0 else 0 end + case when access_count >= 5 then 0.15e0 else 0 end + case when source = 'learning_extraction' then 0.3e0 else 0 end) * case when workspace = 'en' then 1 else 0.7e0 end")
of_fragments("x14_initial_importance", "importance", _double(lambda: scores.initial_importance(F.col("content"), F.col("type"), F.col("importance"), F.col("is_anchor"))),
    "case when is_anchor then importance else least(importance, case when type in ('error', 'procedure') then 0.6e0 when type = 'preference' then 0.9e0 else 0.7e0 end, case when length(content) < 20 then 0.2e0 else 1 end) end")
of_fragments("x16_affect", "affect", lambda: scores.affect(F.col("affect")), "case when affect in ('neutral', 'frustration', 'confidence', 'surprise', 'doubt', 'satisfaction') then affect else 'neutral' end")
of_fragments("x25_child_importance", "child", _double(lambda: scores.child_importance(F.col("importance"), F.col("type"))), "case when type = 'fact' and floor(importance * 0.7e0 * 100 + 0.5e0) < 40 then null else floor(importance * 0.7e0 * 100 + 0.5e0) / 100 end")
of_fragments("x13_staleness", "days_unverified", lambda: scores.staleness(F.col("type"), F.floor((F.lit(NOW_H) - F.coalesce("verified_h", "created_h")) / 24)),
    f"case when ({NOW_H} - coalesce(verified_h, created_h)) // 24 >= case type when 'procedure' then 30 when 'decision' then 90 else 60 end then ({NOW_H} - coalesce(verified_h, created_h)) // 24 end")
of_fragments("x30_plain_tokens", "tokens", lambda: F.array_join(text.plain_tokens(F.col("content")), " "),
    f"array_to_string(list_slice(list_filter(string_split_regex(regexp_replace(lower(content), '[^A-Za-z0-9_\\sㄱ-ㅎ가-힣]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1 and w not in ({quoted(text.PLAIN_STOP_WORDS)})), 1, 10), ' ')")
of_fragments("f41_self_contained", "ok", lambda: text.self_contained(F.when(F.col("id") % 5 == 0, F.concat(F.lit("해당 "), "content")).when(F.col("id") % 5 == 1, F.concat(F.lit("이번 "), "content")).when(F.col("id") % 5 == 2, F.concat(F.lit("값은 "), F.substring("content", 1, 9))).otherwise(F.substring("content", 1, 19))),
    "case id % 5 when 0 then false when 1 then false when 2 then length(trim('값은 ' || substring(content, 1, 9), ' \t\n\r')) >= 10 else length(trim(substring(content, 1, 19), ' \t\n\r')) >= 20 end")
of_fragments("f42_split_child", "ok", lambda: text.acceptable_child(F.when(F.col("id") % 6 == 0, F.concat(F.lit("해당 "), "content")).when(F.col("id") % 6 == 1, F.concat(F.lit("한글과 漢字 "), "content")).when(F.col("id") % 6 == 2, F.concat("content", F.lit("�"))).otherwise(F.col("content"))),
    "id % 6 > 2 and length(trim(content, ' \t\n\r')) >= 20")


@register("x15_defaults_by_type", duckdb_sql(
    "select id, case type when 'error' then 0.9e0 when 'decision' then 0.8e0 when 'procedure' then 0.7e0 when 'preference' then 0.95e0 when 'relation' then 0.6e0 when 'episode' then 0.6e0 else 0.5e0 end as importance, "
    "case when type = 'preference' or importance >= 0.8 then 'permanent' when type in ('error', 'procedure') then 'hot' when type = 'episode' or importance >= 0.5 then 'warm' else 'cold' end as tier from @fragments"))  # fmt: skip
def x15(spark, sf_dir):
    return view(spark, sf_dir, "fragments").select("id", scores.default_importance(F.col("type")).alias("importance"), scores.inferred_tier(F.col("type"), F.col("importance")).alias("tier"))


def utility_baseline(fragments) -> float:
    """Mean utility of active anchors; 1 without any."""
    found = fragments.where("is_anchor and valid_to_h is null").agg(F.avg(utility())).first()[0]
    return 1.0 if found is None else float(found)


@register("x08_confidence", duckdb_sql(f"with b as (select coalesce(avg({_UTILITY}) filter (is_anchor and valid_to_h is null), 1) as base from @fragments) select id, round(least(1.0e0, greatest(0.1e0, {_UTILITY} / base)), 6) as confidence from @fragments, b"))
def x08(spark, sf_dir):
    f = view(spark, sf_dir, "fragments")
    return f.select("id", F.round(scores.confidence(utility(), utility_baseline(f)), 6).alias("confidence"))


@register("p04_response_projection", duckdb_sql(f"with b as (select coalesce(avg({_UTILITY}) filter (is_anchor and valid_to_h is null), 1) as base from @fragments) select id, ({NOW_H} - created_h) // 24 as age_days, round(least(1.0e0, greatest(0.1e0, {_UTILITY} / base)), 6) as confidence, workspace, case_id from @fragments, b where valid_to_h is null"))
def p04(spark, sf_dir):
    f = view(spark, sf_dir, "fragments")
    made = {"age_days": F.floor(age_days()), "confidence": F.round(scores.confidence(utility(), utility_baseline(f)), 6)}
    return search.picked(f.where("valid_to_h is null").withColumns(made), ["id", "age_days", "confidence", "workspace", "case_id", "no_such_field"], (*search.FIELDS, "age_days"))


@register("p03_sparse_fields", duckdb_sql("select id, topic, importance from @fragments"))
def p03(spark, sf_dir):
    return search.picked(view(spark, sf_dir, "fragments"), ["id", "topic", "importance", "content_hash", "nothing"])


@register("p08_detail_columns", duckdb_sql("select id, topic, content_hash, assertion_status from @fragments where id < 50"))
def p08(spark, sf_dir):
    return search.detailed(view(spark, sf_dir, "fragments").where("id < 50"), ["id", "topic"], True, ["content_hash", "assertion_status"])


@register("x09_feedback_factor", duckdb_sql(
    "select session_id, case when count(*) filter (not relevant) > 0 then 0.85e0 when count(*) filter (not sufficient) > 0 then 0.95e0 else 1.1e0 end as factor from @tool_feedback group by session_id having count(*) >= 2"))
def x09(spark, sf_dir):
    s = view(spark, sf_dir, "tool_feedback").groupBy("session_id").agg(F.bool_and("relevant").alias("r"), F.bool_and("sufficient").alias("s"), F.count("*").alias("n"))
    return s.where("n >= 2").select("session_id", scores.feedback_factor(F.col("r"), F.col("s")).alias("factor"))


@register("x34_nli_verdict", duckdb_sql(
    "select id, case when c >= 0.8 then true when e >= 0.6 then false else c >= 0.5 end as contradicts, round(case when c >= 0.8 then c when e >= 0.6 then e when c >= 0.5 then c else n end, 6) as confidence, "
    "case when c >= 0.8 or e >= 0.6 then false when c >= 0.5 then true else c >= 0.2 end as escalate from (select id, (id * 7 % 100) / 100.0e0 as c, (1 - (id * 7 % 100) / 100.0e0) * (id * 3 % 10) / 10 as e, 0.25e0 as n from @fragments) x"))  # fmt: skip
def x34(spark, sf_dir):
    c = (F.col("id") * 7 % 100) / 100
    v = scores.nli_verdict(c, (1 - c) * (F.col("id") * 3 % 10) / 10, F.lit(0.25))
    return view(spark, sf_dir, "fragments").select("id", v.alias("v")).select("id", "v.contradicts", F.round("v.confidence", 6).alias("confidence"), "v.escalate")


@register("x36_conflict_severity", duckdb_sql("select topic, case when count(*) < 2 then 'low' when count(*) < 4 then 'medium' else 'high' end as severity from @fragments where type = 'error' and case_id < 8 group by topic"))
def x36(spark, sf_dir):
    n = view(spark, sf_dir, "fragments").where("type = 'error' and case_id < 8").groupBy("topic").count()
    return n.select("topic", scores.severity(F.col("count")).alias("severity"))


@register("x37_reason_codes", duckdb_sql(
    "select id, array_to_string(list_slice(list_filter([case when id % 2 = 0 then 'direct_keyword_match' end, case when id % 3 = 0 then 'semantic_similarity' end, case when id % 5 = 0 then 'graph_neighbor_1hop' end, "
    "case when id % 7 = 0 then 'temporal_proximity' end, case when case_id = 10 then 'case_cohort_member' end, case when ema > 0.5 then 'recent_activity_ema' end], lambda x: x is not null), 1, 3), ',') as codes from @fragments"))  # fmt: skip
def x37(spark, sf_dir):
    tags = F.filter(F.array(*(F.when(F.col("id") % n == 0, F.lit(t)) for n, t in ((2, "L2:3"), (3, "L3kw:5"), (5, "Graph:2"), (7, "Temporal:1")))), lambda x: x.isNotNull())
    return view(spark, sf_dir, "fragments").select("id", F.array_join(scores.reason_codes(tags, F.col("case_id"), F.lit(10), F.col("ema")), ",").alias("codes"))


@register("x41_assistant_queries", duckdb_sql(
    "select conv_id, turn, case when " + " or ".join(f"contains(lower(q), '{p}')" for p in text.ASSISTANT_PHRASES) + " then 'Assistant: ' || q else q end as query from "
    "(select conv_id, turn, case when turn % 3 = 0 then 'What did you say? ' || substring(text, 1, 40) else substring(text, 1, 40) end as q from @conversations) x"))  # fmt: skip
def x41(spark, sf_dir):
    q = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("What did you say? "), F.substring("text", 1, 40))).otherwise(F.substring("text", 1, 40))
    return view(spark, sf_dir, "conversations").select("conv_id", "turn", text.assistant_query(q).alias("query"))


@register("x45_outcomes", duckdb_sql(
    "select id, case when outcome in ('completed', 'partial', 'blocked', 'abandoned', 'unknown') then outcome end as outcome, case when outcome in ('completed', 'partial', 'blocked', 'abandoned', 'unknown') then 'agent' end as evaluator, overall_success as success from @task_feedback"))
def x45(spark, sf_dir):
    r = scores.task_result(F.col("outcome"), F.lit(None).cast("string"), F.col("overall_success"))
    return view(spark, sf_dir, "task_feedback").select("id", r.alias("r")).select("id", "r.*")


@register("x45_irrelevance", duckdb_sql("select id, case when irrelevance_reason = 'other' and not relevant then 'other' end as reason from @tool_feedback"))
def x45_irrelevance(spark, sf_dir):
    return view(spark, sf_dir, "tool_feedback").select("id", scores.irrelevance_reason(F.col("relevant"), F.col("irrelevance_reason")).alias("reason"))


@register("x46_document_metadata", duckdb_sql(
    "select id, case when id % 2 = 0 then 'T' || id else 'Heading' end as title, case when id % 4 = 0 then 'cat' || id % 3 when id % 3 = 0 then topic else 'root' end as category, len(list_filter(string_split_regex(doc, '\\s+'), lambda w: w <> '')) as words, strlen(doc) as bytes "
    "from (select id, topic, case when id % 2 = 0 then '---\ntitle: \"T' || id || '\"\n' || case when id % 4 = 0 then 'category: cat' || id % 3 || '\n' else '' end || '---\n' else '' end || '# Heading \n' || substring(content, 1, 80) as doc from @fragments) x"))  # fmt: skip
def x46(spark, sf_dir):
    category = F.when(F.col("id") % 4 == 0, F.concat(F.lit("category: cat"), F.col("id") % 3, F.lit("\n"))).otherwise("")
    front = F.when(F.col("id") % 2 == 0, F.concat(F.lit('---\ntitle: "T'), "id", F.lit('"\n'), category, F.lit("---\n"))).otherwise("")
    doc, path = F.concat(front, F.lit("# Heading \n"), F.substring("content", 1, 80)), F.when(F.col("id") % 3 == 0, F.concat("topic", F.lit("/a.md"))).otherwise("a.md")
    return view(spark, sf_dir, "fragments").select("id", text.document_metadata(doc, path).alias("m")).select("id", "m.title", "m.category", F.col("m.words").cast("long").alias("words"), F.col("m.bytes").cast("long").alias("bytes"))


@register("x47_suggestions", duckdb_sql(
    "with e as (select id, key_id, query_type, result_count, id % 7 * 10 as lim, id % 2 = 0 as has_budget, id % 3 = 0 as has_type, id % 4 = 0 as has_context, "
    "count(*) filter (query_type in ('keywords', 'mixed')) over (partition by key_id order by us range between 300000000 preceding and current row) as recent from @search_events), n as (select key_id, count(*) as total from @fragments where valid_to_h is null group by key_id) "
    "select id, case when query_type in ('keywords', 'mixed') and recent >= 3 then 'repeat_query' when result_count = 0 and not has_context then 'empty_result_no_context' when lim >= 50 and not has_budget then 'large_limit_no_budget' "
    "when not has_type and coalesce(total, 0) > 100 then 'no_type_filter_noisy' end as code from e left join n using (key_id)"))  # fmt: skip
def x47(spark, sf_dir):
    e = view(spark, sf_dir, "search_events").select(
        "id", "key_id", "us", "query_type", F.col("query_type").isin("keywords", "mixed").alias("has_keywords"), "result_count", (F.col("id") % 7 * 10).alias("limit"),
        (F.col("id") % 2 == 0).alias("has_budget"), (F.col("id") % 3 == 0).alias("has_type"), (F.col("id") % 4 == 0).alias("has_context"),
    )
    return search.suggestions(e, view(spark, sf_dir, "fragments")).select("id", "code")


@register("x48_recall_hints", duckdb_sql(
    "select id, case when result_count = 0 and l1_count > 2 then 'topic_mismatch' when result_count = 0 then 'no_results' when id % 13 = 0 then 'contradiction_pending' when l3_count > 1 then 'stale_results' when result_count >= 5 and id % 2 <> 0 then 'consider_context' end as signal from @search_events"))
def x48(spark, sf_dir):
    hint = search.recall_hint(F.col("result_count"), F.col("l1_count") - 2, F.col("id") % 13 == 0, F.col("l3_count") - 1, F.col("id") % 2 == 0)
    return view(spark, sf_dir, "search_events").select("id", hint.alias("signal"))


# filters


@register("f15_indexed_gate", duckdb_sql("select id from @fragments where id % 4 <> 0 and valid_to_h is null"))
def f15(spark, sf_dir):
    f = view(spark, sf_dir, "fragments").withColumn("morpheme_indexed", F.col("id") % 4 != 0)
    return f.where(F.col("morpheme_indexed") & F.col("valid_to_h").isNull()).select("id")


@register("f18_optional_parameters", duckdb_sql("select id from @fragments where case_id = 7"))
def f18(spark, sf_dir):
    return search.optional(view(spark, sf_dir, "fragments"), {"topic": None, "case_id": 7, "phase": None}).select("id")


@register("f20_similarity_band", duckdb_sql(f"select topic, count(*) as n from ({_PAIRS}) p where similarity between 0.7 and 0.85 group by topic"))
def f20(spark, sf_dir):
    return knn.counted_pairs(view(spark, sf_dir, "vectors"), 0.7, 0.85)


@register("f24_threshold_or_unknown", duckdb_sql(f"select v.id from @vectors v, (select embedding from @embeddings where vec_id = 5) q where v.id % 5 = 0 or {_COS} >= 0.3"))
def f24(spark, sf_dir):
    v = view(spark, sf_dir, "vectors").withColumn("similarity", F.when(F.col("id") % 5 != 0, vectors.cosine(F.col("embedding"), _query_vector(spark, sf_dir))))
    return search.at_least(v, 0.3).select("id")


_GATE_SIDE = "select id, nullif(case_id, 0) as case_id, workspace, session_id, created_h, content from @fragments"


@register("f28_link_gate", duckdb_sql(
    f"select l.from_id, l.to_id, case when l.weight > 4.5 then 'quarantine' when a.case_id <> b.case_id then 'cohort_mismatch' when a.workspace <> b.workspace then 'workspace_mismatch' "
    "when (a.case_id is null or b.case_id is null) and not (coalesce(a.session_id = b.session_id, false) or coalesce(abs(a.created_h - b.created_h) <= 24, false) or coalesce(a.workspace = b.workspace, false)) then 'case_policy' "
    f"when b.id % 17 = 0 then 'polarity_conflict' else 'ok' end as reason from @links l join ({_GATE_SIDE}) a on a.id = l.from_id join ({_GATE_SIDE}) b on b.id = l.to_id"))  # fmt: skip
def f28(spark, sf_dir):
    f = view(spark, sf_dir, "fragments").withColumn("case_id", F.nullif("case_id", F.lit(0)))
    links = view(spark, sf_dir, "links").withColumn("quarantine_state", F.when(F.col("weight") > 4.5, "soft"))
    conflicts = f.where("id % 17 = 0").select("id")
    return index.gated(links, f, conflicts).select("from_id", "to_id", "reason")


@register("f29_policy_lint", duckdb_sql(
    "select f.id, concat_ws(',', case when type = 'decision' and coalesce(d.n, 0) < 2 and not regexp_matches(content, '(근거|이유|because|reason|rationale|왜냐하면|기반)', 'i') then 'decisionHasRationale' end, "
    "case when type = 'error' and resolution_status is null and not regexp_matches(content, '(원인|이유|해결|조치|복구|cause|reason|fix|resolve|workaround)', 'i') then 'errorHasResolutionPath' end, "
    "case when type = 'procedure' and not regexp_matches(content, '(\\b[12]\\.\\s|\\bstep\\s*[0-9]|단계|\\n\\s*[-*]\\s|\\n\\s*[0-9]+\\)\\s)', 'i') then 'procedureHasStepMarkers' end, "
    "case when case_id is not null and resolution_status is null then 'caseIdHasResolutionStatus' end, case when assertion_status = 'verified' and f.id % 2 = 0 then 'assertionNotContradictory' end, case when workspace is null then 'fragmentHasWorkspace' end) as broken "
    "from @fragments f left join (select from_id, count(*) as n from @links group by from_id) d on d.from_id = f.id"))  # fmt: skip
def f29(spark, sf_dir):
    n = view(spark, sf_dir, "links").groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("linked"))
    f = view(spark, sf_dir, "fragments").join(n, "id", "left").withColumn("rejected", F.col("id") % 2 == 0)
    return f.select("id", F.array_join(text.policy_violations({c: F.col(c) for c in f.columns}), ",").alias("broken"))


@register("f30_polluted_keywords", duckdb_sql("select id from @fragments where id % 3 = 0 or id % 7 = 0"))
def f30(spark, sf_dir):
    more = F.array(F.when(F.col("id") % 3 == 0, "서버에서").when(F.col("id") % 7 == 0, "캐시를").otherwise("서버"))
    return view(spark, sf_dir, "fragments").where(text.polluted(F.concat("keywords", more))).select("id")


@register("f46_hidden_identifiers", duckdb_sql("select id from @fragments where valid_to_h is null and (id % 4 = 0 or regexp_matches(content, '[a-z][A-Z]'))"))
def f46(spark, sf_dir):
    content = F.when(F.col("id") % 4 == 0, F.concat("content", F.lit(" callsTheService"))).otherwise(F.col("content"))
    return view(spark, sf_dir, "fragments").where("valid_to_h is null").where(text.hidden_identifier(content, F.col("keywords"))).select("id")


@register("f32_split_candidates", duckdb_sql(
    f"select id, length(content) as chars from @fragments where length(content) > 300 and valid_to_h is null and not is_anchor and coalesce(source, '') not like 'split:%' and coalesce(split_failed_h, 0) < {NOW_H} - 24 and topic not in ('src8', 'src9') order by chars desc, id limit 10"))
def f32(spark, sf_dir):
    return index.split_candidates(view(spark, sf_dir, "fragments"), NOW_H, ["src8", "src9"]).select("id", F.length("content").cast("long").alias("chars"))


# ranking

_K08 = (
    f"(case when id % 2 = 0 then (id * 13 % 100) / 100.0e0 else 0.85e0 * (importance * 0.4e0 + power(2.0e0, -abs({_AGE}) / 30) * 0.3e0 + (id * 17 % 100) / 100.0e0 * 0.3e0) end "
    f"+ case when id % 2 = 0 then 0.12e0 else 0.18e0 end * case when id % 3 = 0 then 0.5e0 else 1 end * least(1.0e0, ln(1 + {_lexical_sql(_QUERY)}) / ln(9.0e0))) * case when workspace = 'en' then 1 else 0.7e0 end"
)


@register("k08_recall_score", duckdb_sql(f"select id, round({_K08}, 6) as score from @fragments"))
def k08(spark, sf_dir):
    reranked = F.when(F.col("id") % 2 == 0, (F.col("id") * 13 % 100) / 100)
    lexical = scores.lexical(F.col("topic"), F.col("keywords"), F.col("content"), _QUERY)
    s = scores.recall_score(F.col("importance"), age_days(), (F.col("id") * 17 % 100) / 100, reranked, lexical, F.col("id") % 3 == 0, scores.workspace_factor(F.col("workspace"), "en"))
    return view(spark, sf_dir, "fragments").select("id", F.round(s, 6).alias("score"))


@register("k10_rerank", duckdb_sql(
    f"with top as (select id, created_h, (id * 31 % 97) / 97.0e0 as model from @fragments where valid_to_h is null order by importance desc, id limit 30) "
    f"select id, round(model * (1 + (greatest(0.1e0, 1 - {_AGE} * 0.9e0 / 365) - 0.5e0) / 5), 6) as score from top order by model * (1 + (greatest(0.1e0, 1 - {_AGE} * 0.9e0 / 365) - 0.5e0) / 5) desc, id limit 15"))  # fmt: skip
def k10(spark, sf_dir):
    top = view(spark, sf_dir, "fragments").where("valid_to_h is null").orderBy(F.desc("importance"), "id").limit(30)
    return search.rerank(top, lambda f: (F.col("id") * 31 % 97) / 97, NOW_H).select("id", F.round("reranked", 6).alias("score"))


@register("k13_cursor_page", duckdb_sql("select id from @fragments where type = 'decision' order by importance desc, id limit 10 offset 10"))
def k13(spark, sf_dir):
    offset, _ = search.from_cursor(search.cursor(10, NOW_H))
    return search.page(view(spark, sf_dir, "fragments").where("type = 'decision'"), [F.desc("importance"), "id"], offset, 10).select("id")


@register("k14_page_list", duckdb_sql("select id, (select count(*) from @fragments where type = 'fact' and importance >= 0.2 and key_id = 'k1') as total from @fragments where type = 'fact' and importance >= 0.2 and key_id = 'k1' order by created_h desc, id limit 20 offset 5"))
def k14(spark, sf_dir):
    wanted = {"type": "fact", "key_id": "k1", "workspace": None, "case_id": None, "phase": None}
    f = search.optional(view(spark, sf_dir, "fragments"), wanted).where("importance >= 0.2")
    return search.page(f, [F.desc("created_h"), "id"], 5, 20).select("id", F.lit(f.count()).alias("total"))


# inverted index


def terms_sql(most: int) -> str:
    """(id, term, rank) of extracted keywords in SQL, for texts without Hangul."""
    words = f"list_filter(string_split_regex(regexp_replace(lower(content), '[^A-Za-z0-9_\\sㄱ-ㅎ가-힣]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1 and w not in ({quoted(text.STOP_WORDS)}))"
    idents = r"regexp_extract_all(content, '\b(?:[A-Za-z][a-z0-9]*(?:[A-Z][A-Za-z0-9]*)+|[A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]+)\b')"
    both = f"select id, 0 as kind, unnest({idents}) as w, generate_subscripts({idents}, 1) as pos from @fragments union all select id, 1, unnest({words}), generate_subscripts({words}, 1) from @fragments"
    counted = f"select id, kind, w, count(*) as n, min(pos) as pos from ({both}) b group by id, kind, w"
    first = f"select id, w, row_number() over (partition by id, lower(w) order by kind, case when kind = 1 then -n else 0 end, pos) as again, kind, case when kind = 1 then -n else 0 end as m, pos from ({counted}) c"
    return f"select id, w as term, rank from (select id, w, row_number() over (partition by id order by kind, m, pos) as rank from ({first}) d where again = 1) e where rank <= {most}"


@register("x28_keywords", duckdb_sql(f"select f.id, coalesce(k.keywords, '') as keywords from @fragments f left join (select id, string_agg(term, ' ' order by rank) as keywords from ({terms_sql(5)}) t group by id) k on k.id = f.id"))
def x28(spark, sf_dir):
    return morphemes.with_keywords(view(spark, sf_dir, "fragments"), "id", "content").select("id", F.array_join("keywords", " ").alias("keywords"))


_POSTINGS = (
    f"select 'keyword' as kind, key_id as ns, lower(kw) as term, id from (select id, key_id, unnest(keywords) as kw from @fragments) k union "
    f"select 'keyword', f.key_id, t.term, f.id from ({terms_sql(8)}) t join @fragments f on f.id = t.id union "
    "select 'topic', key_id, topic, id from @fragments union select 'type', key_id, type, id from @fragments union select 'session', null, session_id, id from @fragments"
)


@register("s09_inverted_index", duckdb_sql(f"select kind, ns, term, count(*) as n, min(id) as first_id, max(id) as last_id from ({_POSTINGS}) p group by kind, ns, term"))
def s09(spark, sf_dir):
    p = index.postings(view(spark, sf_dir, "fragments"))
    return p.groupBy("kind", "ns", "term").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@register("s10_index_delete", duckdb_sql(f"select kind, count(*) as n from ({_POSTINGS}) p where id % 10 <> 3 or kind = 'session' group by kind"))
def s10(spark, sf_dir):
    f = view(spark, sf_dir, "fragments")
    return index.removed(index.postings(f), f.where("id % 10 = 3").select("id")).groupBy("kind").agg(F.count("*").alias("n"))


@register("c19_prune_index", duckdb_sql(f"select ns, term, least(count(*), 40) as kept from ({_POSTINGS}) p where kind = 'keyword' group by ns, term having count(*) > 5"))
def c19(spark, sf_dir):
    p = index.pruned(index.postings(view(spark, sf_dir, "fragments")).where("kind = 'keyword'"), 40)
    return p.groupBy("ns", "term").agg(F.count("*").alias("kept")).where("kept > 5")


@register("u05_tenant_union", duckdb_sql(f"select distinct id from ({_POSTINGS}) p where kind = 'topic' and term = 'src1' and ns in ('k0', 'k2')"))
def u05(spark, sf_dir):
    return index.lookup(index.postings(view(spark, sf_dir, "fragments")), "topic", "src1", ["k0", "k2"])


@register("u07_merge_keywords", duckdb_sql(
    "select id, array_to_string(list_concat(keywords, list_slice(list_filter(['That', 'NewOne', 'newone', 'x_' || id, topic, 'k1', 'k2', 'k3', 'k4', 'k5'], lambda k, i: not list_contains(keywords, lower(k)) and i <> 3), 1, 10 - len(keywords))), ' ') as keywords from @fragments"))
def u07(spark, sf_dir):
    more = F.array(F.lit("That"), F.lit("NewOne"), F.lit("newone"), F.concat(F.lit("x_"), "id"), F.col("topic"), *(F.lit(f"k{i}") for i in range(1, 6)))
    return view(spark, sf_dir, "fragments").select("id", F.array_join(text.merged_keywords(F.col("keywords"), more), " ").alias("keywords"))


@register("p10_context_shape", duckdb_sql(
    "select case when is_anchor then 'anchors' when source = 'learning_extraction' then 'learning' else type end as slot, count(*) as n, string_agg(cast(id as varchar), ',' order by importance desc, id) as ids from "
    "(select *, row_number() over (partition by case when is_anchor then 'anchors' when source = 'learning_extraction' then 'learning' else type end order by importance desc, id) as rn from @fragments where valid_to_h is null) x where rn <= 5 group by 1"))  # fmt: skip
def p10(spark, sf_dir):
    shape = search.context(view(spark, sf_dir, "fragments"), 5)
    return shape.select("slot", F.size("rows").cast("long").alias("n"), F.array_join(F.transform("rows", lambda r: r["id"].cast("string")), ",").alias("ids"))


@register("p11_injection_text", duckdb_sql(
    "select key_id, string_agg(section, chr(10) order by k) as body from (select key_id, k, name || chr(10) || string_agg('- ' || substring(content, 1, 60), chr(10) order by importance desc, id) as section from "
    "(select key_id, id, content, importance, case when is_anchor then 1 when importance >= 0.7 then 2 else 3 end as k, case when is_anchor then '[ANCHOR MEMORY]' when importance >= 0.7 then '[CORE MEMORY]' else '[WORKING MEMORY]' end as name, "
    "row_number() over (partition by key_id, case when is_anchor then 1 when importance >= 0.7 then 2 else 3 end order by importance desc, id) as rn from @fragments where valid_to_h is null) x where rn <= 10 group by key_id, k, name) s group by key_id"))  # fmt: skip
def p11(spark, sf_dir):
    f = view(spark, sf_dir, "fragments").where("valid_to_h is null")
    section = F.when(F.col("is_anchor"), 1).when(F.col("importance") >= 0.7, 2).otherwise(3)
    return search.injection(f.withColumn("section", section), "key_id", 10, 60).select("key_id", "body")
