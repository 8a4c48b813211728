"""Queries whose one SQL text runs on both engines: scopes, joins, aggregates, windows, paging, maintenance.

Every order has the id as its last key, nulls are placed explicitly and doubles are rounded to 6 places.
"""

from __future__ import annotations

from tessera.plans.registry import register
from tessera.sources.views import NOW_H, duckdb_sql, run_sql

DAY = 24
#: Microseconds of the events' "now", 2024-01-31.
NOW_US = 30 * 86_400_000_000

SHARED = {
    # scans, sinks
    "s05_export_rows": "select id, topic, type, importance, created_h from @fragments where topic = 'src3' and created_h >= 500 order by created_h, id limit 200",
    "s17_last_job_state": "select session_id, search_path as state, us from (select session_id, search_path, us, row_number() over (partition by session_id order by us desc, id desc) as rn from @search_events) x where rn = 1",
    # projections
    "p01_search_projection": "select id, content_hash, topic, type, importance, access_count, created_h, workspace, key_id, agent_id, case_id, resolution_status, phase, affect, tokens from @fragments",
    "p05_preview": "select id, substring(content, 1, 60) as preview60, substring(content, 1, 300) as preview300 from @fragments",
    "p06_direction": "select from_id, to_id, case when from_id = 40 then 'out' else 'in' end as direction from @links where from_id = 40 or to_id = 40",
    "p07_ellipsis": "select id, case when length(content) > 80 then substring(content, 1, 80) || '...' else content end as short from @fragments",
    "p09_graph_shape": "select f.id, substring(f.content, 1, 60) as label, count(l.to_id) as degree from @fragments f left join @links l on l.from_id = f.id group by f.id, f.content",
    # filters
    "f03_by_ids": "select id, topic from @fragments where id in (3, 5, 8, 13, 21, 34, 55, 89)",
    "f05_agent_scope": "select id, agent_id from @fragments where agent_id = 'agent1' or agent_id = 'default'",
    "f06_tenant_scope": "select id, key_id from @fragments where key_id is not distinct from 'k1' or key_id in ('k2')",
    "f07_workspace_scope": "select id, workspace from @fragments where workspace = 'en' or workspace is null",
    "f08_active": "select id from @fragments where valid_to_h is null",
    "f09_as_of": "select id, valid_from_h, valid_to_h from @fragments where valid_from_h <= 2000 and (valid_to_h is null or valid_to_h > 2000)",
    "f10_half_open_range": "select id from @fragments where created_h >= 1000 and created_h < 2000",
    "f11_closed_range": "select id from @fragments where created_h between 1000 and 2000",
    "f12_facets": "select id from @fragments where type = 'error' and importance >= 0.4 and case_id < 25 and not is_anchor and phase = 'plan'",
    "f13_affect_any": "select id, affect from @fragments where affect in ('doubt', 'surprise')",
    "f16_substring_match": "select id from @fragments where lower(content) like '%tion the%'",
    "f17_prefix_match": "select id, session_id from @fragments where session_id like 's1%'",
    "f19_null_safe": "select id, quality_verified from @fragments where quality_verified is distinct from false",
    "f22_importance_cutoff": "select id from @fragments where is_anchor or importance is null or importance >= 0.35",
    "f25_depth_types": "select id, case when type in ('decision', 'episode') then 'high' else 'tool' end as depth from @fragments where type in ('decision', 'episode', 'procedure', 'error', 'fact')",
    "f26_unseen": "select f.id from @fragments f where not exists (select 1 from @search_events e where e.id = f.id)",
    "f31_noise": "select 'short' as category, count(*) as n from @fragments where length(content) < 40 union all select 'weak', count(*) from @fragments where importance < 0.1 union all select 'stale', count(*) from @fragments where accessed_h is null and importance < 0.3",
    "f33_stale_by_type": f"select id, type, ({NOW_H} - coalesce(verified_h, created_h)) // 24 as days from @fragments where valid_to_h is null and ({NOW_H} - coalesce(verified_h, created_h)) // 24 >= case type when 'procedure' then 30 when 'fact' then 60 when 'decision' then 90 else 60 end order by days desc, id limit 20",
    "f40_size_cap": "select id, length(content) as chars from @fragments where length(content) > 4000",
    "f47_consolidation_gate": "select n_new >= 100 or n_pending >= 50 or n_dup >= 5 as fire, n_new, n_pending, n_dup from (select count(*) filter (where created_h > 4000) as n_new, count(*) filter (where quality_verified is null) as n_pending, count(*) - count(distinct content_hash) as n_dup from @fragments) x",
    # joins
    "j01_link_targets": "select l.from_id, l.relation_type, f.id, f.type from @links l join @fragments f on f.id = l.to_id where l.relation_type = 'superseded_by'",
    "j04_computed_key": "select f.id, o.direction, o.weight from (select case when from_id = 40 then to_id else from_id end as other, case when from_id = 40 then 'out' else 'in' end as direction, weight from @links where from_id = 40 or to_id = 40) o join @fragments f on f.id = o.other",
    "j05_key_names": "select f.id, f.key_id, k.name from @fragments f left join @api_keys k on k.key_id = f.key_id",
    "j06_outer_with_filter": "select k.key_id, coalesce(u.calls, 0) as calls from @api_keys k left join (select key_id, count(*) as calls from @search_events where us >= 86400000000 and us < 172800000000 group by key_id) u on u.key_id = k.key_id where k.group_id < 3",
    "j09_group_closure": "select distinct b.key_id from @api_keys a join @api_keys b on b.group_id = a.group_id where a.key_id = 'k1'",
    "j10_top3_links": "select from_id, to_id, weight, rn from (select from_id, to_id, weight, row_number() over (partition by from_id order by weight desc, to_id) as rn from @links) x where rn <= 3",
    "j12_isolated": "select f.id from @fragments f where not exists (select 1 from @links l where l.from_id = f.id and l.relation_type = 'contradicts') and not exists (select 1 from @links l where l.to_id = f.id and l.relation_type = 'contradicts')",
    "j13_pending_contradiction": "select count(*) > 0 as pending from @links l where l.relation_type = 'contradicts' and exists (select 1 from @fragments f where f.id = l.from_id and f.valid_to_h is null) and exists (select 1 from @fragments f where f.id = l.to_id and f.valid_to_h is null)",
    "j14_semi_in": "select id from @fragments where case_id in (select case_id from @fragments where type = 'error' and importance > 0.95)",
    "j20_interval_neighbours": "select a_id, b_id, round(greatest(0.3e0, 1 - dh / 24.0e0), 6) as weight from (select a.id as a_id, b.id as b_id, abs(a.created_h - b.created_h) as dh, row_number() over (partition by a.id order by abs(a.created_h - b.created_h), b.id) as rn from @fragments a join @fragments b on b.topic = a.topic and b.id <> a.id and b.created_h between a.created_h - 24 and a.created_h + 24) x where rn <= 5",
    "j21_nearby_context": "select a_id, b_id from (select a.id as a_id, b.id as b_id, row_number() over (partition by a.id order by abs(a.us - b.us), b.id) as rn from @search_events a join @search_events b on b.session_id = a.session_id and b.id <> a.id and abs(a.us - b.us) < 1800000000) x where rn <= 3",
    "j25_count_per_key": "select k.key_id, coalesce(c.n, 0) as fragments from @api_keys k left join (select key_id, count(*) as n from @fragments group by key_id) c on c.key_id = k.key_id where k.group_id = 0",
    "j26_last_milestone": "select case_id, event_id from (select case_id, event_id, row_number() over (partition by case_id order by us desc, event_id desc) as rn from @case_events where event_type = 'milestone_reached') x where rn = 1",
    "j28_co_retrieval": "select a_id, b_id, count(*) as weight from (select a.id as a_id, b.id as b_id from (select session_id, result_count as id, row_number() over (partition by session_id order by us, id) as rn from @search_events) a join (select session_id, result_count as id, row_number() over (partition by session_id order by us, id) as rn from @search_events) b on a.session_id = b.session_id and a.rn <= 5 and b.rn <= 5 and a.rn < b.rn) x group by a_id, b_id",
    "j29_session_detail": "select id, search_path, result_count from @search_events where session_id = '7' or session_id like '7#%' order by us desc, id limit 20",
    "j30_inspect_links": "select dir, other, weight from (select 'out' as dir, to_id as other, weight from @links where from_id = 11 union all select 'in', from_id, weight from @links where to_id = 11) x",
    # aggregates
    "a02_tool_feedback": "select tool_name, count(*) as total, count(*) filter (where relevant) as relevant, count(*) filter (where not relevant) as irrelevant, count(*) filter (where sufficient) as sufficient, count(*) filter (where trigger_type = 'sampled') as sampled, count(*) filter (where trigger_type = 'voluntary') as voluntary, count(*) filter (where relevant and sufficient) as both_good from @tool_feedback group by tool_name",
    "a03_task_feedback": "select count(*) as total, count(*) filter (where overall_success) as success, count(*) filter (where outcome = 'completed') as completed, count(*) filter (where unmet > 0) as with_unmet from @task_feedback",
    "a04_global_stats": f"select count(*) as total, count(*) filter (where ttl_tier = 'permanent') as permanent, count(*) filter (where ttl_tier = 'hot') as hot, count(*) filter (where ttl_tier = 'warm') as warm, count(*) filter (where ttl_tier = 'cold') as cold, count(*) filter (where is_anchor) as anchors, count(*) filter (where valid_to_h is not null) as expired, count(distinct topic) as topics, count(distinct session_id) as sessions, round(avg(importance), 6) as avg_importance, round(avg(access_count), 6) as avg_access, sum(tokens) as tokens, count(*) filter (where quality_verified) as verified, count(*) filter (where quality_verified is null) as unverified, count(*) filter (where created_h >= {NOW_H} - 720) as last_30d from @fragments",
    "a05_count_by_topic": "select topic, count(*) as n from @fragments group by topic order by n desc, topic limit 50",
    "a06_type_tier": "select type, ttl_tier, count(*) as n, round(avg(importance), 6) as avg_importance from @fragments group by type, ttl_tier",
    "a07_topics": "select distinct topic from @fragments",
    "a08_distinct_counts": "select count(distinct topic) as topics, count(distinct workspace) as workspaces, count(distinct case_id) as cases from @fragments",
    "a09_duplicate_groups": "select key_id, workspace, content_hash, count(*) as n, min(id) as keep_id from @fragments group by key_id, workspace, content_hash having count(*) > 1",
    "a10_large_topics": "select topic, count(*) as n from @fragments where valid_to_h is null group by topic having count(*) >= 5",
    "a11_session_all_relevant": "select session_id, bool_and(relevant) as all_relevant, count(*) as n from @tool_feedback group by session_id having count(*) >= 2",
    "a12_possible_supersessions": "select count(*) as groups from (select topic, type from @fragments where valid_to_h is null group by topic, type having count(*) >= 3) x",
    "a15_latency_percentiles": "select round(percentile_cont(0.5) within group (order by latency_ms), 6) as p50, round(percentile_cont(0.9) within group (order by latency_ms), 6) as p90, round(percentile_cont(0.99) within group (order by latency_ms), 6) as p99, round(avg(latency_ms), 6) as mean from @search_events",
    "a16_session_sizes": "select percentile_disc(0.5) within group (order by n) as p50, percentile_disc(0.9) within group (order by n) as p90, percentile_disc(0.99) within group (order by n) as p99, max(n) as most from (select session_id, count(*) as n from @fragments group by session_id) x",
    "a17_floor_percentiles": "select layer, n, max(case when rn = least(n, cast(floor(n * 0.5e0) as bigint) + 1) then v end) as p50, max(case when rn = least(n, cast(floor(n * 0.9e0) as bigint) + 1) then v end) as p90, max(case when rn = least(n, cast(floor(n * 0.99e0) as bigint) + 1) then v end) as p99 from (select layer, v, row_number() over (partition by layer order by v, id) as rn, count(*) over (partition by layer) as n from (select search_path as layer, latency_ms as v, id, row_number() over (partition by search_path order by us desc, id desc) as recent from @search_events) a where recent <= 100) b group by layer, n",
    "a18_bucket_quantile": "select min(round(lo + (hi - lo) * (0.9e0 * total - before) / n, 6)) as p90 from (select hi, lo, n, total, before, before + n as after from (select b * 10 + 10.0e0 as hi, b * 10.0e0 as lo, n, sum(n) over () as total, coalesce(sum(n) over (order by b rows between unbounded preceding and 1 preceding), 0) as before from (select cast(floor(latency_ms / 10) as bigint) as b, count(*) as n from @search_events group by cast(floor(latency_ms / 10) as bigint)) x) y) z where after >= 0.9e0 * total and before < 0.9e0 * total",
    "a19_rolling_precision": "select round(avg(least(good, 5) / cast(least(n, 5) as double)), 6) as precision_at_5, count(*) as sessions from (select session_id, count(*) as n, count(*) filter (where relevant) as good, row_number() over (order by max(us) desc, session_id) as rn from @tool_feedback group by session_id) x where rn <= 50",
    "a20_precision_at_k": "select session_id, round(avg(case when relevant then 1.0e0 else 0.0e0 end), 6) as p_at_5 from (select session_id, relevant, row_number() over (partition by session_id order by us, id) as rn from @tool_feedback) x where rn <= 5 group by session_id",
    "a21_task_rates": "select round(count(*) filter (where overall_success) / cast(nullif(count(*), 0) as double), 6) as success_rate, round(count(*) filter (where outcome = 'completed') / cast(nullif(count(*), 0) as double), 6) as completed_rate from @task_feedback",
    "a22_irrelevance": "select irrelevance_reason, count(*) as n from @tool_feedback where not relevant group by irrelevance_reason",
    "a23_search_overview": "select count(*) as total, round(avg(result_count), 6) as avg_results, round(avg(latency_ms), 6) as avg_latency, round(avg(case when used_rrf then 1.0e0 else 0.0e0 end), 6) as rrf_rate, round(avg(case when graph_used then 1.0e0 else 0.0e0 end), 6) as graph_rate, round(avg(case when l1_is_fallback then 1.0e0 else 0.0e0 end), 6) as fallback_rate from @search_events",
    "a24_relevance_by_type": "select e.query_type, e.used_rrf, count(*) as n, count(f.id) as rated, count(*) filter (where f.relevant) as relevant from @search_events e left join @tool_feedback f on f.search_event_id = e.id group by e.query_type, e.used_rrf",
    "a26_path_performance": "select search_path, used_rrf, count(*) as n, round(avg(latency_ms), 6) as latency, round(avg(result_count), 6) as results, round(avg(l1_count), 6) as l1, round(avg(l2_count), 6) as l2, round(avg(l3_count), 6) as l3 from @search_events group by search_path, used_rrf",
    "a27_l1_miss": "select case when count(*) = 0 then null else round(avg(case when l1_count = 0 then 1.0e0 else 0.0e0 end), 6) end as miss_rate from @search_events",
    "a28_max_group": "select max(n) as most from (select topic, count(*) as n from @fragments group by topic) x",
    "a29_workspaces": "select workspace, n from (select workspace, count(*) as n, row_number() over (order by count(*) desc, workspace) as rn from @fragments where workspace is not null group by workspace) x where rn <= 20 union all select null, count(*) from @fragments where workspace is null",
    "a30_workspace_fill": "select key_id, count(*) as total, count(workspace) as filled, round(count(workspace) / cast(count(*) as double), 6) as rate from @fragments group by key_id",
    "a31_key_stats": "select key_id, count(*) as total, count(*) filter (where type = 'fact') as facts, count(*) filter (where type = 'decision') as decisions, count(*) filter (where type = 'error') as errors, count(*) filter (where type = 'procedure') as procedures, count(*) filter (where is_anchor) as anchors, count(*) filter (where valid_to_h is null) as active, count(*) filter (where workspace is null) as unscoped, count(distinct topic) as topics from @fragments group by key_id",
    "a32_majority_vote": "select topic, workspace, n from (select topic, workspace, count(*) as n, sum(count(*)) over (partition by topic) as total, row_number() over (partition by topic order by count(*) desc, workspace) as rn from @fragments where workspace is not null group by topic, workspace) x where rn = 1 and n >= 0.4e0 * total",
    "a34_case_frequency": "select case_id, count(*) as n from @fragments where topic = 'src2' group by case_id order by n desc, case_id limit 10",
    "a35_daily_usage": "select key_id, us // 86400000000 as day, count(*) as calls from @search_events group by key_id, us // 86400000000",
    "a37_counter_rates": "select key_id, day, calls, greatest(0, calls - lag(calls) over (partition by key_id order by day)) as delta from (select key_id, us // 86400000000 as day, count(*) as calls from @search_events group by key_id, us // 86400000000) x",
    "a38_zero_hits": "select query_type, count(*) as n, round(avg(case when result_count = 0 then 1.0e0 else 0.0e0 end), 6) as zero_rate from @search_events group by query_type",
    "a39_recall_quality": "select round(100.0e0 * count(*) filter (where quality_verified) / nullif(count(*), 0), 6) as verified_pct, round(100.0e0 * count(*) filter (where accessed_h is not null) / nullif(count(*), 0), 6) as accessed_pct, round(100.0e0 * count(*) filter (where workspace is null) / nullif(count(*), 0), 6) as unscoped_pct from @fragments",
    "a40_group_members": "select n.n_nationkey as group_id, count(k.key_id) as members from @nation n left join @api_keys k on k.group_id = n.n_nationkey group by n.n_nationkey",
    "a44_calls_today": f"select coalesce(sum(calls), 0) as calls from (select count(*) as calls from @search_events where us >= {NOW_US} - 172800000000 and us < {NOW_US} - 86400000000 group by key_id) x",
    # windows
    "w03_keep_per_type": "select id, type, rn from (select id, type, row_number() over (partition by type order by importance desc, created_h desc, id) as rn from @fragments) x where rn > 5",
    "w05_sequence_numbers": "select event_id, case_id, sequence_no from @case_events",
    "w06_best_per_hash": "select content_hash, id from (select content_hash, id, row_number() over (partition by content_hash order by importance desc nulls last, id) as rn from @fragments) x where rn = 1",
    "w07_running_budget": "select id, cost from (select id, tokens, sum(tokens) over (order by importance desc, id rows between unbounded preceding and current row) as cost from @fragments where topic = 'src5') x where cost <= 2000",
    # order, limit, paging
    "k02_topic_search": "select id, importance, created_h from @fragments where topic = 'src7' and valid_to_h is null order by importance desc nulls last, created_h desc, id limit 20",
    "k03_time_search": "select id, created_h from @fragments where created_h >= 100 and created_h < 3000 and valid_to_h is null order by created_h desc, id limit 30",
    "k05_by_ids_order": "select session_id, id, row_number() over (partition by session_id order by importance desc, accessed_h desc nulls last, id) as place from @fragments",
    "k17_anchors": "select id, importance from @fragments where is_anchor and valid_to_h is null order by importance desc, id limit 10",
    "k20_recent": "select id from @fragments order by created_h desc, id limit 50",
    "k21_case_order": "select case_id, resolved, relevance from (select case_id, max(case when resolution_status = 'resolved' then 1 else 0 end) as resolved, round(sum(importance), 6) as relevance from @fragments group by case_id) x order by resolved desc, relevance desc, case_id limit 10",
    "k22_first_wins": "select id, min(layer_no) as layer_no from (select id, 1 as layer_no from @fragments where topic = 'src1' union all select id, 2 from @fragments where type = 'error' union all select id, 3 from @fragments where importance > 0.9) x group by id",
    # sets
    "u01_both_directions": "select id, count(*) as degree from (select from_id as id from @links union all select to_id from @links) x group by id",
    "u03_intersection": "select id from @fragments where topic = 'src1' intersect select id from @fragments where importance >= 0.5",
    "u06_difference": "select id from @fragments where topic = 'src1' except select id from @fragments where importance >= 0.5",
    # graph
    "g03_root_cause": "select 0 as depth, id, cast(null as varchar(20)) as relation from @fragments where id = 30 union select 1, f.id, l.relation_type from @links l join @fragments f on f.id = l.to_id where l.from_id = 30 and l.relation_type in ('caused_by', 'resolved_by')",
    "g14_supersede_chain": "select l.from_id as id, l.to_id as newer from @links l join @fragments f on f.id = l.to_id where l.relation_type = 'superseded_by'",
    "g15_episode_continuity": "select event_id as to_event, lag(event_id) over (partition by case_id order by us, event_id) as from_event from @case_events where event_type = 'milestone_reached'",
    # maintenance
    # scalar functions
    "x21_token_estimate": "select id, (length(content) + 3) // 4 as tokens from @fragments",
    # writes as change sets
    # batch forms of stateful pieces
    "t09_rate_window": "select id, n from (select id, count(*) over (partition by session_id order by us range between 60000000 preceding and current row) as n from @search_events) x",
    "t13_latency_ring": "select search_path, count(*) as kept, round(avg(latency_ms), 6) as mean from (select search_path, latency_ms, row_number() over (partition by search_path order by us desc, id desc) as rn from @search_events) x where rn <= 100 group by search_path",
    "t14_metric_windows": "select us // 5000000 as slot, count(*) as n, round(avg(latency_ms), 6) as mean from @search_events group by us // 5000000",
}

#: How each engine unnests the keywords of a fragment.
UNNEST = {
    "spark": (("explode_kw", "kw"), (", lateral_kw", " lateral view explode(keywords) t as kw")),
    "duckdb": (("explode_kw", "unnest(keywords)"), (", lateral_kw", "")),
}


def _for(engine: str, text: str) -> str:
    for a, b in UNNEST[engine]:
        text = text.replace(a, b)
    return text


def _query(text: str):
    def run(spark, sf_dir):
        return run_sql(spark, sf_dir, _for("spark", text))

    return run


for _name, _text in SHARED.items():
    register(_name, duckdb_sql(_for("duckdb", _text)))(_query(_text))
