"""More queries with one SQL text for both engines: gates, scores, links, change sets, reports."""

from __future__ import annotations

from tessera.plans.registry import register
from tessera.plans.shared import _for, _query
from tessera.sources.views import NOW_H, duckdb_sql

_POLARITY = "case when lower(content) like '%maybe%' or lower(content) like '%might%' then 'uncertain' when lower(content) like '% not %' or lower(content) like '% never %' then 'negative' else 'positive' end"

MORE = {
    # sources and sinks
    "s07_guarded_export": "select id, key_id, topic from @fragments where key_id = 'k1' and valid_to_h is null",
    "s08_import_skip_known": "select n.id from (select id + 500 as id from @fragments) n where not exists (select 1 from @fragments f where f.id = n.id)",
    "s11_index_warmup": "select id from @fragments where valid_to_h is null and size_kw > 0 order by created_h desc, id limit 5000",
    "s14_embedding_cache_key": "select id, substring(sha_model, 1, 16) as cache_key from (select id, sha_of as sha_model from @fragments) x",
    "s18_search_event_sink": "select id, query_type, search_path, l1_count, l2_count, l3_count, result_count, used_rrf, graph_used, latency_ms from @search_events",
    "s19_feedback_sinks": "select 'tool' as kind, count(*) as n from @tool_feedback union all select 'task', count(*) from @task_feedback",
    "s21_resources": "select 'topics' as name, count(distinct topic) as n from @fragments union all select 'sessions', count(distinct session_id) from @fragments union all select 'fragments', count(*) from @fragments",
    # projections and filters
    "p02_time_projection": "select id, topic, type, importance, created_h, session_id from @fragments where created_h < 1000",
    "f04_not_in": "select id from @fragments where topic not in ('src1', 'src2') and type <> 'episode'",
    "f23_not_superseded": "select f.id from @fragments f where not exists (select 1 from @links l where l.from_id = f.id and l.relation_type = 'superseded_by')",
    # joins
    "j03_linked_fragments": "select id, weight, relation_type from (select f.id, l.weight, l.relation_type, row_number() over (partition by f.id order by l.weight desc, l.relation_type, f.importance desc) as rn from @links l join @fragments f on f.id = l.to_id where l.from_id in (3, 14, 15) and l.relation_type in ('caused_by', 'resolved_by', 'related')) x where rn = 1 order by id limit 10",
    "j11_filter_key_counts": "select k, count(*) as n from (select explode_fk as k from @search_events, lateral_fk) x group by k",
    "j23_update_from_values": "select f.id, coalesce(v.ema, f.ema) as ema from @fragments f left join (select 3 as id, 1.5e0 as ema union all select 5, 0.25e0) v on v.id = f.id",
    "j24_edges_both_ends": "select l.from_id, l.to_id from @links l join @fragments a on a.id = l.from_id and a.key_id = 'k0' join @fragments b on b.id = l.to_id and b.key_id = 'k0'",
    "j27_hash_lookup": "select f.id, n.n_name as name from @fragments f left join @nation n on n.n_nationkey = f.case_id",
    # aggregates
    "a25_filter_keys": "select k, count(*) as n, round(avg(latency_ms), 6) as mean from (select explode_fk as k, latency_ms from @search_events, lateral_fk) x group by k",
    # windows, order
    "w01_strongest_edge": "select id, weight from (select to_id as id, weight, row_number() over (partition by to_id order by weight desc, from_id) as rn from @links) x where rn = 1",
    "w02_relation_order": "select to_id as id, relation_type from (select to_id, relation_type, row_number() over (partition by to_id order by weight desc, case relation_type when 'resolved_by' then 1 when 'caused_by' then 2 else 3 end, from_id) as rn from @links) x where rn = 1",
    "w08_top_per_group": "select topic, id from (select topic, id, row_number() over (partition by topic order by importance desc, id) as rn from @fragments) x where rn <= 3",
    "w11_layer_ranks": "select id, row_number() over (order by importance desc, id) as rank from @fragments where topic = 'src4'",
    "k04_source_search": "select id from @fragments where session_id = 's12' order by created_h desc, id limit 20",
    "k15_ranked_injection": "select id, spent from (select id, sum(tokens) over (order by case when is_anchor then 0 else 1 end, 0.6e0 * importance + 0.4e0 * ema desc, id rows between unbounded preceding and current row) as spent from @fragments where session_id = 's8') x where spent <= 3000",
    "k18_working_memory": "select id, spent from (select id, sum(length(content)) over (order by created_h desc, id rows between unbounded preceding and current row) as spent, row_number() over (order by created_h desc, id) as rn from @fragments where session_id = 's9') x where spent <= 20000 and rn <= 10",
    "k23_keyset_page": "select id from @fragments where key_id = 'k1' and id < 500 order by id desc limit 25",
    "u02_union_distinct": "select to_id as id from @links where from_id = 11 union select from_id from @links where to_id = 11",
    # graph
    "g02_linked_with_rank": "select f.id, max(l.weight) as weight from @links l join @fragments f on f.id = l.to_id where l.from_id = 77 and f.valid_to_h is null group by f.id",
    # maintenance
    # scalar
    "x42_topic_score": "select distinct topic, case when topic = 'src1' then 1.0e0 when position('src1' in topic) > 0 then 0.75e0 else 0.0e0 end as score from @fragments",
    "x43_normal_keywords": "select id, joined_kw as keywords from @fragments",
    "x44_normal_agent": "select id, coalesce(nullif(lower(trim(agent_id)), ''), 'default') as agent from @fragments",
    # change sets
    "m17_idempotency": "select content_hash, min(id) as id from @fragments group by content_hash having count(*) > 1",
    "m19_case_append": "select case_id, max(sequence_no) + 1 as next_sequence from @case_events group by case_id",
    # stateful pieces as batches
    "t04_backlog_overflow": "select id from (select id, row_number() over (partition by session_id order by us desc, id desc) as rn from @search_events) x where rn > 20",
    "t07_first_seen": "select session_id, result_count, min(us) as first_us from @search_events group by session_id, result_count",
    "t08_session_activity": "select session_id, count(*) as calls, count(distinct search_path) as paths, min(us) as first_us, max(us) as last_us from @search_events group by session_id",
}

_PER_ENGINE = {
    "spark": (("size_kw", "size(keywords)"), ("sha_of", "sha2(concat('m:', content), 256)"), ("joined_kw", "array_join(keywords, ' ')"), ("explode_fk", "fk"), (", lateral_fk", " lateral view explode(filter_keys) t as fk")),
    "duckdb": (("size_kw", "len(keywords)"), ("sha_of", "sha256('m:' || content)"), ("joined_kw", "array_to_string(keywords, ' ')"), ("explode_fk", "unnest(filter_keys)"), (", lateral_fk", "")),
}


def _adapt(engine: str, text: str) -> str:
    for a, b in _PER_ENGINE[engine]:
        text = text.replace(a, b)
    return text


for _name, _text in MORE.items():
    register(_name, duckdb_sql(_for("duckdb", _adapt("duckdb", _text))))(_query(_adapt("spark", _text)))
