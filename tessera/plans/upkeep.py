"""Maintenance stages, write flows, links and reports: library operators held against SQL written apart from them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import scores, text
from tessera.operators import consolidate, graph, knn, write
from tessera.plans.core import _BOTH, _CAUSAL, _CHAINS, _PAIRS, recursive
from tessera.plans.registry import register
from tessera.plans.scoring import _AGE, _HALF, _UTILITY
from tessera.sources.views import NOW_H, duckdb_sql, view
from tessera.streaming import adaptive


def snapshot(spark, sf_dir) -> consolidate.Snapshot:
    return consolidate.Snapshot(*(view(spark, sf_dir, n) for n in ("fragments", "links", "vectors")), NOW_H)


# maintenance stages

_IDLE = lambda d: f"(accessed_h is null or accessed_h < {NOW_H - 24 * d})"
_TIER1 = "case when type = 'preference' or coalesce(d.n, 0) >= 5 or (importance >= 0.8 and quality_verified is not false and (quality_verified or is_anchor or importance >= 0.9)) then 'permanent' else ttl_tier end"


@register("c01_ttl_transition", duckdb_sql(
    f"select id, case when tier = 'permanent' and not is_anchor and importance < 0.5 and {_IDLE(180)} then 'cold' else tier end as tier from (select *, case when t1 = 'warm' and (importance < 0.3 or (accessed_h is null and {_AGE} > 30) or accessed_h < {NOW_H - 720}) then 'cold' else t1 end as tier "
    f"from (select f.*, {_TIER1} as t1 from @fragments f left join (select from_id, count(*) as n from @links group by from_id) d on d.from_id = f.id) x) y"))  # fmt: skip
def c01(spark, sf_dir):
    return consolidate.ttl_transition(snapshot(spark, sf_dir)).fragments.select("id", F.col("ttl_tier").alias("tier"))


@register("c02_importance_decay", duckdb_sql(
    f"select id, round(case when is_anchor or ttl_tier = 'permanent' then importance else greatest(0.05e0, importance * power(2.0e0, -({NOW_H} - coalesce(accessed_h, created_h)) / (24.0e0 * {_HALF} * least(2, 1 + ema / 2)))) end, 6) as decayed from @fragments"))
def c02(spark, sf_dir):
    return consolidate.importance_decay(snapshot(spark, sf_dir)).fragments.select("id", F.round("importance", 6).alias("decayed"))


_BRANCHES = (
    f"(u < 0.15 and {_IDLE(60)}) or (type in ('fact', 'decision') and importance < 0.2 and access_count = 0 and f.id not in (select from_id from @links union select to_id from @links) and {_AGE} > 30) "
    f"or (importance < 0.1 and {_IDLE(90)} and {_AGE} > 90 and coalesce(d.n, 0) < 2) or (type = 'error' and starts_with(content, '[해결됨]') and {_AGE} > 30 and importance < 0.3) or (type is null and importance < 0.2)"
)
_GARBAGE = f"from (select *, {_UTILITY} as u from @fragments) f left join (select from_id, count(*) as n from @links group by from_id) d on d.from_id = f.id where ttl_tier <> 'permanent' and not is_anchor and {_AGE} > 7"
_PARENT = "not exists (select 1 from @fragments c where c.source = 'split:' || cast(f.id as varchar(19)))"


@register("f34_gc_candidates", duckdb_sql(f"select id, round(u, 6) as utility {_GARBAGE} and {_PARENT} and ({_BRANCHES}) order by u, id limit 50"))
def f34(spark, sf_dir):
    return consolidate.garbage(snapshot(spark, sf_dir)).orderBy("utility", "id").limit(50).select("id", F.round("utility", 6).alias("utility"))


@register("f35_gc_orphans", duckdb_sql(
    f"select id {_GARBAGE} and ({_BRANCHES} or (source like 'split:%' and importance < 0.3 and access_count = 0 and {_IDLE(30)} and {_AGE} > 30) "
    "or (source like 'split:%' and not exists (select 1 from @fragments p where cast(p.id as varchar(19)) = split_part(f.source, ':', 2) and p.valid_to_h is null)))"))  # fmt: skip
def f35(spark, sf_dir):
    return consolidate.garbage(snapshot(spark, sf_dir), split_children=True).select("id")


@register("f43_orphan_children", duckdb_sql(
    "select f.id from @fragments f where source like 'split:%' and importance < 0.4 and access_count = 0 and split_part(source, ':', 2) not in (select cast(id as varchar(19)) from @fragments where valid_to_h is null)"))
def f43(spark, sf_dir):
    f = view(spark, sf_dir, "fragments")
    child = f.where("source like 'split:%' and importance < 0.4 and access_count = 0").select("id", F.split_part("source", F.lit(":"), F.lit(2)).alias("parent"))
    return child.join(f.where("valid_to_h is null").select(F.col("id").cast("string").alias("parent")), "parent", "left_anti").select("id")


@register("c03_expired_delete", duckdb_sql(f"select id from @fragments where id not in (select id from (select id {_GARBAGE} and {_PARENT} and ({_BRANCHES}) order by u, id limit 50) g)"))
def c03(spark, sf_dir):
    return consolidate.expired_delete(snapshot(spark, sf_dir)).fragments.select("id")


@register("c04_gc_preview", duckdb_sql(f"select type, count(*) as n {_GARBAGE} and {_PARENT} and ({_BRANCHES}) group by type"))
def c04(spark, sf_dir):
    return consolidate.gc_preview(snapshot(spark, sf_dir))


@register("c05_split_long", duckdb_sql(
    f"with c as (select id, content, type, importance from @fragments where length(content) > 300 and valid_to_h is null and not is_anchor and coalesce(source, '') not like 'split:%' and coalesce(split_failed_h, 0) < {NOW_H} - 24 order by length(content) desc, id limit 10), "
    "s as (select id, type, importance, content, list_slice(list_filter(list_transform(string_split_regex(regexp_replace(content, '([.!?])\\s+', '\\1\n', 'g'), '\n+'), lambda t: trim(t)), lambda t: t <> ''), 1, 8) as parts from c), "
    "p as (select id, content, unnest(range(len(parts))) as part, unnest(parts) as txt, floor(importance * 0.7e0 * 100 + 0.5e0) / 100 as child, type from s), "
    "g as (select * from p where length(trim(txt, ' \t\n\r')) >= 20 and not (type = 'fact' and child < 0.4)), "
    "ok as (select id from g group by id, content having count(*) >= 2 and len(list_filter(regexp_extract_all(content, '[0-9]+(?:[.,:/-][0-9]+)*%?'), lambda a: not contains(string_agg(txt, ' ' order by part), a))) = 0) "
    "select id as parent, part, length(txt) as chars, child as importance from g where id in (select id from ok)"))  # fmt: skip
def c05(spark, sf_dir):
    p = consolidate.split_pieces(snapshot(spark, sf_dir), ["session_reflect"])
    return p.select("parent", F.col("part").cast("long").alias("part"), F.length("text").cast("long").alias("chars"), "importance")


@register("c06_merge_duplicates", duckdb_sql("select id from (select id, row_number() over (partition by key_id, workspace, content_hash order by importance desc, created_h, id) as rn from @fragments) x where rn = 1"))
def c06(spark, sf_dir):
    return consolidate.merge_duplicates(snapshot(spark, sf_dir)).fragments.select("id")


@register("c06_merged_links", duckdb_sql(
    "with k as (select id, first_value(id) over (partition by key_id, workspace, content_hash order by importance desc, created_h, id) as keep from @fragments) "
    "select coalesce(a.keep, l.from_id) as from_id, coalesce(b.keep, l.to_id) as to_id, max(weight) as weight from @links l left join k a on a.id = l.from_id left join k b on b.id = l.to_id where coalesce(a.keep, l.from_id) <> coalesce(b.keep, l.to_id) group by 1, 2"))  # fmt: skip
def c06_links(spark, sf_dir):
    return consolidate.merge_duplicates(snapshot(spark, sf_dir)).links.select("from_id", "to_id", "weight")


@register("c09_embedding_backfill", duckdb_sql(
    "select id, round(a / sqrt(a * a + b * b), 6) as x, round(b / sqrt(a * a + b * b), 6) as y from (select id, cast(importance + 1 as double) as a, cast(id % 10 + 1 as double) as b from @fragments f where id not in (select vec_id from @embeddings) order by importance desc, id limit 100) t"))
def c09(spark, sf_dir):
    f = view(spark, sf_dir, "fragments")
    rows = consolidate.without_embedding(f, view(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")))
    made = consolidate.embedded(rows, lambda text_of: F.array(F.col("importance") + 1, F.col("id") % 10 + F.lit(1.0)))
    return made.select("id", F.round(F.get("embedding", F.lit(0)), 6).alias("x"), F.round(F.get("embedding", F.lit(1)), 6).alias("y"))


_ALONE = "select f.id, f.type, f.created_h, f.content from @fragments f where f.id in (select id from @vectors) and f.id not in (select from_id from @links union select to_id from @links) order by f.created_h desc, f.id limit 20"
_NEAR = (
    f"select b.neighbour as from_id, n.id as to_id, n.type as nt, n.created_h as nh, n.content, o.type as ot, o.created_h as oh, b.s, row_number() over (partition by n.id order by b.s desc, b.neighbour) as rn from ({_ALONE}) n join ({_BOTH}) b on b.id = n.id join @fragments o on o.id = b.neighbour where b.s > 0.7"
)


@register("g13_isolated_batch", duckdb_sql(f"select id from ({_ALONE}) a"))
def g13(spark, sf_dir):
    return consolidate.isolated(snapshot(spark, sf_dir))


@register("c10_retro_link", duckdb_sql(
    f"select from_id, to_id, case when nt = ot and s > 0.85 and nh > oh then 'superseded_by' when nt = 'error' and ot = 'error' and (contains(content, '[해결됨]') or contains(content, 'resolved')) then 'resolved_by' else 'related' end as relation_type from ({_NEAR}) x where rn <= 3"))
def c10(spark, sf_dir):
    s = snapshot(spark, sf_dir)
    return consolidate.linked_to_nearest(s, consolidate.isolated(s)).select("from_id", "to_id", "relation_type")


@register("c11_utility", duckdb_sql(f"select id, round({_UTILITY}, 6) as utility from @fragments"))
def c11(spark, sf_dir):
    return consolidate.utility_scores(snapshot(spark, sf_dir)).fragments.select("id", F.round("utility_score", 6).alias("utility"))


@register("c12_requeue", duckdb_sql("select id, ema from @fragments where ema > 0.3 and importance < 0.4 and quality_verified is null and ttl_tier <> 'permanent' order by ema desc, id limit 20"))
def c12(spark, sf_dir):
    return consolidate.requeue(snapshot(spark, sf_dir))


@register("c13_promote_anchors", duckdb_sql("select id from @fragments where is_anchor or (access_count >= 10 and importance >= 0.8)"))
def c13(spark, sf_dir):
    return consolidate.promote_anchors(snapshot(spark, sf_dir)).fragments.where("is_anchor").select("id")


def _nli(pairs):
    """A stand-in for an inference model."""
    c = F.pmod(F.col("id") * 7 + F.col("other") * 3, F.lit(100)) / 100
    return F.struct(c.alias("contradiction"), ((1 - c) * 0.7).alias("entailment"), F.lit(0.2).alias("neutral"))


_CONTRA = (
    "with n as (select f.id, f.key_id from @fragments f where f.id in (select id from @vectors) order by f.created_h desc, f.id limit 20), "
    f"x as (select n.id, b.neighbour as other, row_number() over (partition by n.id order by b.s desc, b.neighbour) as rn from n join ({_BOTH}) b on b.id = n.id join @fragments o on o.id = b.neighbour and o.key_id is not distinct from n.key_id where b.s > 0.85 and not exists "
    "(select 1 from @links l where l.relation_type = 'contradicts' and ((l.from_id = n.id and l.to_id = b.neighbour) or (l.from_id = b.neighbour and l.to_id = n.id)))), "
    "v as (select id, other, (id * 7 + other * 3) % 100 / 100.0e0 as c from x where rn <= 3) "
)


@register("c14_contradictions", duckdb_sql(_CONTRA + "select id, other, case when c >= 0.8 then true when (1 - c) * 0.7e0 >= 0.6 then false else c >= 0.5 end as contradicts, case when c >= 0.8 or (1 - c) * 0.7e0 >= 0.6 then false when c >= 0.5 then true else c >= 0.2 end as escalate from v"))
def c14(spark, sf_dir):
    return consolidate.contradictions(snapshot(spark, sf_dir), _nli).select("id", "other", "contradicts", "escalate")


_LOST = (
    "sides as (select v.id, v.other, a.created_h > b.created_h as newer, b.is_anchor from w v join @fragments a on a.id = v.id join @fragments b on b.id = v.other and b.key_id is not distinct from a.key_id), "
    "lost as (select case when newer then other else id end as id, sum(case when newer and is_anchor then 0 else 1 end) as halvings from sides group by 1) "
    f"select f.id, round(f.importance / power(2, halvings), 6) as importance, coalesce(f.valid_to_h, {NOW_H}) as valid_to_h from @fragments f join lost on lost.id = f.id"
)


@register("c14_resolved", duckdb_sql(_CONTRA + ", w as (select id, other from v where c >= 0.8), " + _LOST))
def c14_resolved(spark, sf_dir):
    s = snapshot(spark, sf_dir)
    after = consolidate.detect_contradictions(s, _nli)
    lost = after.links.join(s.links.select("from_id", "to_id", "relation_type"), ["from_id", "to_id", "relation_type"], "left_anti").where("relation_type = 'superseded_by'").select(F.col("from_id").alias("id")).distinct()
    return after.fragments.join(lost, "id", "left_semi").select("id", F.round("importance", 6).alias("importance"), "valid_to_h")


_SUPER = (
    f"select p.a, p.b, p.similarity from ({_PAIRS}) p join @fragments f on f.id = p.a and f.valid_to_h is null join @fragments g on g.id = p.b and g.valid_to_h is null and g.type = f.type and g.key_id is not distinct from f.key_id "
    "where similarity between 0.7 and 0.85 and not exists (select 1 from @links l where (l.from_id = p.a and l.to_id = p.b) or (l.from_id = p.b and l.to_id = p.a)) order by p.similarity desc, p.a, p.b limit 10"
)


@register("c15_supersede_apply", duckdb_sql(
    f"with o as (select distinct case when f.created_h < g.created_h then a else b end as id from ({_SUPER}) p join @fragments f on f.id = p.a join @fragments g on g.id = p.b where (p.a + p.b) % 3 <> 0) "
    f"select f.id, round(greatest(0.05e0, f.importance / 2), 6) as importance, {NOW_H} as valid_to_h from @fragments f join o on o.id = f.id"))  # fmt: skip
def c15(spark, sf_dir):
    s = snapshot(spark, sf_dir)
    after = consolidate.detect_supersessions(s, lambda pairs: (F.col("a") + F.col("b")) % 3 != 0)
    expired = s.fragments.where("valid_to_h is null").select("id")
    return after.fragments.join(expired, "id", "left_semi").where("valid_to_h is not null").select("id", F.round("importance", 6).alias("importance"), "valid_to_h")


@register("c16_pending", duckdb_sql("with q as (select from_id as id, to_id as other from @links where relation_type = 'contradicts' order by from_id, to_id limit 10), w as (select * from q where (id + other) % 2 = 0), " + _LOST))
def c16(spark, sf_dir):
    s = snapshot(spark, sf_dir)
    pending = s.links.where("relation_type = 'contradicts'").select(F.concat_ws(":", F.lpad("from_id", 12, "0"), F.lpad("to_id", 12, "0")).alias("place"), F.col("from_id").alias("id"), F.col("to_id").alias("other"))
    after, _ = consolidate.process_pending(s, pending, lambda pairs: (F.col("id") + F.col("other")) % 2 == 0)
    new = after.links.where("relation_type = 'superseded_by'").join(s.links.where("relation_type = 'superseded_by'"), ["from_id", "to_id"], "left_anti")
    lost = new.select(F.col("from_id").alias("id")).distinct()
    return after.fragments.join(lost, "id", "left_semi").select("id", F.round("importance", 6).alias("importance"), "valid_to_h")


@register("c17_feedback_report", duckdb_sql(
    "select '# Feedback report' || chr(10) || chr(10) || '| tool | trigger | n | relevant | sufficient |' || chr(10) || '|---|---|---|---|---|' || chr(10) || "
    "(select string_agg('| ' || tool_name || ' | ' || trigger_type || ' | ' || n || ' | ' || format('{:.1f}', r * 100) || '% | ' || format('{:.1f}', s * 100) || '% |', chr(10) order by tool_name, trigger_type) from "
    "(select tool_name, trigger_type, count(*) as n, avg(relevant::int) as r, avg(sufficient::int) as s from @tool_feedback group by all) t) || chr(10) || chr(10) || "
    "(select 'Tasks: ' || count(*) || ', successful ' || format('{:.1f}', avg(overall_success::int) * 100) || '%' from @task_feedback) || chr(10) as report"))  # fmt: skip
def c17(spark, sf_dir):
    made = consolidate.report(view(spark, sf_dir, "tool_feedback"), view(spark, sf_dir, "task_feedback"))
    return spark.createDataFrame([(made,)], "report string")


@register("c18_feedback_calibration", duckdb_sql(
    "with s as (select session_id, case when bool_and(relevant) and bool_and(sufficient) then 1.1e0 when bool_and(relevant) then 0.95e0 else 0.85e0 end as k from @tool_feedback group by session_id having count(*) >= 2), "
    "act as (select session_id, id from (select substring(session_id, 2) as session_id, id, row_number() over (partition by session_id order by created_h, id) as place from @fragments) x where place <= 20), "
    "m as (select id, product(k) as k from act join s using (session_id) group by id), "
    "o as (select f.*, case when is_anchor or m.k is null then importance else least(1.0e0, greatest(0.05e0, importance * m.k)) end as once from @fragments f left join m on m.id = f.id) "
    f"select id, round(case when not is_anchor and valid_to_h is null and access_count = 0 and {_AGE} > 90 then greatest(0.05e0, once / 2) else once end, 6) as calibrated from o"))  # fmt: skip
def c18(spark, sf_dir):
    s = snapshot(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("created_h", "id"))
    activity = s.fragments.withColumn("place", place).select(F.substring("session_id", 2, 19).alias("session_id"), "id", "place")
    return consolidate.calibrate(s, view(spark, sf_dir, "tool_feedback"), activity).fragments.select("id", F.round("importance", 6).alias("calibrated"))


@register("c20_stale", duckdb_sql(
    f"select id, case when length(content) > 80 then left(content, 80) || '...' else content end as short, type, ({NOW_H} - verified_h) // 24 as days from @fragments where {NOW_H} - verified_h > 24 * case type when 'procedure' then 30 when 'decision' then 90 else 60 end order by days desc, id limit 20"))
def c20(spark, sf_dir):
    return consolidate.stale(snapshot(spark, sf_dir))


@register("c21_purge_reflections", duckdb_sql(
    f"select id from (select *, row_number() over (partition by type order by importance desc, created_h desc, id) as rn from @fragments where topic = 'src3') x where rn > 5 and {_AGE} > 30 and importance < 0.55 and not is_anchor and ttl_tier <> 'permanent' order by importance, id limit 30"))
def c21(spark, sf_dir):
    return consolidate.stale_reflections(snapshot(spark, sf_dir), topic="src3")


# writes


def _incoming(spark, sf_dir):
    """A batch: every row once more under a new id, every third with another text."""
    f = view(spark, sf_dir, "fragments")
    shift = {"id": F.col("id") + 1_000_000, "content_hash": F.when(F.col("id") % 3 == 0, F.concat(F.lit("new"), "id")).otherwise(F.col("content_hash")), "importance": 1 - F.col("importance"), "is_anchor": F.col("id") % 29 == 0}
    return f, f.withColumns(shift)


_INCOMING = "select id + 1000000 as id, key_id, case when id % 3 = 0 then 'new' || id else content_hash end as content_hash, 1 - importance as importance, id % 29 = 0 as is_anchor, content, type, topic, created_h, valid_to_h from @fragments"


@register("m01_upsert", duckdb_sql(
    f"select min(id) as id, round(max(importance), 6) as importance, bool_or(is_anchor) as is_anchor from (select id, key_id, content_hash, importance, is_anchor from @fragments union all select id, key_id, content_hash, importance, is_anchor from ({_INCOMING}) n) u group by key_id, content_hash"))
def m01(spark, sf_dir):
    return write.upsert(*_incoming(spark, sf_dir)).select("id", F.round("importance", 6).alias("importance"), "is_anchor")


@register("m02_duplicate_probe", duckdb_sql(f"select n.id, min(f.id) as existing from ({_INCOMING}) n join @fragments f on f.key_id is not distinct from n.key_id and f.content_hash = n.content_hash group by n.id"))
def m02(spark, sf_dir):
    return write.known(*_incoming(spark, sf_dir))


_PATCH = "select id, case when id % 4 = 0 then 0.95e0 end as importance, case when id % 10 = 0 then (select content_hash from @fragments g where g.id = f.id + 3) end as content_hash from @fragments f where id % 2 = 0"


@register("m03_amend", duckdb_sql(
    f"with p as ({_PATCH}), a as (select f.id, f.key_id, coalesce(p.importance, f.importance) as importance, coalesce(p.content_hash, f.content_hash) as h, f.is_anchor, p.content_hash is not null as moved from @fragments f left join p on p.id = f.id), "
    "m as (select a.id, min(g.id) as target from a join @fragments g on g.valid_to_h is null and g.key_id is not distinct from a.key_id and g.content_hash = a.h and g.id <> a.id where a.moved group by a.id), "
    "gain as (select m.target as id, max(a.importance) as more, bool_or(a.is_anchor) as fixed from m join a on a.id = m.id group by m.target) "
    "select a.id, a.h as content_hash, round(greatest(a.importance, coalesce(gain.more, 0)), 6) as importance, a.is_anchor or coalesce(gain.fixed, false) as is_anchor from a left join gain on gain.id = a.id where a.id not in (select id from m)"))  # fmt: skip
def m03(spark, sf_dir):
    f = view(spark, sf_dir, "fragments")
    other = f.select((F.col("id") - 3).alias("id"), F.col("content_hash").alias("theirs"))
    patches = f.where("id % 2 = 0").select("id").join(other, "id", "left")
    patches = patches.select("id", F.when(F.col("id") % 4 == 0, 0.95).alias("importance"), F.when(F.col("id") % 10 == 0, F.col("theirs")).alias("content_hash"))
    return write.amend(f, patches, ["importance", "content_hash"])[0].select("id", "content_hash", F.round("importance", 6).alias("importance"), "is_anchor")


@register("m04_delete_cleanup", duckdb_sql("select from_id, to_id, relation_type, weight from @links where from_id % 5 <> 0 and to_id % 5 <> 0"))
def m04(spark, sf_dir):
    f = view(spark, sf_dir, "fragments")
    return write.delete(f, view(spark, sf_dir, "links"), f.where("id % 5 = 0").select("id"))[1]


@register("m05_delete_by_agent", duckdb_sql("select id from @fragments where agent_id <> 'agent2'"))
def m05(spark, sf_dir):
    return write.delete_by_agent(view(spark, sf_dir, "fragments"), view(spark, sf_dir, "links"), "agent2")[0].select("id")


@register("m06_access_touch", duckdb_sql(
    "select f.id, f.access_count + coalesce(a.n, 0) as access_count, greatest(f.accessed_h, a.at_h) as accessed_h from @fragments f left join (select id % 200 as id, count(*) as n, max(us // 3600000000) as at_h from @search_events group by id % 200) a on a.id = f.id"))
def m06(spark, sf_dir):
    log = view(spark, sf_dir, "search_events").select((F.col("id") % 200).alias("id"), F.expr("us div 3600000000").alias("at_h"))
    return write.touch(view(spark, sf_dir, "fragments"), log).select("id", "access_count", "accessed_h")


_PLAN = (
    f"with n as ({_INCOMING}), r as (select n.*, case when length(trim(content)) < 10 and len(string_split_regex(trim(content), '\\s+')) < 3 then 'too_short' when regexp_matches(trim(content), '^https?://\\S+$') then 'url_only' end as reason, "
    "(select min(f.id) from @fragments f where f.key_id is not distinct from n.key_id and f.content_hash = n.content_hash) as existing from n), "
    "t as (select *, first_value(id) over (partition by key_id, content_hash order by reason is not null, created_h, id) as first from r), "
    "u as (select *, coalesce(existing, case when first <> id then first end) as target from t), "
    "q as (select id, row_number() over (partition by key_id order by created_h, id) as rn from u where reason is null and target is null) "
    "select u.id, case when u.reason is not null then 'invalid' when u.target is not null then 'duplicate' when u.key_id <> 'k1' or q.rn <= 20 then 'insert' else 'over_quota' end as action, case when u.reason is null then u.target end as target from u left join q on q.id = u.id"
)


def _limits(spark, f):
    """Key k1 may take 20 rows more."""
    return f.where("valid_to_h is null and key_id = 'k1'").groupBy("key_id").agg((F.count("*") + 20).alias("quota"))


@register("m07_batch_insert", duckdb_sql(_PLAN))
def m07(spark, sf_dir):
    f, new = _incoming(spark, sf_dir)
    return write.planned(f, new, _limits(spark, f))


@register("m18_remember_flow", duckdb_sql("select count(*) as n from @fragments"))
def m18(spark, sf_dir):
    """A dry run leaves the snapshot as it is, whatever its plan says."""
    f, new = _incoming(spark, sf_dir)
    return write.remember(f, new, _limits(spark, f), dry_run=True)[0].agg(F.count("*").alias("n"))


@register("m18_forget_flow", duckdb_sql("select f.id, count(l.from_id) as links from @fragments f left join @links l on l.from_id = f.id or l.to_id = f.id where f.id % 25 = 0 group by f.id"))
def m18_forget(spark, sf_dir):
    f = view(spark, sf_dir, "fragments")
    return write.forget(f, view(spark, sf_dir, "links"), f.where("id % 25 = 0").select("id"), dry_run=True)[2]


@register("m08_quota", duckdb_sql(f"select id, key_id from (select id, key_id, row_number() over (partition by key_id order by created_h, id) as rn from ({_INCOMING}) n) x where key_id <> 'k1' or rn <= 20"))
def m08(spark, sf_dir):
    f, new = _incoming(spark, sf_dir)
    return write.within_quota(new, f, _limits(spark, f)).select("id", "key_id")


@register("m09_link_upsert", duckdb_sql(
    "select from_id, to_id, greatest(weight, case when from_id % 3 = 0 then 2.5e0 else 0 end) as weight, case when from_id % 3 = 0 then 'part_of' else relation_type end as relation_type from @links union all "
    "select 900001, 900002, 1.0e0, 'related'"))  # fmt: skip
def m09(spark, sf_dir):
    links = view(spark, sf_dir, "links")
    new = links.where("from_id % 3 = 0").withColumns({"relation_type": F.lit("part_of"), "weight": F.lit(2.5)})
    extra = spark.createDataFrame([(900001, 900002, "related", 1.0)], "from_id long, to_id long, relation_type string, weight double")
    return write.link(links, new.unionByName(extra))


_RECALLS = "select session_id as recall_id, id, row_number() over (partition by session_id order by created_h, id) as place from @fragments"


@register("m10_co_retrieval", duckdb_sql(
    f"with r as ({_RECALLS}), p as (select a.id as from_id, b.id as to_id, count(*) as gain from r a join r b on b.recall_id = a.recall_id and a.place < b.place and b.place <= 5 group by a.id, b.id) "
    "select coalesce(l.from_id, p.from_id) as from_id, coalesce(l.to_id, p.to_id) as to_id, coalesce(l.relation_type, 'co_retrieved') as relation_type, coalesce(l.weight, 0) + coalesce(p.gain, 0) as weight from @links l full join p on p.from_id = l.from_id and p.to_id = l.to_id"))  # fmt: skip
def m10(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("created_h", "id"))
    return write.co_retrieved(view(spark, sf_dir, "links"), view(spark, sf_dir, "fragments").select(F.col("session_id").alias("recall_id"), "id", place.alias("place")))


@register("m11_supersede", duckdb_sql(
    f"select id, round(case when valid_to_h is null and id in (select from_id from @links where relation_type = 'superseded_by') then greatest(0.05e0, importance / 2) else importance end, 6) as importance, case when id in (select from_id from @links where relation_type = 'superseded_by') then coalesce(valid_to_h, {NOW_H}) else valid_to_h end as valid_to_h from @fragments"))
def m11(spark, sf_dir):
    pairs = view(spark, sf_dir, "links").where("relation_type = 'superseded_by'").select(F.col("from_id").alias("old"), F.col("to_id").alias("new"))
    return write.supersede(view(spark, sf_dir, "fragments"), pairs, NOW_H).select("id", F.round("importance", 6).alias("importance"), "valid_to_h")


@register("m12_contradiction_resolution", duckdb_sql("with w as (select distinct from_id as id, to_id as other from @links where relation_type = 'contradicts'), " + _LOST))
def m12(spark, sf_dir):
    f = view(spark, sf_dir, "fragments")
    pairs = view(spark, sf_dir, "links").where("relation_type = 'contradicts'").select(F.col("from_id").alias("id"), F.col("to_id").alias("other"))
    lost = write.contradiction_links(f, pairs).where("relation_type = 'superseded_by'").select(F.col("from_id").alias("id")).distinct()
    return write.resolve_contradictions(f, pairs, NOW_H).join(lost, "id", "left_semi").select("id", F.round("importance", 6).alias("importance"), "valid_to_h")


_ACTIONS = ("reinforce", "decay", "quarantine", "restore", "soft_delete")


@register("m13_link_states", duckdb_sql(
    "select from_id, to_id, round(least(2, greatest(0, weight / 3 + case a when 0 then 0.2e0 when 1 then -0.15e0 when 2 then -0.3e0 when 3 then 0.3e0 else 0 end)), 6) as weight, case when a in (0, 3) then 0.55e0 when a = 4 then 0.5e0 else 0.4e0 end as confidence, "
    "case a when 2 then 'soft' when 3 then 'released' end as quarantine, a = 4 as deleted from (select *, (from_id + to_id) % 5 as a from @links) x"))  # fmt: skip
def m13(spark, sf_dir):
    def step(state, row):
        state, _ = adaptive.reconsolidate((row.weight, 0.5, None, False, float("-inf")), _ACTIONS[row.action], 0.0)
        return state, (row.from_id, row.to_id, round(state[0], 6), round(state[1], 6), state[2], state[3])

    rows = view(spark, sf_dir, "links").select("from_id", "to_id", (F.col("weight") / 3).alias("weight"), ((F.col("from_id") + F.col("to_id")) % 5).cast("int").alias("action"))
    return adaptive.folded(rows, "from_id", ["to_id"], "from_id long, to_id long, weight double, confidence double, quarantine string, deleted boolean", lambda: None, step)


@register("t17_link_cooldown")
def t17(spark, sf_dir):
    """Decays of a link by its events; one within a minute of the last that took effect does nothing."""

    def step(state, row):
        state, done = adaptive.reconsolidate(state, "decay", row.us / 1e6)
        return state, (row.link, row.id, done, round(state[0], 6))

    rows = view(spark, sf_dir, "search_events").select((F.col("id") % 97).alias("link"), "id", "us")
    return adaptive.folded(rows, "link", ["us", "id"], "link long, id long, done boolean, weight double", lambda: (2.0, 1.0, None, False, float("-inf")), step)


@register("m14_assertion_status", duckdb_sql(
    "with n as (select id, topic, key_id, created_h, list_distinct(list_filter(string_split_regex(lower(content), '\\s+'), lambda w: w <> '')) as w, assertion_status, valid_to_h from @fragments), "
    "x as (select a.id, b.id as other, b.assertion_status as st, a.w as aw, b.w as bw, row_number() over (partition by a.id order by b.created_h desc, b.id) as rn from n a join n b on b.topic = a.topic and b.key_id is not distinct from a.key_id and b.id <> a.id and b.valid_to_h is null and abs(b.created_h - a.created_h) <= 168 where a.id % 10 = 0), "
    "y as (select id, other, st from x where rn <= 10 and case when len(aw) + len(bw) = 0 then 1.0 else len(list_intersect(aw, bw)) / cast(len(aw) + len(bw) - len(list_intersect(aw, bw)) as double) end > 0.3) "
    "select n.id, case when bool_or(y.st in ('verified', 'rejected')) then 'inferred' else 'observed' end as status, coalesce(string_agg(cast(y.other as varchar), ',' order by y.other), '') as candidates from n left join y on y.id = n.id where n.id % 10 = 0 group by n.id"))  # fmt: skip
def m14(spark, sf_dir):
    f = view(spark, sf_dir, "fragments")
    s = write.assertion_status(f, f.where("id % 10 = 0"))
    return s.select("id", "status", F.array_join(F.transform("candidates", lambda c: c.cast("string")), ",").alias("candidates"))


@register("m15_conflicts", duckdb_sql(f"select b.id, b.neighbour as existing from ({_BOTH}) b join @fragments f on f.id = b.neighbour and f.valid_to_h is null where b.s > 0.8 and b.id % 50 = 0"))
def m15(spark, sf_dir):
    """Existing active rows of the topic that new rows (every fiftieth) come into conflict with: similarity over 0.8."""
    v = view(spark, sf_dir, "vectors")
    near = knn.similar_to(v.where("id % 50 = 0"), v, 0.8).where("round(similarity, 9) > 0.8").select("id", F.col("neighbour").alias("existing"))
    return near.join(view(spark, sf_dir, "fragments").where("valid_to_h is null").select(F.col("id").alias("existing")), "existing", "left_semi").select("id", "existing")


@register("m16_auto_case", duckdb_sql(
    "with f as (select id, session_id, topic, type, created_h, case when id % 3 = 0 then case_id end as case_id from @fragments) "
    "select f.id, coalesce(cast(f.case_id as varchar), case when type in ('error', 'procedure', 'decision') then coalesce(cast(c.case_id as varchar), case when e.topic is not null then f.session_id || '/' || f.topic end) end) as case_name from f "
    "left join (select session_id, topic, arg_min(case_id, (created_h, id)) as case_id from f where case_id is not null group by session_id, topic) c on c.session_id = f.session_id and c.topic = f.topic "
    "left join (select distinct session_id, topic from f where type = 'error') e on e.session_id = f.session_id and e.topic = f.topic"))  # fmt: skip
def m16(spark, sf_dir):
    f = view(spark, sf_dir, "fragments").withColumn("case_id", F.when(F.col("id") % 3 == 0, F.col("case_id")))
    return write.auto_cases(f).withColumnRenamed("case", "case_name")


@register("m20_reflect_groups", duckdb_sql(
    "select session_id, workspace, coalesce(cast(case_id as varchar(19)), topic) as grp, count(*) as n, string_agg(cast(id as varchar), ',' order by id) filter (type = 'decision') as decisions, string_agg(cast(id as varchar), ',' order by id) filter (type = 'error') as errors from @fragments group by all"))
def m20(spark, sf_dir):
    listed = lambda kind: F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.col("id")))), lambda i: i.cast("string")), ","), F.lit("")).alias(f"{kind}s")
    grp = F.coalesce(F.col("case_id").cast("string"), "topic").alias("grp")
    return view(spark, sf_dir, "fragments").groupBy("session_id", "workspace", grp).agg(F.count("*").alias("n"), listed("decision"), listed("error"))


@register("m21_workspace_backfill", duckdb_sql(
    "with m as (select topic, arg_min(workspace, (-n, workspace)) as ws, max(n) as best, sum(n) as total from (select topic, workspace, count(*) as n from @fragments where workspace is not null group by topic, workspace) x group by topic) "
    "select f.id, coalesce(f.workspace, case when best >= 0.3e0 * total then ws end) as workspace from @fragments f left join m on m.topic = f.topic"))  # fmt: skip
def m21(spark, sf_dir):
    return write.infer_workspace(view(spark, sf_dir, "fragments"), 0.3).select("id", "workspace")


@register("m22_body_keywords", duckdb_sql(
    "select id, array_to_string(list_slice(list_concat(keywords, ['calls' || 'TheService']), 1, 10), ' ') as keywords from @fragments where valid_to_h is null and id % 4 = 0 and len(keywords) > 0 and not list_contains(keywords, 'x')"))
def m22(spark, sf_dir):
    f = view(spark, sf_dir, "fragments").where("id % 4 = 0 and size(keywords) > 0").withColumn("content", F.lit("callsTheService"))
    return write.body_keywords(f).select("id", F.array_join("keywords", " ").alias("keywords"))


@register("j22_evidence_update", duckdb_sql(
    "select id, round(case when case_id in (select case_id from @case_events where event_type = 'fix_attempted') then least(1.0e0, importance + 0.15e0) else importance end, 6) as importance, case when case_id in (select case_id from @case_events where event_type = 'fix_attempted') then true else quality_verified end as quality_verified from @fragments"))
def j22(spark, sf_dir):
    f = view(spark, sf_dir, "fragments")
    passed = view(spark, sf_dir, "case_events").where("event_type = 'fix_attempted'").select("case_id").distinct()
    evidence = f.join(passed, "case_id").select(F.col("id").alias("fragment_id"))
    return write.reward(f, evidence.unionByName(evidence), 0.15).select("id", F.round("importance", 6).alias("importance"), "quality_verified")


# links


def _shared_sql(a: str, b: str) -> str:
    return f"select a.id as a, b.id as b, len(list_intersect(list_distinct(list_transform(a.keywords, lambda k: lower(k))), list_distinct(list_transform(b.keywords, lambda k: lower(k))))) / nullif(cast(least(len(a.keywords), len(b.keywords)) as double), 0) as o from @fragments a join @fragments b on b.session_id = a.session_id and b.id <> a.id where a.type = '{a}' and b.type = '{b}'"


_PHASE = "case {}.phase when 'planning' then 0 when 'debugging' then 1 when 'implementation' then 1 when 'verification' then 2 end"


@register("g10_session_links", recursive(
    "with recursive "
    f"p as (select a, b, o, 'caused_by' as rel from ({_shared_sql('error', 'decision')}) x where o > 0 union all select a, b, o, 'resolved_by' from ({_shared_sql('procedure', 'error')}) y where o > 0), "
    "best as (select a, b, o, rel from (select *, row_number() over (partition by rel, a order by o desc, b) as rn from p) z where rn = 1), "
    f"fit as (select best.*, o >= 0.6 and coalesce({_PHASE.format('fa')} <= {_PHASE.format('fb')}, true) as fits from best join @fragments fa on fa.id = a join @fragments fb on fb.id = b), "
    f"{_CAUSAL}, r(root, id, depth) using key (root, id) as (select distinct b, b, 0 from fit where fits union select r.root, e.to_id, r.depth + 1 from r join e on e.from_id = r.id "
    "where r.depth < 20 and not exists (select 1 from recurring.r o where o.root = r.root and o.id = e.to_id)) "
    "select a as from_id, b as to_id, rel as relation_type, fits and not exists (select 1 from r where r.root = fit.b and r.id = fit.a) as accepted from fit"))  # fmt: skip
def g10(spark, sf_dir):
    edges = view(spark, sf_dir, "links").where("relation_type in ('caused_by', 'resolved_by')")
    return graph.session_links(view(spark, sf_dir, "fragments"), edges)


@register("g11_topic_links", duckdb_sql(
    "with t as (select topic, id, row_number() over (partition by topic order by importance desc, created_h desc, id) as rn from @fragments where valid_to_h is null and importance >= 0.3) "
    "select f.id as from_id, t.id as to_id from @fragments f join t on t.topic = f.topic and t.rn <= 3 left join t o on o.topic = f.topic and o.id = f.id and o.rn <= 4 where o.rn is null or t.rn < o.rn"))  # fmt: skip
def g11(spark, sf_dir):
    f = view(spark, sf_dir, "fragments")
    return graph.topic_links(f, f.select("id", "topic"))


@register("g12_proactive_links", duckdb_sql(
    "with f as (select id, keywords, importance, created_h, nullif(case_id, 0) as case_id, workspace, session_id, valid_to_h, list_filter(list_transform(keywords, lambda k: trim(lower(k))), lambda k: length(k) >= 2 and k not in ('"
    + "', '".join(graph.GENERAL_WORDS)
    + "')) as t from @fragments), h as (select a.id as from_id, b.id as to_id, len(list_intersect(a.keywords, b.keywords)) / cast(len(a.keywords) as double) as s, b.importance, b.created_h from f a join f b on b.valid_to_h is null and list_has_any(a.keywords, b.keywords) where a.id % 50 = 0), "
    "top as (select from_id, to_id from (select *, row_number() over (partition by from_id order by s desc, importance desc, created_h desc, to_id) as rn from h) x where rn <= 5 and from_id <> to_id), "
    "o as (select from_id, to_id, len(list_intersect(a.t, b.t)) / cast(greatest(len(a.t), len(b.t), 1) as double) as overlap, a.case_id as ac, b.case_id as bc, a.workspace as aw, b.workspace as bw, a.session_id as asid, b.session_id as bsid, a.created_h as ah, b.created_h as bh from top join f a on a.id = from_id join f b on b.id = to_id) "
    "select from_id, to_id, round(overlap, 6) as overlap, case when ac <> bc then 'cohort_mismatch' when aw <> bw then 'workspace_mismatch' when (ac is null or bc is null) and not (asid = bsid or abs(ah - bh) <= 24 or coalesce(aw = bw, false)) then 'case_policy' when to_id % 17 = 0 then 'polarity_conflict' else 'ok' end as reason from o where overlap >= 0.5"))  # fmt: skip
def g12(spark, sf_dir):
    f = view(spark, sf_dir, "fragments").withColumn("case_id", F.nullif("case_id", F.lit(0)))
    found = graph.proactive_links(f, f.where("id % 50 = 0"), f.where("id % 17 = 0").select("id"))
    return found.select("from_id", "to_id", F.round("overlap", 6).alias("overlap"), "reason")


@register("g08_reconstruct", duckdb_sql(
    "with recursive t as (select id, resolution_status, row_number() over (order by created_h, id) - 1 as place from @fragments where case_id = 7 and valid_to_h is null), "
    "e as (select distinct from_id, to_id from @links where relation_type in ('caused_by', 'resolved_by') and (from_id in (select id from t) or to_id in (select id from t))), "
    "r as (select from_id as root, from_id as id from e where from_id not in (select to_id from e) union select r.root, e.to_id from r join e on e.from_id = r.id), "
    "c as (select r.root, r.id, t.resolution_status from r join t on t.id = r.id), s as (select distinct id from c where root in (select root from c where resolution_status = 'resolved')) "
    "select 'timeline' as part, id, place from t union all select 'chain', id, root from c union all select 'unresolved', id, null from t where resolution_status = 'open' and id not in (select id from s) union all select 'supporting', id, null from t where id not in (select id from c)"
    ).replace("with fragments as", "with recursive fragments as", 1).replace(", recursive t as", ", t as", 1))
def g08(spark, sf_dir):
    h = graph.reconstruct(*(view(spark, sf_dir, n) for n in ("fragments", "links", "case_events")), 7)
    none = F.lit(None).cast("long").alias("place")
    part = lambda name, *cols: h[name].select(F.lit({"chains": "chain"}.get(name, name)).alias("part"), *cols)
    out = part("timeline", "id", F.col("place").cast("long").alias("place")).unionByName(part("chains", "id", F.col("root").alias("place")))
    return out.unionByName(part("unresolved", "id", none)).unionByName(part("supporting", "id", none))


@register("w10_chain_position", recursive(f"with recursive {_CHAINS} select root, id, row_number() over (partition by root order by depth, id) - 1 as position from r"))
def w10(spark, sf_dir):
    return graph.causal_positions(view(spark, sf_dir, "links"))


@register("j08_polarity_conflicts", duckdb_sql(
    "with c as (select id, key_id, topic, type, case_id, importance, case when id % 4 = 0 then 'negative' when id % 4 = 1 then 'uncertain' else 'positive' end as p from @fragments) "
    "select least(a.id, b.id) as a, greatest(a.id, b.id) as b from c a join c b on a.p = 'positive' and b.p = 'negative' and a.topic = b.topic and a.case_id % 2 = b.case_id % 2 and a.key_id is not distinct from b.key_id and a.importance >= 0.4 and b.importance >= 0.4"))  # fmt: skip
def j08(spark, sf_dir):
    told = F.when(F.col("id") % 4 == 0, "negative").when(F.col("id") % 4 == 1, "uncertain").otherwise("positive")
    claims = view(spark, sf_dir, "fragments").select("id", "key_id", F.col("topic").alias("subject"), F.lit("state").alias("predicate"), (F.col("case_id") % 2).alias("object"), told.alias("polarity"), (0.5 + F.col("importance") / 2).alias("confidence"))
    return graph.polarity_conflicts(claims)


@register("j31_workspace_in_text", duckdb_sql("select id, case id % 3 when 0 then 'en' else 'en-gb' end as workspace from @fragments where workspace is null and id % 3 < 2"))
def j31(spark, sf_dir):
    said = F.when(F.col("id") % 3 == 0, "in the en space").when(F.col("id") % 3 == 1, "both en and en-gb here").otherwise("of en or of fr")
    return graph.workspace_in_text(view(spark, sf_dir, "fragments").withColumn("content", said), ["en", "fr", "en-gb"])


# aggregates and reports


@register("a13_neighbours", duckdb_sql("select id, string_agg(cast(other as varchar), ',' order by other) as neighbours from (select from_id as id, to_id as other from @links union select to_id, from_id from @links) x group by id"))
def a13(spark, sf_dir):
    links = view(spark, sf_dir, "links")
    both = links.select(F.col("from_id").alias("id"), F.col("to_id").alias("other")).unionByName(links.select(F.col("to_id").alias("id"), F.col("from_id").alias("other")))
    return both.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("other")), lambda x: x.cast("string")), ",").alias("neighbours"))


@register("a14_key_groups", duckdb_sql("select group_id, to_json(list({'id': key_id, 'name': name} order by key_id)) as members from @api_keys group by group_id"))
def a14(spark, sf_dir):
    member = F.struct(F.col("key_id").alias("id"), "name")
    return view(spark, sf_dir, "api_keys").groupBy("group_id").agg(F.to_json(F.array_sort(F.collect_list(member))).alias("members"))


def _thresholds(spark, sf_dir):
    def step(state, row):
        threshold, n, total = state
        n, total = n + 1, total + row.result_count
        threshold = adaptive.adapt(threshold, n, total / n)
        return (threshold, n, total), (row.slot, n, total, round(threshold, 6))

    slot = F.concat_ws("/", "key_id", "query_type")
    rows = view(spark, sf_dir, "search_events").select(slot.alias("slot"), "id", "us", (F.col("result_count") * F.when(F.col("key_id") == "k1", 9).otherwise(1) * F.when(F.col("key_id") == "k2", 0).otherwise(1)).alias("result_count"))
    return adaptive.folded(rows, "slot", ["us", "id"], "slot string, n long, total long, threshold double", lambda: (0.4, 0, 0), step)


@register("a36_adaptive_threshold", duckdb_sql(
    "with e as (select key_id || '/' || query_type as slot, row_number() over w as n, sum(result_count * case key_id when 'k1' then 9 when 'k2' then 0 else 1 end) over w as total from @search_events window w as (partition by key_id, query_type order by us, id rows between unbounded preceding and current row)), "
    "m as (select slot, n, total, case when n < 50 then 0.0e0 when total < n then -0.01e0 when total > 8 * n then 0.01e0 else 0.0e0 end as move from e) "
    "select slot, max(n) as n, cast(max(total) as bigint) as total, round(list_reduce(list_prepend(0.4e0, list(move order by n)), lambda a, x: least(0.6e0, greatest(0.1e0, a + x))), 6) as threshold from m group by slot"))  # fmt: skip
def a36(spark, sf_dir):
    return _thresholds(spark, sf_dir).groupBy("slot").agg(F.max("n").alias("n"), F.max("total").alias("total"), F.max_by("threshold", "n").alias("threshold"))


@register("a41_dashboard", duckdb_sql(
    "select (select count(*) from @fragments) as fragments, (select count(*) from @fragments where valid_to_h is null) as active, (select count(*) from @links) as links, (select count(*) from @search_events) as searches, (select count(*) from @search_events where result_count = 0) as empty_searches, "
    "(select count(distinct session_id) from @search_events) as sessions, (select count(*) from @api_keys) as keys, (select count(*) from @tool_feedback) as feedback, (select count(*) from @case_events) as events"))  # fmt: skip
def a41(spark, sf_dir):
    counts = [
        ("fragments", {"fragments": F.count("*"), "active": F.count_if(F.col("valid_to_h").isNull())}), ("links", {"links": F.count("*")}),
        ("search_events", {"searches": F.count("*"), "empty_searches": F.count_if(F.col("result_count") == 0), "sessions": F.count_distinct("session_id")}),
        ("api_keys", {"keys": F.count("*")}), ("tool_feedback", {"feedback": F.count("*")}), ("case_events", {"events": F.count("*")}),
    ]
    # one row each
    out = None
    for name, measures in counts:
        row = view(spark, sf_dir, name).agg(*(c.alias(k) for k, c in measures.items())).withColumn("one", F.lit(1))
        out = row if out is None else out.join(row, "one")
    return out.drop("one")


@register("a42_cli_stats", duckdb_sql(
    "select count(*) as total, count(*) filter (valid_to_h is null) as active, count(distinct type) as types, count(distinct topic) as topics, round(avg(importance), 6) as importance, count(*) filter (quality_verified is null) as unverified, "
    "round(count(*) filter (length(content) < 40 or importance < 0.1) / cast(nullif(count(*), 0) as double), 6) as noise_ratio from @fragments"))  # fmt: skip
def a42(spark, sf_dir):
    noise = F.count_if((F.length("content") < 40) | (F.col("importance") < 0.1)) / F.nullif(F.count("*"), F.lit(0))
    return view(spark, sf_dir, "fragments").agg(
        F.count("*").alias("total"), F.count_if(F.col("valid_to_h").isNull()).alias("active"), F.count_distinct("type").alias("types"), F.count_distinct("topic").alias("topics"),
        F.round(F.avg("importance"), 6).alias("importance"), F.count_if(F.col("quality_verified").isNull()).alias("unverified"), F.round(noise, 6).alias("noise_ratio"),
    )


@register("w04_case_triples", duckdb_sql(
    "select case_id, count(*) as n, arg_max(goal, (importance, -id)) filter (goal is not null) as goal, arg_max(outcome, (importance, -id)) filter (outcome is not null) as outcome, coalesce(arg_max(resolution_status, (importance, -id)) filter (resolution_status is not null), 'open') as status from @fragments where valid_to_h is null group by case_id"))
def w04(spark, sf_dir):
    best = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("importance", -F.col("id"))))
    f = view(spark, sf_dir, "fragments").where("valid_to_h is null")
    return f.groupBy("case_id").agg(F.count("*").alias("n"), best("goal").alias("goal"), best("outcome").alias("outcome"), F.coalesce(best("resolution_status"), F.lit("open")).alias("status"))
