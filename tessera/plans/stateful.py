"""Batch replays of the stateful pieces, in event order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import register
from tessera.sources.views import duckdb_sql, view
from tessera.streaming import adaptive, sessions


@register("t01_session_segments")
def t01(spark, sf_dir):
    return sessions.segments(view(spark, sf_dir, "search_events"))


@register("t01_idle_segments", duckdb_sql("select id, 1 + sum(gap) over (partition by session_id order by us, id rows between unbounded preceding and current row) as segment from (select id, session_id, us, case when us - lag(us) over (partition by session_id order by us, id) > 2700000000 then 1 else 0 end as gap from @search_events) x"))
def t01_idle(spark, sf_dir):
    from pyspark.sql import Window

    e = view(spark, sf_dir, "search_events")
    w = Window.partitionBy("session_id").orderBy("us", "id")
    gap = F.when(F.col("us") - F.lag("us").over(w) > sessions.IDLE_US, 1).otherwise(0)
    return e.select("id", "session_id", "us", gap.alias("gap")).select("id", (1 + F.sum("gap").over(w)).alias("segment"))


@register("t06_working_memory")
def t06(spark, sf_dir):
    def step(state, row):
        state = adaptive.evict([*state, (row.id, row.importance, row.tokens)])
        return state, (row.session_id, row.id, len(state), sum(t for _, _, t in state))

    rows = view(spark, sf_dir, "fragments").select("session_id", "id", "importance", F.col("tokens").cast("int").alias("tokens"), "created_h")
    return adaptive.folded(rows, "session_id", ["created_h", "id"], "session_id string, id long, held int, tokens long", list, step)


_DRAW = "id * 7919 % 1000 / 1000.0e0"


@register("t10_feedback_sampling", duckdb_sql(
    "with recursive e as (select session_id, id, us / 1e6 as t, row_number() over (partition by session_id order by us, id) as n, " + _DRAW + " as draw from @search_events), "
    "r as (select session_id, id, n, draw < 0.2 as hit, case when draw < 0.2 then t else -1e18 end as last, case when draw < 0.2 then 1 else 0 end as took from e where n = 1 union all "
    "select e.session_id, e.id, e.n, r.took < 2 and e.t - r.last >= 900 and e.draw < 0.2, case when r.took < 2 and e.t - r.last >= 900 and e.draw < 0.2 then e.t else r.last end, r.took + case when r.took < 2 and e.t - r.last >= 900 and e.draw < 0.2 then 1 else 0 end "
    "from r join e on e.session_id = r.session_id and e.n = r.n + 1) select session_id, id, hit as sampled from r").replace("with search_events as", "with recursive search_events as", 1).replace(", recursive e as", ", e as", 1))  # fmt: skip
def t10(spark, sf_dir):
    def step(state, row):
        state, hit = adaptive.sampled(state, row.us / 1e6, row.draw)
        return state, (row.session_id, row.id, hit)

    rows = view(spark, sf_dir, "search_events").select("session_id", "id", "us", (F.col("id") * 7919 % 1000 / 1000.0).alias("draw"))
    return adaptive.folded(rows, "session_id", ["us", "id"], "session_id string, id long, sampled boolean", lambda: (float("-inf"), 0), step)


@register("t11_activation", duckdb_sql(
    "with e as (select id % 97 as target, id, us, 0.3e0 / sqrt(greatest(coalesce((us - lag(us) over w) / 1e6, 86400), 1)) as s from @search_events window w as (partition by id % 97 order by us, id)) "
    "select target, id, round(list_reduce(list_prepend(0.0e0, list(s) over (partition by target order by us, id rows between 119 preceding and current row)), lambda a, x: 0.7e0 * a + x), 6) as ema from e"))  # fmt: skip
def t11(spark, sf_dir):
    rows = view(spark, sf_dir, "search_events").select((F.col("id") % 97).alias("target"), "id", "us")
    return adaptive.activations(rows, "target", "us", "id").select("target", "id", F.round("ema", 6).alias("ema"))


@register("t12_adaptive_threshold", duckdb_sql(
    "with e as (select key_id, query_type, us // 3600000000 % 24 as hour, row_number() over w as n, sum(result_count) over w as total from @search_events window w as (partition by key_id, query_type, us // 3600000000 % 24 order by us, id rows between unbounded preceding and current row)), "
    "m as (select *, case when n < 50 then 0.0e0 when total < n then -0.01e0 when total > 8 * n then 0.01e0 else 0.0e0 end as move from e) "
    "select key_id || '/' || query_type || '/' || hour as slot, max(n) as n, round(list_reduce(list_prepend(0.4e0, list(move order by n)), lambda a, x: least(0.6e0, greatest(0.1e0, a + x))), 6) as threshold from m group by key_id, query_type, hour"))  # fmt: skip
def t12(spark, sf_dir):
    def step(state, row):
        threshold, n, total = state
        n, total = n + 1, total + row.result_count
        threshold = adaptive.adapt(threshold, n, total / n)
        return (threshold, n, total), (row.slot, n, round(threshold, 6))

    slot = F.concat_ws("/", "key_id", "query_type", F.expr("us div 3600000000 % 24"))
    rows = view(spark, sf_dir, "search_events").select(slot.alias("slot"), "id", "us", "result_count")
    out = adaptive.folded(rows, "slot", ["us", "id"], "slot string, n long, threshold double", lambda: (0.4, 0, 0), step)
    return out.groupBy("slot").agg(F.max("n").alias("n"), F.max_by("threshold", "n").alias("threshold"))
