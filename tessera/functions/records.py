"""What a search leaves behind: its kind, its filters, the counts in its path; and which sessions still have to be reflected on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Filters a query may carry, in the order in which they are recorded.
FILTERS = ("topic", "type", "is_anchor", "includeSuperseded", "minImportance", "key_id")


def query_type(text: Column, keywords: Column, topic: Column) -> Column:
    """text, keywords, topic, or mixed where a query has more than one of them; keywords where it has none."""
    has = [F.coalesce(text != "", F.lit(False)), F.coalesce(F.size(keywords) > 0, F.lit(False)) & keywords.isNotNull(), F.coalesce(topic != "", F.lit(False))]
    n = sum((h.cast("int") for h in has[1:]), has[0].cast("int"))
    return F.when(n > 1, "mixed").when(has[0], "text").when(has[2], "topic").otherwise("keywords")


def filter_keys(given: dict[str, Column]) -> Column:
    """Names of the filters that a query gives, of columns by name; null isn't given."""
    return F.filter(F.array(*(F.when(given[k].isNotNull(), F.lit(k)) for k in FILTERS if k in given)), lambda k: k.isNotNull())


def search_path(path: Column) -> Column:
    """(l1, l2, l3, rrf) of a path like ``L1:5 → L2:10 → L3kw:2 → RRF``; a layer that isn't in it counts 0, a null path has nothing."""
    p = F.coalesce(path, F.lit(""))
    count = lambda pattern: F.coalesce(F.nullif(F.regexp_extract(p, pattern, 1), F.lit("")).cast("long"), F.lit(0).cast("long"))
    return F.struct(count(r"L1:(\d+)").alias("l1"), count(r"L2:(\d+)").alias("l2"), count(r"L3(?:kw)?:(\d+)").alias("l3"), F.contains(p, F.lit("RRF")).alias("rrf"))


def pending_sessions(activity: DataFrame, reflected: DataFrame, active: DataFrame) -> DataFrame:
    """(session_id) of segments (``session#n``) with activity that weren't reflected on and whose session, the part before ``#``, isn't active."""
    left = activity.select("session_id").distinct().join(reflected.select("session_id").distinct(), "session_id", "left_anti")
    own = left.withColumn("own", F.split_part("session_id", F.lit("#"), F.lit(1)))
    return own.join(active.select(F.col("session_id").alias("own")).distinct(), "own", "left_anti").select("session_id")


def worth_reflecting(calls: Column, started_us: Column, last_us: Column, fragments: Column, least_s: int = 30, least_activity: int = 3) -> Column:
    """Whether a session is to be reflected on: it called tools, lasted ``least_s`` seconds, stored nothing by itself, and was active enough. Unknown times count as none."""
    lasted = F.coalesce((last_us - started_us) >= least_s * 1_000_000, F.lit(False))
    none = F.lit(0)
    return (F.coalesce(calls, none) > 0) & lasted & (F.coalesce(fragments, none) == 0) & (F.coalesce(calls, none) + F.coalesce(fragments, none) >= least_activity)


def rate(current: Column, previous: Column, elapsed_s: Column, window_s: float) -> Column:
    """A counter's growth since the sample before, per ``window_s`` seconds, to two places: 0 without an earlier sample or after a reset."""
    grown = F.greatest(current - previous, F.lit(0.0)) / elapsed_s * window_s
    return F.when(previous.isNull() | (elapsed_s <= 0), 0.0).otherwise(F.round(grown, 2))


def blocked_because(key: Column, asked: Column, case_id: Column, quarantine: Column, status: Column) -> Column:
    """First reason why a fragment isn't taken as a precedent of a tenant's case, or null."""
    return (
        F.when(~key.eqNullSafe(asked), "tenant")
        .when(case_id.isNull(), "no_case")
        .when(quarantine == "soft", "quarantine")
        .when(status != "resolved", "unresolved")
    )


# What a fragment of a case stands for.
EVENT_OF = {"error": "error_observed", "decision": "decision_committed", "procedure": "fix_attempted"}


def case_events(fragments: DataFrame) -> DataFrame:
    """(event_id, case_id, event_type, sequence_no) of fragments that tell of a case, in order of their time: one event each, numbered from 0."""
    kind = F.create_map(*(F.lit(x) for kv in EVENT_OF.items() for x in kv))[F.col("type")]
    told = fragments.where("case_id is not null").withColumn("event_type", kind).where("event_type is not null")
    order = Window.partitionBy("case_id").orderBy("created_h", "id")
    return told.select(F.col("id").alias("event_id"), "case_id", "event_type", (F.row_number().over(order) - 1).cast("long").alias("sequence_no"))


def case_edges(events: DataFrame) -> DataFrame:
    """(from_event, to_event, edge_type): every event to the one before it in its case (preceded_by), and every fix to the errors before it (resolved_by)."""
    before = F.lag("event_id").over(Window.partitionBy("case_id").orderBy("sequence_no"))
    chain = events.select(F.col("event_id").alias("from_event"), before.alias("to_event"), F.lit("preceded_by").alias("edge_type")).where("to_event is not null")
    fixes = events.where("event_type = 'fix_attempted'").select("case_id", F.col("event_id").alias("from_event"), F.col("sequence_no").alias("at"))
    errors = events.where("event_type = 'error_observed'").select("case_id", F.col("event_id").alias("to_event"), "sequence_no")
    solved = fixes.join(errors, "case_id").where("sequence_no < at").select("from_event", "to_event", F.lit("resolved_by").alias("edge_type"))
    return chain.unionByName(solved)
