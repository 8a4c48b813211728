"""Rank, decay and overlap expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Boost of a relation in graph expansion; any other counts 1.
RELATION_BOOST = {"caused_by": 1.5, "resolved_by": 1.5, "related": 1.0, "part_of": 1.0, "co_retrieved": 0.5, "contradicts": 0.3, "superseded_by": 0.3}
# Days in which importance halves, days until a row wants verification, largest and default importance at insert, by type.
HALF_LIFE_DAYS = {"procedure": 30.0, "fact": 60.0, "decision": 90.0, "error": 45.0, "preference": 120.0, "relation": 90.0, None: 60.0}
STALE_DAYS = {"procedure": 30, "fact": 60, "decision": 90, None: 60}
MOST_AT_INSERT = {"error": 0.6, "procedure": 0.6, "fact": 0.7, "decision": 0.7, "relation": 0.7, "preference": 0.9, None: 0.7}
DEFAULT_IMPORTANCE = {"error": 0.9, "decision": 0.8, "procedure": 0.7, "preference": 0.95, "relation": 0.6, "episode": 0.6, "fact": 0.5, None: 0.5}
AFFECTS = ("neutral", "frustration", "confidence", "surprise", "doubt", "satisfaction")


def by_type(type_: Column, values: dict) -> Column:
    """The value of a type; the key None is for all others."""
    pairs = [F.lit(x) for k, v in values.items() if k is not None for x in (k, v)]
    return F.coalesce(F.create_map(*pairs)[type_], F.lit(values[None]))


def overlap(a: Column, b: Column) -> Column:
    """Common elements over the larger size; 0 when both are empty."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most > 0, F.size(F.array_intersect(a, b)) / most).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Common elements over all elements; 1 when both are empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(1.0)


def keyword_score(keywords: Column, query: list[str]) -> Column:
    """Share of the query's keywords that a row has, counting repeats in the row."""
    return F.size(F.filter(keywords, lambda k: k.isin(*query))) / F.lit(float(len(query)))


def decayed(importance: Column, age_h: Column, half_life_h: Column, anchor: Column) -> Column:
    """Importance halves every half-life down to 0.05; anchors keep theirs."""
    return F.when(anchor, importance).otherwise(F.greatest(F.lit(0.05), importance * F.pow(F.lit(2.0), -age_h / half_life_h)))


def composite(importance: Column, ema: Column, age_h: Column, similarity: Column, exact: Column) -> Column:
    """0.4 importance with activation boost, 0.3 recency with a 30-day half-life, 0.3 similarity, 0.35 for an exact hit."""
    strong = F.least(F.lit(1.0), importance + 0.5 * 0.2 * (1 - F.exp(-F.coalesce(ema, F.lit(0.0)))))
    return strong * 0.4 + F.pow(F.lit(2.0), -age_h / (30.0 * 24)) * 0.3 + F.coalesce(similarity, F.lit(0.0)) * 0.3 + F.when(exact, 0.35).otherwise(0.0)


def lexical(topic: Column, keywords: Column, content: Column, query: list[str]) -> Column:
    """Topic equal +4; per query word: in the topic +2, a keyword +1.5, in the content +1; joined words in the topic +2."""
    total = F.lit(0.0)
    for q in (w.lower() for w in query):
        total += F.when(F.lower(topic) == q, 4.0).otherwise(0.0) + F.when(F.lower(topic).contains(q), 2.0).otherwise(0.0)
        total += F.when(F.array_contains(keywords, q), 1.5).otherwise(F.when(F.lower(content).contains(q), 1.0).otherwise(0.0))
    joined = "-".join(w.lower() for w in query)
    return total + F.when(F.lower(topic).contains(joined), 2.0).otherwise(0.0) if len(query) > 1 else total


def edge_score(weight: Column, relation: Column) -> Column:
    """tanh(weight / 2) times the relation's boost."""
    return F.tanh(weight * 0.5) * by_type(relation, {**RELATION_BOOST, None: 1.0})


def clamped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def activated(ema: Column, gap_s: Column, rate: float = 0.3) -> Column:
    """Activation after an access ``gap_s`` seconds after the last update: the sample is the gap to the power -1/2; no earlier update counts a day."""
    return rate * F.pow(F.greatest(F.coalesce(gap_s, F.lit(86_400.0)), F.lit(1.0)), F.lit(-0.5)) + (1 - rate) * F.coalesce(ema, F.lit(0.0))


def activation_decay(ema: Column, idle_days: Column, anchor: Column) -> Column:
    """Activation is lost after 60 days without access (or with none ever), halved after 30; anchors keep theirs."""
    lost = (idle_days.isNull() | (idle_days > 60)) & (ema > 0)
    halved = (idle_days <= 60) & (idle_days > 30) & (ema > 0.01)
    return F.when(anchor, ema).when(lost, 0.0).when(halved, ema * 0.5).otherwise(ema)


def utility(importance: Column, accesses: Column, age_days: Column) -> Column:
    """importance * (1 + ln accesses) over the age in months to the power 0.3, of a month at least."""
    return importance * (1 + F.log(F.greatest(accesses, F.lit(1)))) / F.pow(F.greatest(F.lit(1.0), age_days / 30), F.lit(0.3))


def adaptive_importance(importance: Column, accesses: Column, idle_days: Column, type_: Column) -> Column:
    """Importance with a bonus for accesses and a half-life since the last; never accessed counts 9999 days, no importance 0.5."""
    base = F.coalesce(F.nullif(importance, F.lit(0.0)), F.lit(0.5))
    fresh = F.pow(F.lit(2.0), -F.coalesce(idle_days, F.lit(9999.0)) / by_type(type_, HALF_LIFE_DAYS))
    return clamped(base * (1 + 0.1 * F.log(F.coalesce(accesses, F.lit(0)) + 1)) * fresh, 0.05, 1.0)


def half_life_days(type_: Column, ema: Column) -> Column:
    """A type's half-life, up to twice as long with activation."""
    return by_type(type_, HALF_LIFE_DAYS) * clamped(1 + F.coalesce(ema, F.lit(0.0)) * 0.5, 1.0, 2.0)


def feedback_factor(all_relevant: Column, all_sufficient: Column) -> Column:
    return F.when(~all_relevant, 0.85).when(all_sufficient, 1.1).otherwise(0.95)


def recency_boost(age_days: Column) -> Column:
    """0.92 to 1.1: linear over a year; an unknown age counts as new."""
    recency = clamped(1 - F.greatest(F.coalesce(age_days, F.lit(0.0)), F.lit(0.0)) / 365 * 0.9, 0.1, 1.0)
    return 1 + 0.2 * (recency - 0.5)


def temperature(importance: Column, idle_days: Column, accesses: Column, source: Column, factor: Column) -> Column:
    """Importance, +0.2 if accessed within 7 days, +0.15 from 5 accesses on, +0.3 if learnt, times the workspace factor."""
    warm, used = F.when(idle_days < 7, 0.2).otherwise(0.0), F.when(accesses >= 5, 0.15).otherwise(0.0)
    learnt = F.when(source == "learning_extraction", 0.3).otherwise(0.0)
    return (F.coalesce(importance, F.lit(0.0)) + warm + used + learnt) * factor


def workspace_factor(workspace: Column, scope: str | None, penalty: float = 0.7) -> Column:
    """1 in the scope's workspace or without a scope; elsewhere, and for rows of no workspace, the penalty."""
    return F.lit(1.0) if scope is None else F.when(workspace == scope, 1.0).otherwise(penalty)


def initial_importance(content: Column, type_: Column, wanted: Column, anchor: Column) -> Column:
    """At most the type's; at most 0.2 for texts under 20 characters; anchors as wanted."""
    most = F.least(wanted, by_type(type_, MOST_AT_INSERT))
    return F.when(anchor, wanted).when(F.length(F.coalesce(content, F.lit(""))) < 20, F.least(most, F.lit(0.2))).otherwise(most)


def default_importance(type_: Column) -> Column:
    return by_type(type_, DEFAULT_IMPORTANCE)


def inferred_tier(type_: Column, importance: Column) -> Column:
    return (
        F.when((type_ == "preference") | (importance >= 0.8), "permanent")
        .when(type_.isin("error", "procedure"), "hot")
        .when((type_ == "episode") | (importance >= 0.5), "warm")
        .otherwise("cold")
    )


def affect(c: Column) -> Column:
    return F.when(c.isin(*AFFECTS), c).otherwise("neutral")


def child_importance(parent: Column, type_: Column) -> Column:
    """0.7 of the parent's, to two places; null for a fact that comes under 0.4."""
    capped = F.floor(parent * 0.7 * 100 + 0.5) / 100
    return F.when(~((type_ == "fact") & (capped < 0.4)), capped)


def staleness(type_: Column, days: Column) -> Column:
    """Days since verification where they reach the type's limit, else null."""
    return F.when(days >= by_type(type_, STALE_DAYS), days)


def recall_score(importance: Column, distance_days: Column, similarity: Column, reranked: Column, lexical_raw: Column, linked: Column, factor: Column) -> Column:
    """Final order of recall: the reranker's score, or else 0.85 of importance, nearness in time and similarity; then words met, on a log scale."""
    composite = F.coalesce(importance, F.lit(0.0)) * 0.4 + F.pow(F.lit(2.0), -F.abs(distance_days) / 30) * 0.3 + F.coalesce(similarity, F.lit(0.0)) * 0.3
    words = F.when(lexical_raw > 0, F.least(F.log1p(lexical_raw) / F.log1p(F.lit(8.0)), F.lit(1.0))).otherwise(0.0)
    weight = F.when(reranked.isNotNull(), 0.12).otherwise(0.18) * F.when(linked, 0.5).otherwise(1.0)
    return (F.coalesce(reranked, composite * 0.85) + words * weight) * factor


def nli_verdict(contradiction: Column, entailment: Column, neutral: Column) -> Column:
    """(contradicts, confidence, escalate) from the three scores of an inference model."""
    c, e = F.coalesce(contradiction, F.lit(0.0)), F.coalesce(entailment, F.lit(0.0))
    made = lambda yes, how, ask: F.struct(F.lit(yes).alias("contradicts"), how.alias("confidence"), ask.alias("escalate"))
    return F.when(c >= 0.8, made(True, c, F.lit(False))).when(e >= 0.6, made(False, e, F.lit(False))).when(c >= 0.5, made(True, c, F.lit(True))).otherwise(made(False, F.coalesce(neutral, F.lit(0.0)), c >= 0.2))


def softmax(scores_of: Column) -> Column:
    """Softmax of an array of doubles."""
    top = F.array_max(scores_of)
    powers = F.transform(scores_of, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, y: a + y))


def severity(conflicts: Column) -> Column:
    return F.when(conflicts >= 4, "high").when(conflicts >= 2, "medium").otherwise("low")


def reason_codes(path: Column, case_id: Column, case_context: Column, ema: Column, most: int = 3) -> Column:
    """Why a row was found, from the tags of the search path, the case and the activation; the first ``most``."""
    tag = lambda *names: F.exists(path, lambda p: F.greatest(*(p.startswith(n) for n in names), F.lit(False)))
    rules = [
        (tag("L2:"), "direct_keyword_match"),
        (tag("L3:", "HotCache:", "L3kw:"), "semantic_similarity"),
        (tag("Graph:"), "graph_neighbor_1hop"),
        (tag("Temporal:"), "temporal_proximity"),
        (case_context.isNotNull() & (case_id == case_context), "case_cohort_member"),
        (F.coalesce(ema, F.lit(0.0)) > 0.5, "recent_activity_ema"),
    ]
    return F.slice(F.filter(F.array(*(F.when(when, F.lit(code)) for when, code in rules)), lambda x: x.isNotNull()), 1, most)


def ema_boost(ema: Column) -> Column:
    """Rank bonus of activation, up to 0.2."""
    return 0.2 * (1 - F.exp(-F.greatest(F.coalesce(ema, F.lit(0.0)), F.lit(0.0))))


def confidence(utility_of: Column, baseline: float) -> Column:
    """Utility against the anchors' mean, in [0.1, 1]."""
    return clamped(F.coalesce(utility_of, F.lit(0.0)) / F.lit(baseline), 0.1, 1.0)


# Reasons and outcomes that feedback may give.
IRRELEVANCE_REASONS = ("not_stored", "search_miss", "scope_leak", "topic_mismatch", "other")
TASK_OUTCOMES = ("completed", "partial", "blocked", "abandoned", "unknown")


def irrelevance_reason(relevant: Column, reason: Column) -> Column:
    """A known reason of feedback that says irrelevant, else null."""
    return F.when(~relevant & reason.isin(*IRRELEVANCE_REASONS), reason)


def task_result(outcome: Column, evaluator: Column, success: Column) -> Column:
    """(outcome, evaluator, success): unknown outcomes are null, a known one is by the agent unless said, and says success where nothing else does."""
    known = F.when(outcome.isin(*TASK_OUTCOMES), outcome)
    by = F.when(known.isNotNull(), F.when(evaluator.isin("agent", "automatic", "human"), evaluator).otherwise("agent"))
    return F.struct(known.alias("outcome"), by.alias("evaluator"), F.coalesce(success, known == "completed", F.lit(False)).alias("success"))
