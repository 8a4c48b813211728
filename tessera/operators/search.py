"""Search layers and their fusion: keywords, topic, vectors, graph neighbours, time; RRF, final rank, budget."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scores, vectors
from tessera.operators.scope import Scope
from tessera.sources.scratch import written

RRF_K = 60


def _ranked(df: DataFrame, keep: list, limit: int, order: list) -> DataFrame:
    """The first ``limit`` rows by an order that ends with the id, with their rank from 1."""
    top = df.select("id", *keep).orderBy(*order, F.col("id")).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order, F.col("id"))))


def by_keywords(fragments: DataFrame, query: list[str], scope: Scope, limit: int = 30) -> DataFrame:
    """Rows that share a keyword, by share of the query met, importance, age. (id, keyword_score, importance, created_h, rank)"""
    hits = scope.apply(fragments).where(F.arrays_overlap("keywords", F.array(*map(F.lit, query))))
    hits = hits.withColumn("keyword_score", scores.keyword_score(F.col("keywords"), query))
    order = [F.desc_nulls_last("keyword_score"), F.desc_nulls_last("importance"), F.desc("created_h")]
    return _ranked(hits, ["keyword_score", "importance", "created_h"], limit, order)


def by_vector(vectors_of: DataFrame, fragments: DataFrame, query: list[float], scope: Scope, floor: float = 0.4, limit: int = 30) -> DataFrame:
    """Nearest rows in scope with similarity at or above ``floor``: top-k by partial heaps, no full sort. (id, similarity, rank)"""
    scoped = scope.apply(fragments).select("id")
    near = vectors_of.select("id", vectors.cosine(F.col("embedding"), query).alias("similarity")).where(F.col("similarity") >= floor)
    return _ranked(near.join(scoped, "id", "left_semi"), ["similarity"], limit, [F.desc("similarity")])


def by_time(fragments: DataFrame, scope: Scope, limit: int = 30) -> DataFrame:
    """Newest rows in scope. (id, created_h, rank)"""
    return _ranked(scope.apply(fragments), ["created_h"], limit, [F.desc("created_h")])


def neighbours(links: DataFrame, fragments: DataFrame, seeds: DataFrame, scope: Scope, limit: int = 20) -> DataFrame:
    """One-hop neighbours of at most a few dozen seeds in both directions; the strongest edge of each, limited by id. (id, weight, relation_type, score, rank)"""
    seed = F.broadcast(seeds.select(F.col("id").alias("seed")).limit(1000))
    out = links.join(seed, F.col("from_id") == F.col("seed")).select(F.col("to_id").alias("id"), "weight", "relation_type")
    back = links.join(seed, F.col("to_id") == F.col("seed")).select(F.col("from_id").alias("id"), "weight", "relation_type")
    best = Window.partitionBy("id").orderBy(F.desc("weight"), "relation_type")
    near = out.unionByName(back).withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn")
    near = near.join(seeds.select("id"), "id", "left_anti").join(scope.apply(fragments).select("id"), "id", "left_semi")
    near = near.orderBy("id").limit(limit).withColumn("score", scores.edge_score(F.col("weight"), F.col("relation_type")))
    return near.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def rrf(layers: list[tuple[DataFrame, float]], k: int = RRF_K) -> DataFrame:
    """Sum of weight / (k + rank) over ranked layers (id, rank). (id, rrf, layers)"""
    tagged = [df.select("id", (F.lit(float(w)) / (F.lit(float(k)) + F.col("rank"))).alias("part")) for df, w in layers]
    return reduce(DataFrame.unionByName, tagged).groupBy("id").agg(F.sum("part").alias("rrf"), F.count("*").alias("layers"))


def within_budget(df: DataFrame, order: list, budget: int, cost: str = "tokens") -> DataFrame:
    """The longest prefix of an order whose costs stay within a budget; costs aren't negative. Takes a result list, not a table."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= budget)


def rerank(candidates: DataFrame, model: Callable[[DataFrame], Column], now_h: int, most: int = 15) -> DataFrame:
    """A result list (some dozens of rows) by a model's score times the recency boost, as ``reranked``; ``model`` makes the score column and may be a pandas UDF."""
    age = (F.lit(now_h) - F.col("created_h")) / 24
    return candidates.withColumn("reranked", model(candidates) * scores.recency_boost(age)).orderBy(F.desc("reranked"), "id").limit(most)


def recall(
    fragments: DataFrame, vectors_of: DataFrame, links: DataFrame, query: list[str], vector: list[float], scope: Scope, now_h: int, budget: int = 4000, model: Callable[[DataFrame], Column] | None = None, contents: DataFrame | None = None
) -> DataFrame:
    """Hybrid recall: keyword (x2), vector (x1), graph (x1.5) and time (x2) layers fused, scored and cut to a token budget.

    (id, rrf, score, tokens, spent). Every layer is at most 30 rows when they meet, so the fused part is small
    whatever the table's size; the payload is fetched for those ids alone. Rows under importance 0.1 go unless they are
    anchors. With a model the 30 best by rrf are re-ranked to 15, which keep their score in the final order.
    ``contents`` (id, content) may hold the payload apart from fragments, whose narrow columns the layers read.
    """
    l1 = by_keywords(fragments, query, scope)
    l3 = by_vector(vectors_of, fragments, vector, scope)
    graph = neighbours(links, fragments, l1.where("rank <= 10").select("id"), scope)
    recent = by_time(fragments, scope)
    fused = rrf([(l1, 2.0), (l3, 1.0), (graph, 1.5), (recent, 2.0)])
    # at most 120 rows, used more than once below
    fused = written(fused.join(l3.select("id", "similarity"), "id", "left"))
    if contents is not None:
        fragments = fragments.join(contents.join(F.broadcast(fused.select("id")), "id"), "id")
    rows = fragments.join(F.broadcast(fused), "id").where(F.col("is_anchor") | (F.col("importance") >= 0.1)).withColumn("reranked", F.lit(None).cast("double"))
    if model is not None:
        rows = rerank(rows.orderBy(F.desc("rrf"), "id").limit(30), model, now_h)
    lexical = scores.lexical(F.col("topic"), F.col("keywords"), F.col("content"), query)
    age, factor = (F.lit(now_h) - F.col("created_h")) / 24, scores.workspace_factor(F.col("workspace"), scope.workspace)
    score = F.round(scores.recall_score(F.col("importance"), age, F.col("similarity"), F.col("reranked"), lexical, F.lit(False), factor), 6)
    ranked = rows.select("id", F.round("rrf", 6).alias("rrf"), score.alias("score"), "tokens")
    return within_budget(ranked, [F.desc("score"), F.col("id")], budget)


# Fields that a caller may ask for.
FIELDS = (
    "id", "content", "type", "topic", "keywords", "importance", "created_at", "access_count", "confidence", "linked", "explanations", "workspace",
    "context_summary", "case_id", "valid_to", "affect", "ema_activation", "key_id", "key_name",
)


def picked(df: DataFrame, fields: list[str], allowed: tuple[str, ...] = FIELDS) -> DataFrame:
    """The asked-for columns that are allowed and there; others are passed over."""
    return df.select(*(c for c in fields if c in allowed and c in df.columns))


def detailed(df: DataFrame, base: list[str], details: bool, more: list[str]) -> DataFrame:
    """The base columns, and the detail columns only when asked for, so that they aren't read otherwise."""
    return df.select(*base, *(more if details else []))


def optional(df: DataFrame, equal: dict[str, object]) -> DataFrame:
    """Rows that equal the given values; a value of None isn't tested and leaves nothing in the plan."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def at_least(results: DataFrame, similarity: float) -> DataFrame:
    """Results at or above a similarity; those without one pass."""
    return results.where(F.col("similarity").isNull() | (F.col("similarity") >= similarity))


def suggestions(requests: DataFrame, fragments: DataFrame) -> DataFrame:
    """Requests with the first usage hint that fits, or null.

    requests: (id, key_id, us, query_type, has_keywords, result_count, limit, has_budget, has_type, has_context).
    """
    recent = Window.partitionBy("key_id").orderBy("us").rangeBetween(-300_000_000, 0)
    repeats = F.sum(F.col("query_type").isin("keywords", "mixed").cast("int")).over(recent)
    owned = fragments.where("valid_to_h is null").groupBy("key_id").agg(F.count("*").alias("owned"))
    code = (
        F.when(F.col("has_keywords") & (F.col("repeats") >= 3), "repeat_query")
        .when((F.col("result_count") == 0) & ~F.col("has_context"), "empty_result_no_context")
        .when((F.col("limit") >= 50) & ~F.col("has_budget"), "large_limit_no_budget")
        .when(~F.col("has_type") & (F.coalesce("owned", F.lit(0)) > 100), "no_type_filter_noisy")
    )
    return requests.withColumn("repeats", repeats).join(owned, "key_id", "left").withColumn("code", code)


def recall_hint(results: Column, topic_candidates: Column, pending: Column, stale: Column, with_context: Column) -> Column:
    """What a recall's caller is told: the first of five ordered signals that fits, or null."""
    return (
        F.when((results == 0) & (topic_candidates > 0), "topic_mismatch")
        .when(results == 0, "no_results")
        .when(pending, "contradiction_pending")
        .when(stale > 0, "stale_results")
        .when((results >= 5) & ~with_context, "consider_context")
    )


def context(fragments: DataFrame, most: int) -> DataFrame:
    """(slot, rows): anchors, learnt rows and each type's, the ``most`` most important of each as structs in order."""
    slot = F.when(F.col("is_anchor"), "anchors").when(F.col("source") == "learning_extraction", "learning").otherwise(F.col("type"))
    f = fragments.where("valid_to_h is null").select(slot.alias("slot"), "id", "importance", "content", "topic")
    top = f.withColumn("place", F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("importance"), "id"))).where(F.col("place") <= most)
    return top.groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("place", "id", "importance", "topic", "content"))).alias("rows"))


# Titles of the sections of an injected text, in order.
SECTIONS = ("[ANCHOR MEMORY]", "[CORE MEMORY]", "[WORKING MEMORY]")


def injection(fragments: DataFrame, owner: str, most: int, chars: int) -> DataFrame:
    """(owner, body): each owner's sections (1 to 3 in ``section``) as a text of lines, the ``most`` most important rows of each."""
    w = Window.partitionBy(owner, "section").orderBy(F.desc("importance"), "id")
    top = fragments.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    line = F.concat(F.lit("- "), F.substring("content", 1, chars))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda r: r["line"]), "\n")
    parts = top.groupBy(owner, "section").agg(lines.alias("lines"))
    titled = F.concat(F.element_at(F.array(*map(F.lit, SECTIONS)), F.col("section")), F.lit("\n"), F.col("lines"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", titled.alias("t")))), lambda r: r["t"]), "\n")
    return parts.groupBy(owner).agg(body.alias("body"))


def page(df: DataFrame, order: list, offset: int, size: int, most: int = 50) -> DataFrame:
    """Rows ``offset`` to ``offset + size`` of an order that ends with a unique key, at most ``most``; only that many of each partition are kept."""
    return df.orderBy(*order).offset(offset).limit(min(size, most))


def cursor(offset: int, anchor: int) -> str:
    """An opaque place in a list: where to go on, and the time that the list was made for."""
    return base64.urlsafe_b64encode(json.dumps({"offset": offset, "anchor": anchor}).encode()).decode().rstrip("=")


def from_cursor(text: str | None) -> tuple[int, int | None]:
    """(offset, anchor) of a cursor; the beginning for none or a broken one."""
    try:
        held = json.loads(base64.urlsafe_b64decode((text or "") + "=" * (-len(text or "") % 4)))
        return max(0, int(held["offset"])), held.get("anchor")
    except (ValueError, KeyError, TypeError):
        return 0, None
