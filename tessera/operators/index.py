"""Posting lists of fragments by tenant, and the gates of what may be linked or split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import morphemes


def postings(fragments: DataFrame, terms: int = 8) -> DataFrame:
    """(kind, ns, term, id): keywords and up to ``terms`` words of the text, topic and type by tenant, session for all tenants."""
    explicit = fragments.select("key_id", F.explode("keywords").alias("term"), "id").withColumn("term", F.lower("term"))
    words = fragments.select("key_id", F.explode(morphemes.keywords(F.col("content"), terms)).alias("term"), "id")
    parts = [explicit.unionByName(words).distinct().select(F.lit("keyword").alias("kind"), F.col("key_id").alias("ns"), "term", "id")]
    for kind, column, ns in (("topic", "topic", F.col("key_id")), ("type", "type", F.col("key_id")), ("session", "session_id", F.lit(None).cast("string"))):
        parts.append(fragments.select(F.lit(kind).alias("kind"), ns.alias("ns"), F.col(column).alias("term"), "id"))
    return reduce(DataFrame.unionByName, parts)


def removed(index: DataFrame, ids: DataFrame) -> DataFrame:
    """Postings without the ids; a session's list keeps them until it expires."""
    gone = ids.select("id").distinct().withColumn("gone", F.lit(True))
    return index.join(gone, "id", "left").where(F.col("gone").isNull() | (F.col("kind") == "session")).select(*index.columns)


def pruned(index: DataFrame, most: int = 5000, seed: int = 1) -> DataFrame:
    """At most ``most`` members of each list, drawn by a hash."""
    w = Window.partitionBy("kind", "ns", "term").orderBy(F.xxhash64("id", F.lit(seed)), "id")
    return index.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("place")


def lookup(index: DataFrame, kind: str, term: str, namespaces: list[str]) -> DataFrame:
    """Ids of a list over several tenants, each once."""
    return index.where((F.col("kind") == kind) & (F.col("term") == term) & F.col("ns").isin(*namespaces)).select("id").distinct()


def gate(quarantine: Column, source: dict[str, Column], target: dict[str, Column], conflicting: Column, policy: str = "strict-or-adjacent", window_h: int = 24) -> Column:
    """First reason why a link isn't allowed, or ok; sides have case_id, workspace, session_id, created_h."""
    same = lambda c: F.coalesce(source[c] == target[c], F.lit(False))
    near = F.coalesce(F.abs(source["created_h"] - target["created_h"]) <= window_h, F.lit(False))
    lone = source["case_id"].isNull() | target["case_id"].isNull()
    by_case = {"both-required": lone, "strict-or-adjacent": lone & ~same("session_id") & ~near & ~same("workspace"), "loose": F.lit(False)}[policy]
    return (
        F.when(quarantine.isNotNull() & (quarantine != "released"), "quarantine")
        .when(source["case_id"] != target["case_id"], "cohort_mismatch")
        .when(source["workspace"] != target["workspace"], "workspace_mismatch")
        .when(by_case, "case_policy")
        .when(conflicting, "polarity_conflict")
        .otherwise("ok")
    )


def gated(links: DataFrame, fragments: DataFrame, conflicts: DataFrame, policy: str = "strict-or-adjacent") -> DataFrame:
    """Candidate links (from_id, to_id, quarantine_state) with the gate's reason; ``conflicts`` lists targets (id) whose claims are disputed."""
    names = ("case_id", "workspace", "session_id", "created_h")
    side = lambda mark, key: fragments.select(F.col("id").alias(key), *(F.col(c).alias(f"{mark}_{c}") for c in names))
    disputed = conflicts.select(F.col("id").alias("to_id")).distinct().withColumn("disputed", F.lit(True))
    joined = links.join(side("s", "from_id"), "from_id").join(side("t", "to_id"), "to_id").join(disputed, "to_id", "left")
    of = lambda mark: {c: F.col(f"{mark}_{c}") for c in names}
    return joined.withColumn("reason", gate(F.col("quarantine_state"), of("s"), of("t"), F.col("disputed").isNotNull(), policy))


def split_candidates(fragments: DataFrame, now_h: int, meta_topics: list[str], least: int = 300, backoff_h: int = 24, most: int = 10) -> DataFrame:
    """The longest active rows over ``least`` characters that are no anchors, no split children, of no meta topic and not tried within ``backoff_h``."""
    fresh = F.col("split_failed_h").isNull() | (F.col("split_failed_h") < now_h - backoff_h)
    own = F.col("source").isNull() | ~F.col("source").startswith("split:")
    f = fragments.where((F.length("content") > least) & F.col("valid_to_h").isNull() & ~F.col("is_anchor") & own & fresh & ~F.col("topic").isin(*meta_topics))
    return f.orderBy(F.desc(F.length("content")), "id").limit(most)


def by_all_or_any(postings_of: DataFrame, terms: list[str], least: int = 3) -> DataFrame:
    """(ns, id) of keyword lists, by namespace: the ids that all terms have, or where these are fewer than ``least`` the ids that any has."""
    wanted = sorted({t.lower() for t in terms})
    met = postings_of.where((F.col("kind") == "keyword") & F.col("term").isin(*wanted)).groupBy("ns", "id").agg(F.countDistinct("term").alias("met"))
    enough = met.groupBy(F.col("ns").alias("of_ns")).agg((F.count_if(F.col("met") == len(wanted)) >= least).alias("enough"))
    found = met.join(enough, F.col("ns").eqNullSafe(F.col("of_ns")))
    return found.where(~F.col("enough") | (F.col("met") == len(wanted))).select("ns", "id")
