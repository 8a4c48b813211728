"""Writes as pure functions (snapshot, changes) -> snapshot; a caller writes the result once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import morphemes, scores, text


def upsert(fragments: DataFrame, new: DataFrame) -> DataFrame:
    """Insert by (key_id, content_hash): a row that exists keeps its columns, with the larger importance and either's anchor flag."""
    both = fragments.withColumn("new_", F.lit(0)).unionByName(new.withColumn("new_", F.lit(1)), allowMissingColumns=True)
    same = Window.partitionBy("key_id", "content_hash")
    first = F.row_number().over(same.orderBy("new_", "id"))
    merged = both.withColumns({"rn_": first, "importance": F.max("importance").over(same), "is_anchor": F.max("is_anchor").over(same)})
    return merged.where("rn_ = 1").drop("rn_", "new_")


def amend(fragments: DataFrame, patches: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(snapshot, versions, merged): sparse updates by id where a patch's column isn't null, the rows as they were before, and (id, into).

    A row whose new text another active row of its tenant has already (the least such id) isn't changed but merged into that one, which keeps
    the larger importance and either's anchor flag; the merged row goes.
    """
    p = patches.select("id", *(F.col(c).alias(f"new_{c}") for c in columns))
    after = fragments.join(p, "id", "left").withColumns({c: F.coalesce(f"new_{c}", c) for c in columns}).select(*fragments.columns)
    versions = fragments.join(patches.select("id"), "id", "left_semi")
    if "content_hash" not in columns:
        return after, versions, patches.select("id", F.col("id").alias("into")).limit(0)
    changed = after.join(patches.where("content_hash is not null").select("id"), "id", "left_semi")
    other = fragments.where("valid_to_h is null").select(F.col("id").alias("into"), F.col("key_id").alias("k"), F.col("content_hash").alias("h"))
    merged = changed.join(other, F.col("key_id").eqNullSafe(F.col("k")) & (F.col("content_hash") == F.col("h")) & (F.col("id") != F.col("into"))).groupBy("id").agg(F.min("into").alias("into"))
    gain = merged.join(after.select("id", "importance", "is_anchor"), "id").groupBy(F.col("into").alias("id")).agg(F.max("importance").alias("more"), F.max("is_anchor").alias("fixed"))
    kept = after.join(merged.select("id"), "id", "left_anti").join(gain, "id", "left")
    kept = kept.withColumns({"importance": F.greatest("importance", "more"), "is_anchor": F.col("is_anchor") | F.coalesce("fixed", F.lit(False))}).select(*fragments.columns)
    return kept, versions, merged


def delete(fragments: DataFrame, links: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Snapshots without the ids and without links that touch them."""
    gone = ids.select("id").distinct()
    left = links.join(gone.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(gone.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
    return fragments.join(gone, "id", "left_anti"), left.select(*links.columns)


def touch(fragments: DataFrame, accesses: DataFrame) -> DataFrame:
    """Access counts and last access from a log (id, at_h)."""
    log = accesses.groupBy("id").agg(F.count("*").alias("n_"), F.max("at_h").alias("at_"))
    out = fragments.join(log, "id", "left")
    return out.withColumns({"access_count": F.col("access_count") + F.coalesce("n_", F.lit(0)), "accessed_h": F.greatest("accessed_h", "at_")}).select(*fragments.columns)


def link(links: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert edges by (from_id, to_id): the new relation replaces the old, the weight is the larger."""
    both = links.withColumn("new_", F.lit(0)).unionByName(new.withColumn("new_", F.lit(1)))
    return both.groupBy("from_id", "to_id").agg(F.max_by("relation_type", F.struct("new_", "weight", "relation_type")).alias("relation_type"), F.max("weight").alias("weight"))


def supersede(fragments: DataFrame, pairs: DataFrame, now_h: int) -> DataFrame:
    """Expire the older row of each (old, new) pair at half its importance, 0.05 at least; rows expired before stay as they are."""
    old = pairs.select(F.col("old").alias("id")).distinct().withColumn("gone_", F.lit(True))
    out = fragments.join(old, "id", "left")
    gone = F.col("gone_").isNotNull()
    return out.withColumns({"valid_to_h": F.when(gone & F.col("valid_to_h").isNull(), F.lit(now_h)).otherwise(F.col("valid_to_h")), "importance": F.when(gone & F.col("valid_to_h").isNull(), F.greatest(F.lit(0.05), F.col("importance") / 2)).otherwise(F.col("importance"))}).select(*fragments.columns)


def within_quota(new: DataFrame, fragments: DataFrame, limits: DataFrame) -> DataFrame:
    """New rows, oldest first, that still fit each key's limit (key_id, quota); keys without a limit take all."""
    active = fragments.where("valid_to_h is null").groupBy("key_id").agg(F.count("*").alias("active_"))
    w = Window.partitionBy("key_id").orderBy("created_h", "id")
    rows = new.withColumn("rn_", F.row_number().over(w)).join(active, "key_id", "left").join(limits, "key_id", "left")
    room = F.col("quota") - F.coalesce("active_", F.lit(0))
    return rows.where(F.col("quota").isNull() | (F.col("rn_") <= room)).select(*new.columns)


def infer_workspace(fragments: DataFrame, majority: float = 0.8) -> DataFrame:
    """Rows without a workspace get their topic's, where one workspace has at least ``majority`` of the topic's scoped rows."""
    n = fragments.where("workspace is not null").groupBy("topic", "workspace").count()
    by = Window.partitionBy("topic")
    best = n.withColumn("all_", F.sum("count").over(by)).withColumn("rn_", F.row_number().over(by.orderBy(F.desc("count"), "workspace"))).where((F.col("rn_") == 1) & (F.col("count") >= majority * F.col("all_")))
    out = fragments.join(best.select("topic", F.col("workspace").alias("ws_")), "topic", "left")
    return out.withColumn("workspace", F.coalesce("workspace", "ws_")).select(*fragments.columns)


def delete_by_agent(fragments: DataFrame, links: DataFrame, agent: str) -> tuple[DataFrame, DataFrame]:
    """Snapshots without an agent's rows and their links; the shared agent ``default`` can't be deleted."""
    if agent == "default":
        raise ValueError("rows of the agent 'default' belong to all")
    return delete(fragments, links, fragments.where(F.col("agent_id") == agent).select("id"))


def known(fragments: DataFrame, new: DataFrame) -> DataFrame:
    """(id, existing): new rows whose text their tenant already has, with the least id that has it."""
    have = fragments.groupBy("key_id", "content_hash").agg(F.min("id").alias("existing"))
    return new.select("id", "key_id", "content_hash").alias("n").join(have.alias("h"), F.col("n.key_id").eqNullSafe(F.col("h.key_id")) & (F.col("n.content_hash") == F.col("h.content_hash"))).select("n.id", "existing")


def planned(fragments: DataFrame, new: DataFrame, limits: DataFrame) -> DataFrame:
    """(id, action, target) of a batch, before anything is written: invalid, duplicate (of ``target``), over_quota or insert; the first row of equal texts in the batch counts."""
    reason = text.valid_content(F.col("content"), F.col("type"), F.col("topic"))
    rows = new.withColumn("reason", reason).join(known(fragments, new).withColumnRenamed("existing", "target"), "id", "left")
    first = F.first("id").over(Window.partitionBy("key_id", "content_hash").orderBy(F.col("reason").isNotNull(), "created_h", "id"))
    rows = rows.withColumn("first", first).withColumn("target", F.coalesce("target", F.when(F.col("first") != F.col("id"), F.col("first"))))
    open_rows = rows.where("reason is null and target is null")
    taken = within_quota(open_rows.select(*new.columns), fragments, limits).select("id").withColumn("taken", F.lit(True))
    action = F.when(F.col("reason").isNotNull(), "invalid").when(F.col("target").isNotNull(), "duplicate").when(F.col("taken"), "insert").otherwise("over_quota")
    return rows.join(taken, "id", "left").select("id", action.alias("action"), F.when(F.col("reason").isNull(), F.col("target")).alias("target"))


def remember(fragments: DataFrame, new: DataFrame, limits: DataFrame, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(snapshot, plan): the batch's valid rows inserted with the importance that their type allows, duplicates merged; dry: the snapshot as it was."""
    plan = planned(fragments, new, limits)
    if dry_run:
        return fragments, plan
    allowed = scores.initial_importance(F.col("content"), F.col("type"), F.col("importance"), F.col("is_anchor"))
    take = new.withColumn("importance", allowed).join(plan.where("action in ('insert', 'duplicate')").select("id"), "id", "left_semi")
    return upsert(fragments, take), plan


def forget(fragments: DataFrame, links: DataFrame, ids: DataFrame, dry_run: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fragments, links, plan): (id, links) of what goes; dry: the snapshots as they were."""
    mine = ids.select("id").distinct().join(fragments.select("id"), "id", "left_semi")
    ends = links.select(F.col("from_id").alias("id")).unionByName(links.select(F.col("to_id").alias("id")))
    plan = mine.join(ends.groupBy("id").agg(F.count("*").alias("links")), "id", "left").select("id", F.coalesce("links", F.lit(0)).alias("links"))
    return (fragments, links, plan) if dry_run else (*delete(fragments, links, mine), plan)


def co_retrieved(links: DataFrame, results: DataFrame, most: int = 5) -> DataFrame:
    """Links after recalls (recall_id, place, id): every pair of a recall's first ``most`` rows gains 1, a new link of weight 1 where there was none."""
    top = results.where(F.col("place") <= most).select("recall_id", "place", "id")
    a, b = top.alias("a"), top.alias("b")
    pairs = a.join(b, (F.col("a.recall_id") == F.col("b.recall_id")) & (F.col("a.place") < F.col("b.place"))).groupBy(F.col("a.id").alias("from_id"), F.col("b.id").alias("to_id")).agg(F.count("*").cast("double").alias("gain"))
    both = links.join(pairs.where("from_id != to_id"), ["from_id", "to_id"], "full")
    return both.select("from_id", "to_id", F.coalesce("relation_type", F.lit("co_retrieved")).alias("relation_type"), (F.coalesce("weight", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0))).alias("weight"))


def _sides(fragments: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (id, other) of one tenant with ``newer``: whether id was made after other."""
    side = lambda key: fragments.select(F.col("id").alias(key), F.col("created_h").alias(f"{key}_h"), F.col("key_id").alias(f"{key}_key"), F.col("is_anchor").alias(f"{key}_anchor"))
    both = pairs.select("id", "other").distinct().join(side("id"), "id").join(side("other"), "other")
    return both.where(F.col("id_key").eqNullSafe(F.col("other_key"))).withColumn("newer", F.col("id_h") > F.col("other_h"))


def contradiction_links(fragments: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of contradicting pairs (id, other) of one tenant: id contradicts other, and the loser is superseded by the winner, the newer (other on a tie)."""
    both = _sides(fragments, pairs)
    made = lambda a, b, kind: both.select(a.alias("from_id"), b.alias("to_id"), F.lit(kind).alias("relation_type"), F.lit(1.0).alias("weight"))
    win, lose = F.when(F.col("newer"), F.col("id")).otherwise(F.col("other")), F.when(F.col("newer"), F.col("other")).otherwise(F.col("id"))
    return made(F.col("id"), F.col("other"), "contradicts").unionByName(made(lose, win, "superseded_by"))


def resolve_contradictions(fragments: DataFrame, pairs: DataFrame, now_h: int) -> DataFrame:
    """The loser of each contradicting pair expires at half its importance; an older anchor keeps its importance."""
    both = _sides(fragments, pairs)
    lost = both.select(F.when(F.col("newer"), F.col("other")).otherwise(F.col("id")).alias("id"), (~(F.col("newer") & F.col("other_anchor"))).alias("halve"))
    lost = lost.groupBy("id").agg(F.sum(F.col("halve").cast("int")).alias("halvings"))
    f = fragments.join(lost, "id", "left")
    gone = F.col("halvings").isNotNull()
    return f.withColumns({
        "importance": F.when(gone, F.col("importance") * F.pow(F.lit(0.5), F.col("halvings"))).otherwise(F.col("importance")),
        "valid_to_h": F.when(gone & F.col("valid_to_h").isNull(), F.lit(now_h)).otherwise(F.col("valid_to_h")),
    }).select(*fragments.columns)


def assertion_status(fragments: DataFrame, new: DataFrame, window_h: int = 168, newest: int = 10, floor: float = 0.3) -> DataFrame:
    """(id, status, candidates) of new rows: the newest active rows of topic and tenant within a week that share words with them; inferred if one of those is verified or rejected."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    have = fragments.where("valid_to_h is null and topic is not null and created_h is not null").select(F.col("id").alias("other"), "topic", "key_id", F.col("created_h").alias("at"), "assertion_status")
    asked = new.where("topic is not null and created_h is not null").select("id", "topic", "key_id", "created_h", (F.col("created_h") + window_h).alias("at"))
    # places of a topic and tenant run by time, then by id descending: a count an hour and a place inside it. What a new row looks at ends at the last place of its window
    group = ("topic", "key_id")
    hours = have.groupBy(*group, "at").agg(F.count("*").alias("n")).unionByName(asked.select(*group, "at", F.lit(0).cast("long").alias("n"))).groupBy(*group, "at").agg(F.sum("n").alias("n"))
    hours = hours.withColumn("upto", F.sum("n").over(Window.partitionBy(*group).orderBy("at"))).drop("n").toDF("h_topic", "h_key", "h_at", "upto")
    of_hour = (F.col("topic") == F.col("h_topic")) & F.col("key_id").eqNullSafe(F.col("h_key")) & (F.col("at") == F.col("h_at"))
    inside = F.row_number().over(Window.partitionBy(*group, "at").orderBy("other")) - 1
    have = have.withColumn("inside", inside).join(hours, of_hour).select("other", F.col("topic").alias("o_topic"), F.col("key_id").alias("o_key"), F.col("at").alias("o_at"), "assertion_status", (F.col("upto") - F.col("inside")).alias("o_place"))
    # one more than wanted, for the row itself may be among them
    asked = asked.join(hours, of_hour).select("id", *group, "created_h", F.explode(F.sequence(F.col("upto") - newest, F.col("upto"))).alias("place")).where("place > 0")
    near = asked.join(have, (F.col("topic") == F.col("o_topic")) & F.col("key_id").eqNullSafe(F.col("o_key")) & (F.col("place") == F.col("o_place"))).where((F.col("id") != F.col("other")) & (F.col("o_at") >= F.col("created_h") - window_h))
    rn = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("o_at"), "other"))
    near = near.withColumn("rn", rn).where(F.col("rn") <= newest).select("id", "other", "assertion_status")
    # texts come last, to ten pairs a row
    near = near.join(fragments.select(F.col("id").alias("other"), F.col("content").alias("other_content")), "other").join(new.select("id", "content"), "id")
    near = near.where(scores.jaccard(words(F.col("content")), words(F.col("other_content"))) > floor)
    found = near.groupBy("id").agg(F.max(F.col("assertion_status").isin("verified", "rejected")).alias("judged"), F.array_sort(F.collect_list("other")).alias("candidates"))
    out = new.select("id").join(found, "id", "left")
    return out.select("id", F.when(F.col("judged"), "inferred").otherwise("observed").alias("status"), F.coalesce("candidates", F.array().cast("array<bigint>")).alias("candidates"))


def auto_cases(fragments: DataFrame, case_of: Column | None = None) -> DataFrame:
    """(id, case): errors, procedures and decisions without a case get the first case of their session and topic, or else a new one if an error is among them.

    ``case_of`` names a new case; by default it is session/topic.
    """
    w = Window.partitionBy("session_id", "topic")
    kinds = F.col("type").isin("error", "procedure", "decision")
    error = F.max((F.col("type") == "error").cast("int")).over(w) == 1
    new = F.concat_ws("/", "session_id", "topic") if case_of is None else case_of
    first = F.min(F.when(F.col("case_id").isNotNull(), F.struct("created_h", "id", "case_id"))).over(w)["case_id"]
    case = F.coalesce(F.col("case_id").cast("string"), F.when(kinds & F.col("session_id").isNotNull() & F.col("topic").isNotNull(), F.coalesce(first.cast("string"), F.when(error, new))))
    return fragments.withColumn("case", case).select("id", "case")


def reward(fragments: DataFrame, evidence: DataFrame, gain: float) -> DataFrame:
    """Rows that are evidence (fragment_id) of a verified case gain importance in [0, 1], each once; with a positive gain they count as verified."""
    hit = evidence.select(F.col("fragment_id").alias("id")).distinct().withColumn("hit", F.lit(True))
    f = fragments.join(hit, "id", "left")
    changed = {"importance": F.when(F.col("hit"), scores.clamped(F.col("importance") + gain, 0.0, 1.0)).otherwise(F.col("importance"))}
    if gain > 0:
        changed["quality_verified"] = F.when(F.col("hit"), F.lit(True)).otherwise(F.col("quality_verified"))
    return f.withColumns(changed).select(*fragments.columns)


def body_keywords(fragments: DataFrame) -> DataFrame:
    """(id, keywords) of active rows with a camel-case name in the text and none among their keywords: extracted ones are added, up to ten."""
    rows = fragments.where(F.col("valid_to_h").isNull() & text.hidden_identifier(F.col("content"), F.col("keywords")))
    more = morphemes.with_keywords(rows, "id", "content").withColumnRenamed("keywords", "extracted")
    merged = rows.select("id", "keywords").join(more, "id").withColumn("merged", text.merged_keywords(F.col("keywords"), F.col("extracted")))
    return merged.where(F.size("merged") > F.size("keywords")).select("id", F.col("merged").alias("keywords"))
