"""The maintenance pipeline: named stages over a snapshot, each a pure transformation with a measure.

Stages only build plans; ``run`` writes what a stage changed where asked and records a failing stage without
stopping the rest.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scores, text
from tessera.functions import vectors as vectors_of
from tessera.operators import greedy, index, knn, write
from tessera.sources.scratch import written


@dataclass(frozen=True)
class Snapshot:
    """fragments, links (from_id, to_id, relation_type, weight) and vectors (id, topic, embedding) at ``now_h``."""

    fragments: DataFrame
    links: DataFrame
    vectors: DataFrame
    now_h: int

    def age(self) -> Column:
        return (F.lit(self.now_h) - F.col("created_h")) / 24

    def idle(self, days: float) -> Column:
        """Not accessed for so many days, or ever."""
        return F.col("accessed_h").isNull() | (F.col("accessed_h") < self.now_h - 24 * days)

    def utility(self) -> Column:
        return scores.utility(F.col("importance"), F.col("access_count"), self.age())


def _degree(links: DataFrame) -> DataFrame:
    return links.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("degree"))


def ttl_transition(s: Snapshot) -> Snapshot:
    """Tiers by rules in order, each on what the ones before left: preferences, hubs and verified weight become permanent; warm rows cool; idle weak permanents too."""
    f = s.fragments.join(_degree(s.links), "id", "left")
    verified = F.col("quality_verified") | (F.col("quality_verified").isNull() & (F.col("is_anchor") | (F.col("importance") >= 0.9)))
    lasting = (F.col("type") == "preference") | (F.coalesce("degree", F.lit(0)) >= 5) | ((F.col("importance") >= 0.8) & F.coalesce(verified, F.lit(False)))
    unused = (F.col("accessed_h").isNull() & (s.age() > 30)) | (F.col("accessed_h") < s.now_h - 720)
    tier = F.when(lasting, "permanent").otherwise(F.col("ttl_tier"))
    tier = F.when((tier == "warm") & ((F.col("importance") < 0.3) | F.coalesce(unused, F.lit(False))), "cold").otherwise(tier)
    tier = F.when((tier == "permanent") & ~F.col("is_anchor") & (F.col("importance") < 0.5) & s.idle(180), "cold").otherwise(tier)
    return replace(s, fragments=f.withColumn("ttl_tier", tier).select(*s.fragments.columns))


def importance_decay(s: Snapshot) -> Snapshot:
    """Importance halves in its type's half-life, stretched by activation, since the last access; permanent rows and anchors keep theirs."""
    age_h = F.lit(s.now_h) - F.coalesce("accessed_h", "created_h")
    d = scores.decayed(F.col("importance"), age_h, scores.half_life_days(F.col("type"), F.col("ema")) * 24, F.col("is_anchor"))
    return replace(s, fragments=s.fragments.withColumn("importance", F.when(F.col("ttl_tier") == "permanent", F.col("importance")).otherwise(d)))


def activation_decay(s: Snapshot) -> Snapshot:
    idle = (F.lit(s.now_h) - F.col("accessed_h")) / 24
    return replace(s, fragments=s.fragments.withColumn("ema", scores.activation_decay(F.col("ema"), idle, F.col("is_anchor"))))


def garbage(s: Snapshot, split_children: bool = False) -> DataFrame:
    """Rows that may be deleted, with ``utility``: not permanent, no anchor, over a week old, and of no use, unlinked, forgotten, resolved or of no type.

    Parents of split children stay. With ``split_children`` weak or orphaned children go as well, and parents aren't kept for them.
    """
    touched = s.links.select(F.col("from_id").alias("id")).unionByName(s.links.select(F.col("to_id").alias("id"))).distinct().withColumn("linked", F.lit(True))
    f = s.fragments.join(touched, "id", "left").join(_degree(s.links), "id", "left").withColumn("utility", s.utility())
    weak, unread, age = F.col("importance"), F.col("access_count") == 0, s.age()
    useless = (F.col("utility") < 0.15) & s.idle(60)
    unlinked = F.col("type").isin("fact", "decision") & (weak < 0.2) & unread & F.col("linked").isNull() & (age > 30)
    forgotten = (weak < 0.1) & s.idle(90) & (age > 90) & (F.coalesce("degree", F.lit(0)) < 2)
    solved = (F.col("type") == "error") & F.col("content").startswith("[해결됨]") & (age > 30) & (weak < 0.3)
    of_no_type = F.col("type").isNull() & (weak < 0.2)
    bad = useless | unlinked | forgotten | solved | of_no_type
    child = F.col("source").startswith("split:")
    parent = F.split_part("source", F.lit(":"), F.lit(2))
    if split_children:
        living = s.fragments.where("valid_to_h is null").select(F.col("id").cast("string").alias("parent")).withColumn("lives", F.lit(True))
        f = f.withColumn("parent", F.when(child, parent)).join(living, "parent", "left")
        bad = bad | (child & (weak < 0.3) & unread & s.idle(30) & (age > 30)) | (child & (age > 7) & F.col("lives").isNull())
    else:
        f = f.join(s.fragments.where(child).select(parent.cast("long").alias("id")), "id", "left_anti")
    found = f.where((F.col("ttl_tier") != "permanent") & ~F.col("is_anchor") & (age > 7) & F.coalesce(bad, F.lit(False)))
    return found.select(*s.fragments.columns, "utility")


def expired_delete(s: Snapshot, most: int = 50, split_children: bool = False) -> Snapshot:
    """Delete at most ``most`` of the garbage, the least useful first."""
    gone = garbage(s, split_children).orderBy("utility", "id").limit(most).select("id")
    return replace(s, fragments=s.fragments.join(gone, "id", "left_anti"))


def gc_preview(s: Snapshot) -> DataFrame:
    """(type, n) of the garbage."""
    return garbage(s).groupBy("type").agg(F.count("*").alias("n"))


def split_pieces(s: Snapshot, meta_topics: list[str], splitter: Callable[[Column], Column] = text.sentences, least: int = 2, most: int = 8) -> DataFrame:
    """(parent, part, text, importance) of the long rows that may be split: at least ``least`` pieces pass the gates and no number of the parent is lost.

    ``splitter`` makes an array of texts and may be a model's pandas UDF; by default it cuts sentences.
    """
    f = index.split_candidates(s.fragments, s.now_h, meta_topics).withColumn("parent_modes", text.modalities(F.col("content")))
    parts = f.select("id", "content", "type", "importance", "parent_modes", F.posexplode(F.slice(splitter(F.col("content")), 1, most)).alias("part", "text"))
    child = scores.child_importance(F.col("importance"), F.col("type"))
    new_mode = F.size(F.array_except(text.modalities(F.col("text")), F.col("parent_modes"))) > 0
    good = parts.where(text.acceptable_child(F.col("text")) & ~new_mode).withColumn("child", child).where("child is not null")
    whole = good.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), " ").alias("all"), F.count("*").alias("n"), F.first("content").alias("content"))
    fit = whole.where((F.col("n") >= least) & (F.size(text.missing_anchors(F.col("content"), F.col("all"))) == 0)).select("id")
    return good.join(fit, "id", "left_semi").select(F.col("id").alias("parent"), "part", "text", F.col("child").alias("importance"))


def split_long_fragments(s: Snapshot, meta_topics: list[str] | None = None) -> Snapshot:
    """Long rows give way to their pieces: the parent expires, cold, at 0.3 of its importance (0.2 at least); pieces are linked in order and to it."""
    pieces = split_pieces(s, meta_topics or ["session_reflect", "consolidation", "reflection"]).withColumn("child_id", F.abs(F.xxhash64("parent", "part")))
    new = {
        "id": F.col("child_id"), "content": F.col("text"), "importance": F.col("child"), "source": F.concat(F.lit("split:"), "parent"), "ttl_tier": F.lit("warm"), "is_anchor": F.lit(False),
        "created_h": F.lit(s.now_h), "valid_from_h": F.lit(s.now_h), "valid_to_h": F.lit(None), "access_count": F.lit(0), "accessed_h": F.lit(None), "verified_h": F.lit(None), "ema": F.lit(0.0),
        "content_hash": F.sha2("text", 256), "tokens": F.ceil(F.length("text") / 4), "quality_verified": F.lit(None),
    }
    renamed = pieces.select("parent", "part", "text", "child_id", F.col("importance").alias("child"))
    rows = s.fragments.join(renamed, F.col("id") == F.col("parent"))
    kinds = dict(s.fragments.dtypes)
    children = rows.select(*((new[c].cast(kinds[c]) if c in new else F.col(c)).alias(c) for c in s.fragments.columns))
    gone = pieces.select(F.col("parent").alias("id")).distinct().withColumn("split", F.lit(True))
    old = s.fragments.join(gone, "id", "left")
    old = old.withColumns({
        "valid_to_h": F.when(F.col("split"), F.lit(s.now_h).cast(kinds["valid_to_h"])).otherwise(F.col("valid_to_h")), "importance": F.when(F.col("split"), F.greatest(F.lit(0.2), F.col("importance") * 0.3)).otherwise(F.col("importance")),
        "ttl_tier": F.when(F.col("split"), "cold").otherwise(F.col("ttl_tier")),
    }).select(*s.fragments.columns)
    before = F.lag("child_id").over(Window.partitionBy("parent").orderBy("part"))
    chain = pieces.select(before.alias("from_id"), F.col("child_id").alias("to_id"), F.lit("related").alias("relation_type")).where("from_id is not null")
    home = pieces.select(F.col("child_id").alias("from_id"), F.col("parent").alias("to_id"), F.lit("part_of").alias("relation_type"))
    edges = chain.unionByName(home).withColumn("weight", F.lit(1.0)).select(*s.links.columns)
    return replace(s, fragments=old.unionByName(children), links=s.links.unionByName(edges))


def merge_duplicates(s: Snapshot) -> Snapshot:
    """One row of each (key, workspace, content); links of the others move to it."""
    w = Window.partitionBy("key_id", "workspace", "content_hash").orderBy(F.desc("importance"), "created_h", "id")
    keep = s.fragments.select("id", F.first("id").over(w).alias("keep"))
    moved = keep.where("id != keep")
    links = s.links.join(moved.select(F.col("id").alias("from_id"), F.col("keep").alias("__f")), "from_id", "left")
    links = links.join(moved.select(F.col("id").alias("to_id"), F.col("keep").alias("__t")), "to_id", "left")
    links = links.withColumns({"from_id": F.coalesce("__f", "from_id"), "to_id": F.coalesce("__t", "to_id")}).where("from_id != to_id")
    links = links.groupBy("from_id", "to_id").agg(F.max_by("relation_type", F.struct("weight", "relation_type")).alias("relation_type"), F.max("weight").alias("weight"))
    return replace(s, fragments=s.fragments.join(moved.select("id"), "id", "left_anti"), links=links)


def semantic_dedup(s: Snapshot, floor: float = 0.92, k: int = 3) -> Snapshot:
    """Newer rows of near-equal meaning replace older ones among a row's k nearest inside a topic; access counts are summed."""
    pairs = knn.nearest_pairs(s.vectors.join(s.fragments.where("valid_to_h is null").select("id"), "id", "left_semi"), k, floor)
    side = lambda c: s.fragments.select(F.col("id").alias(c), F.col("created_h").alias(f"{c}_h"), F.col("is_anchor").alias(f"{c}_anchor"))
    gone = greedy.resolve_duplicates(pairs.join(side("a"), "a").join(side("b"), "b"))
    add = gone.join(s.fragments.select(F.col("id").alias("dropped"), "access_count"), "dropped").groupBy(F.col("kept").alias("id")).agg(F.sum("access_count").alias("__add"))
    f = s.fragments.join(gone.select(F.col("dropped").alias("id")), "id", "left_anti").join(add, "id", "left")
    return replace(s, fragments=f.withColumn("access_count", F.col("access_count") + F.coalesce("__add", F.lit(0))).select(*s.fragments.columns))


def promote_anchors(s: Snapshot) -> Snapshot:
    worthy = (F.col("access_count") >= 10) & (F.col("importance") >= 0.8)
    return replace(s, fragments=s.fragments.withColumn("is_anchor", F.col("is_anchor") | worthy))


def utility_scores(s: Snapshot) -> Snapshot:
    """Fragments with a column utility_score."""
    return replace(s, fragments=s.fragments.withColumn("utility_score", s.utility()))


def requeue(s: Snapshot, most: int = 20) -> DataFrame:
    """(id, ema) to be judged again: much used, of little importance, never verified and not permanent."""
    return s.fragments.where("ema > 0.3 and importance < 0.4 and quality_verified is null and ttl_tier <> 'permanent'").orderBy(F.desc("ema"), "id").limit(most).select("id", "ema")


def without_embedding(fragments: DataFrame, vectors: DataFrame, most: int = 100) -> DataFrame:
    """The most important rows that have no vector yet."""
    return fragments.join(vectors.select("id"), "id", "left_anti").orderBy(F.desc("importance"), "id").limit(most)


def embedded(rows: DataFrame, model: Callable[[Column], Column]) -> DataFrame:
    """(id, topic, embedding): normalised vectors of prepared texts; ``model`` may be a pandas UDF."""
    return rows.select("id", "topic", vectors_of.l2_normalise(model(text.prepare_for_embedding(F.col("content")))).alias("embedding"))


def link_relation(new: dict[str, Column], old: dict[str, Column], similarity: Column) -> Column:
    """How a row relates to one that it is like: sides have type, created_h, and the new one content."""
    solved = (new["type"] == "error") & (old["type"] == "error") & (F.contains(new["content"], F.lit("[해결됨]")) | F.contains(new["content"], F.lit("resolved")))
    replaced = (new["type"] == old["type"]) & (similarity > 0.85) & (new["created_h"] > old["created_h"])
    return F.when(replaced, "superseded_by").when(solved, "resolved_by").otherwise("related")


def linked_to_nearest(s: Snapshot, new: DataFrame, k: int = 3, floor: float = 0.7) -> DataFrame:
    """(from_id, to_id, relation_type, similarity): links from the ``k`` rows of the same topic that a batch (id) is most like; the batch is small and is sent to the vectors."""
    names = ("type", "created_h", "content")
    mine = s.vectors.join(F.broadcast(new.select("id")), "id").join(s.fragments.select("id", *names), "id")
    mine = mine.select(F.col("id").alias("to_id"), "topic", F.col("embedding").alias("own"), *(F.col(c).alias(f"new_{c}") for c in names))
    near = s.vectors.join(F.broadcast(mine.select("to_id", "topic", "own")), "topic").where("id != to_id").select("to_id", F.col("id").alias("from_id"), vectors_of.cosine(F.col("own"), F.col("embedding")).alias("similarity"))
    w = Window.partitionBy("to_id").orderBy(F.desc(F.round("similarity", 9)), "from_id")
    top = near.where(F.col("similarity") > floor).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    top = top.join(mine.drop("own", "topic"), "to_id").join(s.fragments.select(F.col("id").alias("from_id"), F.col("type").alias("old_type"), F.col("created_h").alias("old_created_h")), "from_id")
    relation = link_relation({c: F.col(f"new_{c}") for c in names}, {"type": F.col("old_type"), "created_h": F.col("old_created_h")}, F.col("similarity"))
    return top.select("from_id", "to_id", relation.alias("relation_type"), "similarity")


def isolated(s: Snapshot, batch: int = 20) -> DataFrame:
    """The newest rows that have a vector and no link at all."""
    touched = s.links.select(F.col("from_id").alias("id")).unionByName(s.links.select(F.col("to_id").alias("id"))).distinct()
    return s.fragments.join(touched, "id", "left_anti").join(s.vectors.select("id"), "id", "left_semi").orderBy(F.desc("created_h"), "id").limit(batch).select("id")


def retro_link(s: Snapshot, batch: int = 20) -> Snapshot:
    """Isolated rows are linked to what they are like; rows superseded by them expire."""
    found = linked_to_nearest(s, isolated(s, batch))
    edges = found.select("from_id", "to_id", "relation_type", F.lit(1.0).alias("weight"))
    old = found.where("relation_type = 'superseded_by'").select(F.col("from_id").alias("id")).distinct().withColumn("gone", F.lit(True))
    f = s.fragments.join(old, "id", "left").withColumn("valid_to_h", F.when(F.col("gone") & F.col("valid_to_h").isNull(), F.lit(s.now_h)).otherwise(F.col("valid_to_h")))
    return replace(s, fragments=f.select(*s.fragments.columns), links=write.link(s.links, edges))


def contradictions(s: Snapshot, judged: Callable[[DataFrame], Column], newest: int = 20, k: int = 3, floor: float = 0.85) -> DataFrame:
    """(id, other, similarity, contradicts, confidence, escalate): newest rows against the nearest of their topic and tenant that aren't known to contradict them.

    ``judged`` makes a struct (contradiction, entailment, neutral) from the pairs and may be a model's pandas UDF.
    """
    new = s.fragments.join(s.vectors.select("id"), "id", "left_semi").orderBy(F.desc("created_h"), "id").limit(newest).select("id", "key_id")
    mine = s.vectors.join(F.broadcast(new), "id").select("id", "key_id", "topic", F.col("embedding").alias("own"))
    rest = s.vectors.join(s.fragments.select("id", F.col("key_id").alias("other_key")), "id").select(F.col("id").alias("other"), "other_key", "topic", "embedding")
    near = rest.join(F.broadcast(mine), "topic").where((F.col("id") != F.col("other")) & F.col("key_id").eqNullSafe(F.col("other_key")))
    near = near.select("id", "other", vectors_of.cosine(F.col("own"), F.col("embedding")).alias("similarity")).where(F.col("similarity") > floor)
    known = s.links.where("relation_type = 'contradicts'")
    known = known.select(F.col("from_id").alias("id"), F.col("to_id").alias("other")).unionByName(known.select(F.col("to_id").alias("id"), F.col("from_id").alias("other")))
    near = near.join(known, ["id", "other"], "left_anti")
    w = Window.partitionBy("id").orderBy(F.desc(F.round("similarity", 9)), "other")
    top = near.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")
    j = top.withColumn("j", judged(top))
    return j.withColumn("v", scores.nli_verdict(F.col("j.contradiction"), F.col("j.entailment"), F.col("j.neutral"))).select("id", "other", "similarity", "v.*")


def detect_contradictions(s: Snapshot, judged: Callable[[DataFrame], Column]) -> Snapshot:
    """Sure contradictions are linked and resolved."""
    found = contradictions(s, judged).where("contradicts and not escalate").select("id", "other")
    return replace(s, fragments=write.resolve_contradictions(s.fragments, found, s.now_h), links=write.link(s.links, write.contradiction_links(s.fragments, found)))


def supersessions(s: Snapshot, most: int = 10, low: float = 0.7, high: float = 0.85) -> DataFrame:
    """(a, b, similarity): active unlinked pairs of one topic, type and tenant that are alike but not equal, the most alike first."""
    f = s.fragments.where("valid_to_h is null").select("id", "type", "key_id")
    # the join's equal keys are one group: fewer, smaller groups for the block products
    v = s.vectors.join(f, "id").withColumn("topic", F.concat_ws("\x1f", "topic", "type", F.coalesce("key_id", F.lit("\x00")))).select("topic", "id", "embedding")
    pairs = knn.similar_pairs(v, low).where(F.col("similarity") <= high)
    links = s.links.select("from_id", "to_id")
    pairs = pairs.join(links, (F.col("a") == F.col("from_id")) & (F.col("b") == F.col("to_id")), "left_anti").join(links, (F.col("b") == F.col("from_id")) & (F.col("a") == F.col("to_id")), "left_anti")
    return pairs.orderBy(F.desc("similarity"), "a", "b").limit(most).select("a", "b", "similarity")


def detect_supersessions(s: Snapshot, judged: Callable[[DataFrame], Column]) -> Snapshot:
    """Of the pairs a model (``judged``: a boolean column) calls replacements, the older row gives way."""
    pairs = supersessions(s)
    born = s.fragments.select("id", "created_h")
    pairs = pairs.where(judged(pairs)).join(born.toDF("a", "a_h"), "a").join(born.toDF("b", "b_h"), "b")
    older = F.col("a_h") < F.col("b_h")
    gone = pairs.select(F.when(older, F.col("a")).otherwise(F.col("b")).alias("old"), F.when(older, F.col("b")).otherwise(F.col("a")).alias("new"))
    edges = gone.select(F.col("old").alias("from_id"), F.col("new").alias("to_id"), F.lit("superseded_by").alias("relation_type"), F.lit(1.0).alias("weight"))
    return replace(s, fragments=write.supersede(s.fragments, gone, s.now_h), links=write.link(s.links, edges))


def process_pending(s: Snapshot, pending: DataFrame, judged: Callable[[DataFrame], Column], most: int = 10) -> tuple[Snapshot, DataFrame]:
    """(snapshot, what is left): the first ``most`` pending pairs (place, id, other) are judged and resolved; the rest waits."""
    batch = pending.orderBy("place").limit(most)
    yes = batch.where(judged(batch)).select("id", "other")
    after = replace(s, fragments=write.resolve_contradictions(s.fragments, yes, s.now_h), links=write.link(s.links, write.contradiction_links(s.fragments, yes)))
    return after, pending.join(batch.select("place"), "place", "left_anti")


def calibrate(s: Snapshot, feedback: DataFrame, activity: DataFrame, most: int = 20) -> Snapshot:
    """Importance times the factor of every session with two judgements or more that used the row; never accessed rows of over 90 days are halved.

    activity: (session_id, id, place); a session counts for its first ``most`` rows. The product runs over all sessions of a row, clamped at the end of it.
    """
    by = feedback.groupBy("session_id").agg(F.bool_and("relevant").alias("r"), F.bool_and("sufficient").alias("s"), F.count("*").alias("n")).where("n >= 2")
    factors = by.select("session_id", F.log(scores.feedback_factor(F.col("r"), F.col("s"))).alias("lf"))
    moved = activity.where(F.col("place") <= most).join(factors, "session_id").groupBy("id").agg(F.sum("lf").alias("lf"))
    f = s.fragments.join(moved, "id", "left")
    once = F.when(F.col("is_anchor") | F.col("lf").isNull(), F.col("importance")).otherwise(scores.clamped(F.col("importance") * F.exp("lf"), 0.05, 1.0))
    unread = ~F.col("is_anchor") & F.col("valid_to_h").isNull() & (F.col("access_count") == 0) & (s.age() > 90)
    return replace(s, fragments=f.withColumn("importance", F.when(unread, F.greatest(F.lit(0.05), once * 0.5)).otherwise(once)).select(*s.fragments.columns))


def stale(s: Snapshot, most: int = 20) -> DataFrame:
    """(id, short, type, days) of rows not verified within their type's limit, the longest first."""
    days = F.floor((F.lit(s.now_h) - F.col("verified_h")) / 24)
    old = F.lit(s.now_h) - F.col("verified_h") > scores.by_type(F.col("type"), scores.STALE_DAYS) * 24
    short = F.when(F.length("content") > 80, F.concat(F.substring("content", 1, 80), F.lit("..."))).otherwise(F.col("content"))
    return s.fragments.where(old).select("id", short.alias("short"), "type", days.alias("days")).orderBy(F.desc("days"), "id").limit(most)


def stale_reflections(s: Snapshot, topic: str = "session_reflect", keep: int = 5, most: int = 30) -> DataFrame:
    """Ids of reflections beyond the ``keep`` best of their type that are over 30 days old, under importance 0.55, no anchors and not permanent."""
    rn = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("importance"), F.desc("created_h"), "id"))
    old = s.fragments.where(F.col("topic") == topic).withColumn("rn", rn).where((F.col("rn") > keep) & (F.col("importance") < 0.55) & (s.age() > 30) & ~F.col("is_anchor") & (F.col("ttl_tier") != "permanent"))
    return old.orderBy("importance", "id").limit(most).select("id")


def purge_reflections(s: Snapshot) -> Snapshot:
    return replace(s, fragments=s.fragments.join(stale_reflections(s), "id", "left_anti"))


def retained(events: DataFrame, now_us: int, days: int = 30) -> DataFrame:
    """Events of the last ``days`` days."""
    return events.where(F.col("us") >= now_us - days * 86_400_000_000)


def report(tool_feedback: DataFrame, task_feedback: DataFrame, since_us: int = 0) -> str:
    """A markdown report of feedback since a time: one line a tool and trigger, and the tasks' success; made of a few aggregate rows."""
    tools = tool_feedback.where(F.col("us") >= since_us).groupBy("tool_name", "trigger_type").agg(F.count("*").alias("n"), F.avg(F.col("relevant").cast("int")).alias("r"), F.avg(F.col("sufficient").cast("int")).alias("s"))
    lines = ["# Feedback report", "", "| tool | trigger | n | relevant | sufficient |", "|---|---|---|---|---|"]
    lines += [f"| {t.tool_name} | {t.trigger_type} | {t.n} | {t.r:.1%} | {t.s:.1%} |" for t in tools.orderBy("tool_name", "trigger_type").collect()]
    done = task_feedback.agg(F.count("*").alias("n"), F.avg(F.col("overall_success").cast("int")).alias("ok")).first()
    return "\n".join([*lines, "", f"Tasks: {done.n}, successful {0 if done.ok is None else done.ok:.1%}", ""])


STAGES: list[tuple[str, Callable[[Snapshot], Snapshot]]] = [
    ("ttl_transition", ttl_transition),
    ("importance_decay", importance_decay),
    ("activation_decay", activation_decay),
    ("expired_delete", expired_delete),
    ("split_long_fragments", split_long_fragments),
    ("merge_duplicates", merge_duplicates),
    ("semantic_dedup", semantic_dedup),
    ("promote_anchors", promote_anchors),
    ("retro_link", retro_link),
    ("purge_reflections", purge_reflections),
]


def run(s: Snapshot, stages=None, cut: Callable[[DataFrame], DataFrame] = written) -> tuple[Snapshot, list[dict]]:
    """Apply stages in order; ``cut`` writes and rereads what a stage leaves, so that plans don't grow from stage to stage. Returns the snapshot and one report row a stage."""
    report = []
    for name, stage in stages or STAGES:
        try:
            after = stage(s)
            after = replace(after, fragments=cut(after.fragments), links=cut(after.links))
            report.append({"stage": name, "fragments": after.fragments.count(), "error": None})
            s = after
        except Exception as e:  # a stage that fails is recorded and the next one runs
            report.append({"stage": name, "fragments": None, "error": str(e)[:500]})
    return s, report


def low_utility(fragments: DataFrame, utility: Column, floor: float = 0.15) -> DataFrame:
    """Rows under the floor of usefulness that are neither permanent nor anchors: what a collection may reach."""
    return fragments.where((utility < floor) & (F.col("ttl_tier") != "permanent") & ~F.col("is_anchor"))


def compressible(fragments: DataFrame, vectors: DataFrame, now_h: int, age_days: int = 30) -> DataFrame:
    """Active rows with a vector, of middling importance at most, that nobody has read for ``age_days``."""
    idle = fragments.where((F.col("accessed_h") < now_h - 24 * age_days) & (F.col("importance") < 0.5) & ~F.col("is_anchor") & F.col("valid_to_h").isNull())
    return idle.join(vectors.where("embedding is not null").select("id"), "id", "left_semi")
