"""Order-dependent selections: on result lists of a query (tens of rows) one list at a time by applyInPandas; of near duplicates in rounds over all pairs."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import workspace, written


def _overlap(a: set, b: set) -> float:
    most = max(len(a), len(b))
    return len(a & b) / most if most else 0.0


def mmr_order(scores: list[float], sets: list[set], trade: float = 0.7, near: list[bool] | None = None) -> list[int]:
    """Greedy maximal marginal relevance: next is the best of trade * score - (1 - trade) * nearest chosen.

    Rows without a similarity (``near`` false) take no part and come last; the first of the others comes first.
    """
    near = [True] * len(scores) if near is None else near
    left, rest = [i for i, n in enumerate(near) if n], [i for i, n in enumerate(near) if not n]
    if len(left) <= 1:
        return list(range(len(scores)))
    chosen = [left.pop(0)]
    while left:
        best = max(left, key=lambda i: (trade * scores[i] - (1 - trade) * max(_overlap(sets[i], sets[j]) for j in chosen), -i))
        chosen.append(best)
        left.remove(best)
    return chosen + rest


def mmr(results: DataFrame, trade: float = 0.7) -> DataFrame:
    """(query_id, id, score, keywords, similarity) lists -> (query_id, id, place); at most a few dozen rows a query."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "id"], ascending=[False, True])
        order = mmr_order(g.score.tolist(), [set(k) if k is not None else set() for k in g.keywords], trade, g.similarity.notna().tolist())
        return pd.DataFrame({"query_id": g.query_id.iloc[0], "id": g.id.to_numpy()[order], "place": range(1, len(g) + 1)})

    return results.groupBy("query_id").applyInPandas(run, "query_id long, id long, place int")


def slot_trim(costs: list[int], tags: list[str | None], budget: int) -> list[bool]:
    """Exact rows first up to half the budget, supplements up to a quarter, each stopping at the first that doesn't fit; then all that are left, skipping what doesn't fit.

    Without any tag the list is cut at the first row that doesn't fit.
    """
    keep, used = [False] * len(costs), 0
    if not any(t in ("exact", "supplement") for t in tags):
        for i, c in enumerate(costs):
            if used + c > budget:
                break
            keep[i], used = True, used + c
        return keep
    for tag, share in (("exact", 0.5), ("supplement", 0.25)):
        mine = 0
        for i, (c, t) in enumerate(zip(costs, tags)):
            if t != tag:
                continue
            if mine + c > budget * share or used + c > budget:
                break
            keep[i], used, mine = True, used + c, mine + c
    for i, c in enumerate(costs):
        if not keep[i] and used + c <= budget:
            keep[i], used = True, used + c
    return keep


def trim(results: DataFrame, budget: int) -> DataFrame:
    """(query_id, id, rank, tokens, tag) lists -> the rows that the slots keep."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rank")
        return g[slot_trim(g.tokens.tolist(), [t if isinstance(t, str) else None for t in g.tag], budget)]

    return results.groupBy("query_id").applyInPandas(run, results.schema)


def core_memory(rows: DataFrame, slots: dict[str, int], most: int = 15, chars: int = 6000) -> DataFrame:
    """One row of each type first, then by score under per-type slots, a row limit and a character limit. (owner, id, type, score, chars)"""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "id"], ascending=[False, True])
        first = g.groupby("type", sort=False).head(1)
        taken, used, size = list(first.index), first.type.value_counts().to_dict(), int(first.chars.sum())
        for i, r in g.drop(first.index).iterrows():
            if len(taken) >= most:
                break
            if used.get(r.type, 0) < slots.get(r.type, 3) and size + r.chars <= chars:
                taken.append(i)
                used[r.type] = used.get(r.type, 0) + 1
                size += r.chars
        return g.loc[taken]

    return rows.groupBy("owner").applyInPandas(run, rows.schema)


def resolve_duplicates(pairs: DataFrame) -> DataFrame:
    """(topic, a, b, a_h, b_h, a_anchor, b_anchor) near-duplicate pairs -> (topic, kept, dropped): newest first, anchors stay, each row is dropped once.

    The order is that of a loop over the pairs (the newer end's time, then a, b), the work is not: in every round all pairs are decided whose outcome no undecided
    pair before them can change, that is, none that would drop either of their ends. A row that nothing newer is near to settles all its pairs in one round.
    """
    keep_a = (F.col("a_h") > F.col("b_h")) | ((F.col("a_h") == F.col("b_h")) & (F.col("a") < F.col("b")))
    turn = F.struct((-F.greatest("a_h", "b_h")).alias("top"), "a", "b")
    rows = pairs.select("topic", F.when(keep_a, F.col("a")).otherwise(F.col("b")).alias("kept"), F.when(keep_a, F.col("b")).otherwise(F.col("a")).alias("dropped"), F.when(keep_a, F.col("b_anchor")).otherwise(F.col("a_anchor")).alias("anchor"), turn.alias("turn"))
    with workspace(pairs.sparkSession) as step:
        # a pair that would drop an anchor does nothing, whenever its turn comes
        left, done = step(rows.where("not anchor").drop("anchor")), []
        while True:
            first = left.groupBy("topic", "dropped").agg(F.min("turn").alias("first"))
            own = left.join(first, ["topic", "dropped"]).where("turn = first").drop("first")
            before = first.withColumnRenamed("dropped", "kept").withColumnRenamed("first", "fate")
            decided = step(own.join(before, ["topic", "kept"], "left").where("fate is null or fate > turn").select("topic", "kept", "dropped", "turn"))
            done.append(decided.select("topic", "kept", "dropped"))
            gone = decided.select("topic", F.col("dropped").alias("row"), F.col("turn").alias("gone"))
            rest = left.join(gone.select("topic", F.col("row").alias("dropped")), ["topic", "dropped"], "left_anti")
            rest = rest.join(gone.withColumnRenamed("row", "kept"), ["topic", "kept"], "left").where("gone is null or gone > turn").drop("gone")
            left = step(rest)
            if left.isEmpty():
                return written(reduce(DataFrame.unionByName, done))


def compress_groups(pairs: DataFrame, least: int = 3, most: int = 10) -> DataFrame:
    """(topic, a, b, a_imp, b_imp) pairs -> (topic, kept, member): greedy groups round the lowest id; the most important member is kept."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {}
        worth: dict[int, float] = {}
        for r in g.itertuples():
            near.setdefault(r.a, []).append(r.b)
            near.setdefault(r.b, []).append(r.a)
            worth[r.a], worth[r.b] = r.a_imp, r.b_imp
        used, out = set(), []
        for i in sorted(near):
            group = [i, *(j for j in sorted(near[i]) if j not in used)][:most]
            if i in used or len(group) < least:
                continue
            used.update(group)
            kept = max(group, key=lambda j: (worth[j], -j))
            out += [(g.topic.iloc[0], kept, j) for j in group if j != kept]
        return pd.DataFrame(out, columns=["topic", "kept", "member"])

    return pairs.groupBy("topic").applyInPandas(run, "topic string, kept long, member long")
