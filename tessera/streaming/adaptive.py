"""Ordered folds of stateful pieces: activation, adaptive thresholds, working memory, feedback sampling, link changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def activation(ema: float, last_s: float | None, now_s: float, rate: float = 0.3) -> float:
    """New activation after an access: the sample is the gap to the power -1/2, a second at least; a first access counts a day's gap."""
    gap = max(now_s - last_s, 1.0) if last_s is not None else 86_400.0
    return rate * gap**-0.5 + (1 - rate) * ema


def activations(accesses: DataFrame, key: str, time_us: str, id_: str, rate: float = 0.3, reach: int = 120) -> DataFrame:
    """Accesses with ``ema``, the activation of their key after them. Accesses more than ``reach`` back weigh under 1e-18 of the newest and are left out, so no state grows."""
    w = Window.partitionBy(key).orderBy(time_us, id_)
    gap = (F.col(time_us) - F.lag(time_us).over(w)) / 1e6
    sample = rate * F.pow(F.greatest(F.coalesce(gap, F.lit(86_400.0)), F.lit(1.0)), F.lit(-0.5))
    near = F.collect_list("sample_").over(w.rowsBetween(1 - reach, 0))
    return accesses.withColumn("sample_", sample).withColumn("ema", F.aggregate(near, F.lit(0.0), lambda a, x: (1 - rate) * a + x)).drop("sample_")


def adapt(threshold: float, samples: int, mean: float, gate: int = 50, step: float = 0.01, low: float = 0.10, high: float = 0.60, few: float = 1, many: float = 8) -> float:
    """After ``gate`` samples: a mean under ``few`` results lowers a similarity threshold, over ``many`` raises it, inside [low, high]."""
    if samples < gate:
        return threshold
    move = -step if mean < few else step if mean > many else 0.0
    return min(high, max(low, round(threshold + move, 10)))


def evict(items: list[tuple[int, float, int]], limit: int = 500, keep: float = 0.8) -> list[tuple[int, float, int]]:
    """(id, importance, tokens) oldest first: the oldest of importance at or under ``keep`` go until the tokens fit."""
    total, out = sum(t for _, _, t in items), []
    for item in items:
        if total > limit and item[1] <= keep:
            total -= item[2]
        else:
            out.append(item)
    return out


def sampled(state: tuple[float, int], time_s: float, draw: float, rate: float = 0.2, cooldown_s: float = 900, most: int = 2) -> tuple[tuple[float, int], bool]:
    """Whether a call of a session is sampled: a draw under the rate, a cooldown since the last one and a cap; state is (last, count)."""
    last, n = state
    hit = n < most and time_s - last >= cooldown_s and draw < rate
    return ((time_s, n + 1) if hit else state), hit


#: What an action adds to a link's weight.
LINK_DELTAS = {"reinforce": 0.2, "decay": -0.15, "quarantine": -0.3, "restore": 0.3, "soft_delete": 0.0}


def reconsolidate(state: tuple[float, float, str | None, bool, float], action: str, time_s: float, cooldown_s: float = 60) -> tuple[tuple, bool]:
    """A link after an action, and whether it took effect; state is (weight, confidence, quarantine, deleted, time of the last decay).

    Weight stays in [0, 2]; confidence falls by 0.1 or rises by 0.05 in [0, 1]. A decay or quarantine within a minute of the last, and any
    action on a deleted link, does nothing.
    """
    weight, confidence, quarantine, deleted, last = state
    if action in ("decay", "quarantine"):
        if time_s - last < cooldown_s:
            return state, False
        last = time_s
    if deleted:
        return (weight, confidence, quarantine, deleted, last), False
    d = LINK_DELTAS.get(action, 0.0)
    weight = min(2.0, max(0.0, weight + d))
    confidence = max(0.0, confidence - 0.1) if d < 0 else min(1.0, confidence + 0.05) if d > 0 else confidence
    quarantine = {"quarantine": "soft", "restore": "released"}.get(action, quarantine)
    return (weight, confidence, quarantine, action == "soft_delete", last), True


def folded(events: DataFrame, key: str, order: list[str], schema: str, start: Callable[[], object], step: Callable) -> DataFrame:
    """Replay events by key in order: ``step(state, row) -> (state, output tuple)``; rows stream through sorted partitions."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, state, fresh = None, None, True
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                if fresh or getattr(row, key) != who:
                    who, state, fresh = getattr(row, key), start(), False
                state, made = step(state, row)
                out.append(made)
            yield pd.DataFrame(out, columns=names)

    return events.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
