"""The embedding queue as a stateful stream: attempts, back-off and dead letters by fragment; links for what has become ready.

``ready`` keeps a fragment's attempts in state and a timer for its next one, so a restart goes on where it was. What it emits is written by batch
(``linked``): links of newly embedded fragments to their nearest stored neighbours, into folders named by batch, which a replayed batch overwrites.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators import ivf

RETRIES, FIRST_WAIT_MS, MOST_WAIT_MS = 3, 1000, 60_000
OUT = "id long, embedding array<double>, attempts int, state string, error string"


def wait_ms(attempts: int) -> int:
    """How long a fragment waits after so many failures: twice as long each time, up to a minute."""
    return min(MOST_WAIT_MS, FIRST_WAIT_MS * 2 ** (attempts - 1))


class Attempts(StatefulProcessor):
    """Embeds a fragment's newest text; what fails is tried again by timer, and is dead after ``retries`` attempts."""

    def __init__(self, embed: Callable[[str], np.ndarray], retries: int = RETRIES):
        self.embed, self.retries = embed, retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.left = handle.getValueState("left", "content string, attempts int")

    def _try(self, key: int, content: str, before: int, now_ms: int) -> pd.DataFrame:
        if content is None or not content.strip():
            return pd.DataFrame()  # a blank text is never embedded
        try:
            row = (key, [float(x) for x in self.embed(content)], before + 1, "ready", None)
        except Exception as e:  # noqa: BLE001  whatever the model raises is a failed attempt
            if before + 1 < self.retries:
                self.left.update((content, before + 1))
                self.handle.registerTimer(now_ms + wait_ms(before + 1))
                return pd.DataFrame()
            row = (key, None, before + 1, "dead", str(e))
        self.left.clear()
        return pd.DataFrame([row], columns=["id", "embedding", "attempts", "state", "error"])

    def _forget_timers(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = None
        for part in rows:
            for at, content in zip(part["at"], part["content"]):
                if newest is None or at >= newest[0]:
                    newest = (at, content)
        # a new text starts afresh
        self._forget_timers()
        self.left.clear()
        out = self._try(int(key[0]), newest[1], 0, timerValues.getCurrentProcessingTimeInMs())
        if len(out):
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.left.exists():
            content, attempts = self.left.get()
            out = self._try(int(key[0]), content, attempts, timerValues.getCurrentProcessingTimeInMs())
            if len(out):
                yield out

    def close(self) -> None:
        pass


def ready(queue: DataFrame, embed: Callable[[str], np.ndarray], retries: int = RETRIES) -> DataFrame:
    """(id, embedding, attempts, state, error) of a stream of (id, content, at): ``ready`` rows as they succeed, ``dead`` ones as they are given up.

    Needs the RocksDB state store. ``embed`` makes a vector of a text and may raise.
    """
    return queue.groupBy("id").transformWithStateInPandas(statefulProcessor=Attempts(embed, retries), outputStructType=OUT, outputMode="Append", timeMode="ProcessingTime")


def linked(index: ivf.Index, path: str, k: int = 3, floor: float = 0.7) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: stores what is ready and dead, and links every ready fragment to its nearest neighbours in the index.

    Folders are named by batch, so a batch replayed after a crash leaves what it would have left at once.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        where = lambda kind: f"{path}/{kind}/batch={batch_id}"
        df.where("state = 'ready'").select("id", "embedding", "attempts").write.mode("overwrite").parquet(where("ready"))
        df.where("state = 'dead'").select("id", "attempts", "error").write.mode("overwrite").parquet(where("dead"))
        # what was written is read back: the stateful step runs once a batch
        new = df.sparkSession.read.schema("id long, embedding array<double>, attempts int").parquet(where("ready"))
        near = ivf.search(index, new.select(F.col("id").alias("qid"), "embedding"), k=k + 1, floor=floor)
        links = near.where("qid != id").where(F.col("rank") <= k + 1).select(F.col("qid").alias("from_id"), F.col("id").alias("to_id"), F.lit("related").alias("relation_type"), F.col("similarity").alias("weight"))
        links.write.mode("overwrite").parquet(where("links"))

    return batch
