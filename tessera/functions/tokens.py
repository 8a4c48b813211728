"""Token counts: byte-pair merging by a table of ranks that the caller names, or a quarter of the characters."""

from __future__ import annotations

import base64

import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: How a text is cut before its bytes are merged: contractions, words, numbers and signs, each with the blank before it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(path: str) -> dict[bytes, int]:
    """A table of ``base64 rank`` lines: a token's bytes and when they are merged. The driver reads it; it has some ten thousand rows."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Merger:
    """Counts tokens; words seen before aren't merged again."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, most: int = 200_000):
        self.ranks, self.pattern, self.most, self.known = ranks, regex.compile(pattern), most, {}

    def word(self, data: bytes) -> int:
        """Number of tokens of one piece: the pair of least rank is merged, the leftmost of equals, until none is in the table."""
        if data in self.ranks:
            return 1
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            rank, k = min((self.ranks.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return len(parts)

    def count(self, text: str | None) -> int:
        total = 0
        for piece in self.pattern.findall(text or ""):
            n = self.known.get(piece)
            if n is None:
                if len(self.known) >= self.most:
                    self.known.clear()
                n = self.word(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= 64:
                    self.known[piece] = n
            total += n
        return total


def estimated(c: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4).cast("long")


def token_count(spark: SparkSession, c: Column, ranks: dict[bytes, int] | None = None) -> Column:
    """Tokens of a text by a rank table, which is sent once; without one the estimate. Null and empty texts have none."""
    if ranks is None:
        return estimated(c)
    sent = spark.sparkContext.broadcast(ranks)

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        merger = Merger(sent.value)
        return texts.map(merger.count).astype("int64")

    return run(c)
