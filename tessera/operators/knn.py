"""Nearest neighbours and similar pairs inside groups, exact, in units of bounded size.

A group (topic) is cut into blocks of rows by a hash of the id; each pair of blocks is one unit of work that multiplies their vectors a tile at a time. A task holds two
blocks of at most 32 MB and a tile. A group has a dozen blocks until they reach that size, so a row is copied a dozen times, not once for every thousand rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block at least, blocks of a group where this suffices, bytes of a block at most; sides of a tile.
BLOCK, BLOCKS, BYTES, TILE = 16_384, 12, 1 << 25, (512, 1024)


class _Best:
    """The k best of every row of a block so far; columns come by id, so that of equals (to 9 places) the least id stays."""

    def __init__(self, n: int, k: int, floor: float):
        self.value, self.of, self.least = np.full((n, k), -9.0), np.zeros((n, k), np.int64), np.full(n, floor - 1e-12)

    def add(self, s: np.ndarray, rows: slice, cols: np.ndarray, across: bool = False) -> None:
        """A tile of a row each; ``across``: of a column each."""
        at = np.flatnonzero(s >= (self.least[None, rows] if across else self.least[rows, None]))
        if not len(at):
            return
        r, c = np.divmod(at, s.shape[1])
        v, k = np.round(s[r, c], 9), self.value.shape[1]
        r, c = (c, r) if across else (r, c)
        order = np.lexsort((c, -v, r))
        r, c, v = r[order], c[order], v[order]
        begin = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        place = np.arange(len(r)) - np.repeat(begin, np.diff(np.r_[begin, len(r)]))
        r, c, v, place, at = r[place < k], c[place < k], v[place < k], place[place < k], r[begin]
        value, of = np.full((len(at), 2 * k), -9.0), np.zeros((len(at), 2 * k), np.int64)
        value[:, :k], of[:, :k] = self.value[rows][at], self.of[rows][at]
        row = np.searchsorted(at, r)
        value[row, k + place], of[row, k + place] = v, cols[c]
        order = np.argsort(-value, axis=1, kind="stable")[:, :k]
        value, of = np.take_along_axis(value, order, 1), np.take_along_axis(of, order, 1)
        self.value[rows][at], self.of[rows][at] = value, of
        full = value[:, -1] > -9
        # what is equal to the last of k comes too late
        self.least[rows][at[full]] = value[full, -1] + 5e-10

    def listed(self, ids: np.ndarray) -> list[np.ndarray]:
        r, p = np.nonzero(self.value > -9)
        return [ids[r], self.of[r, p], self.value[r, p]]


def _tiles(left: dict, right: dict, same: bool) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Products of two blocks by tile; what a row is linked to counts as -2. Of a block with itself (``same``) only tiles from the diagonal on."""
    order = np.argsort(left["of"], kind="stable")
    of, other = left["of"][order], left["linked"][order]
    place = np.minimum(np.searchsorted(right["id"], other), max(len(right["id"]) - 1, 0))
    met = right["id"][place] == other if len(right["id"]) else np.zeros(len(other), bool)
    of, place = of[met], place[met]
    for lo in range(0, len(left["id"]), TILE[0]):
        rows = slice(lo, min(lo + TILE[0], len(left["id"])))
        a, b = np.searchsorted(of, [rows.start, rows.stop])
        for at in range(0, len(right["id"]), TILE[1]):
            cols = slice(at, min(at + TILE[1], len(right["id"])))
            if same and cols.stop <= rows.start:
                continue
            s = left["x"][rows] @ right["x"][cols].T
            here = (place[a:b] >= cols.start) & (place[a:b] < cols.stop)
            s[of[a:b][here] - rows.start, place[a:b][here] - cols.start] = -2
            yield rows, cols, s


def _pairs_of(floor: float, high: float | None = None):
    """Unit -> its pairs from ``floor`` up (left, right, similarity), or with ``high`` only the number of those that aren't above it."""

    def work(left, right, same):
        for rows, cols, s in _tiles(left, right, same):
            near = s >= floor - 1e-12
            near &= left["id"][rows, None] < right["id"][None, cols] if same else left["id"][rows, None] != right["id"][None, cols]
            if high is not None:
                yield [np.array([np.count_nonzero(near & (s <= high))])]
            else:
                p, q = np.nonzero(near)
                yield [left["id"][rows][p], right["id"][cols][q], s[p, q]]

    return work


def _best_of(k: int, floor: float, both: bool):
    """Unit -> the k best rights of every left (id, neighbour, similarity); with ``both`` of every right its lefts as well."""

    def work(left, right, same):
        ours = _Best(len(left["id"]), k, floor)
        theirs = ours if same else _Best(len(right["id"]), k, floor)
        parts = [ours]
        if both and not same:
            parts.append(theirs)
        # of a block with itself all tiles are looked at, by row
        for rows, cols, s in _tiles(left, right, False):
            if same:
                s[left["id"][rows, None] == right["id"][None, cols]] = -2
            ours.add(s, rows, right["id"][cols])
            if both and not same:
                theirs.add(s, cols, left["id"][rows], across=True)
        for part, ids in zip(parts, (left["id"], right["id"])):
            yield part.listed(ids)

    return work


def _run(dealt: DataFrame, work: Callable, schema: str) -> DataFrame:
    """Rows (topic, i, j, side, id, embedding, linked) -> what ``work`` makes of each unit, after its topic. Sides are sorted by id; a block with itself has one side."""
    kinds = {"long": pa.int64(), "double": pa.float64()}
    fields = [f.strip().split(" ") for f in schema.split(",")]

    def made(topic, held):
        t = pa.Table.from_batches(held).combine_chunks()
        side = t["side"].to_numpy()
        cut, sides = int(np.searchsorted(side, 1)), []
        for part in (t.slice(0, cut), t.slice(cut)):
            vecs, linked = part["embedding"].combine_chunks(), part["linked"].combine_chunks()
            x = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vecs), -1) if len(vecs) else np.zeros((0, 1))
            n = np.linalg.norm(x, axis=1, keepdims=True)
            size = linked.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            sides.append({"id": part["id"].to_numpy(), "x": np.divide(x, n, out=np.zeros_like(x), where=n > 0), "of": np.repeat(np.arange(len(vecs)), size), "linked": linked.flatten().to_numpy(zero_copy_only=False).astype(np.int64)})
        same = t["i"][0].as_py() == t["j"][0].as_py() and not len(sides[1]["id"])
        if len(sides[0]["id"]) and (same or len(sides[1]["id"])):
            for columns in work(sides[0], sides[0] if same else sides[1], same):
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays([pa.array([topic] * len(columns[0]), pa.string()), *(pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields))], names=["topic", *(f for f, _ in fields)])

    def run(batches):
        unit, held = None, []
        for b in batches:
            t, at = b.column("topic").dictionary_encode(), 0
            marks = np.stack([t.indices.to_numpy(zero_copy_only=False), b.column("i").to_numpy(), b.column("j").to_numpy()], 1) if b.num_rows else np.zeros((0, 3), int)
            begin = np.flatnonzero(np.r_[True, (marks[1:] != marks[:-1]).any(1)]) if len(marks) else []
            for at, to in zip(begin, [*begin[1:], len(marks)]):
                now = (t.dictionary[int(marks[at, 0])].as_py(), *marks[at, 1:].tolist())
                if now != unit and held:
                    yield from made(unit[0], held)
                    held = []
                unit = now
                held.append(b.slice(at, to - at))
        if held:
            yield from made(unit[0], held)

    units = dealt.repartition("topic", "i", "j").sortWithinPartitions("topic", "i", "j", "side", "id")
    return units.mapInArrow(run, f"topic string, {schema}")


def _sizes(vectors: DataFrame, block: int | None, name: str) -> DataFrame:
    """(topic, name): the number of blocks of every topic."""
    cap = F.greatest(F.lit(1), F.floor(F.lit(BYTES) / (8 * F.greatest(F.max(F.size("embedding")), F.lit(1)))))
    rows = F.least(cap, F.greatest(F.ceil(F.count("*") / BLOCKS), F.lit(BLOCK))) if block is None else F.lit(block)
    return vectors.groupBy("topic").agg(F.ceil(F.count("*") / rows).cast("int").alias(name))


def _own(blocks: str) -> Column:
    return F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")


def _usable(vectors: DataFrame) -> DataFrame:
    linked = F.col("linked") if "linked" in vectors.columns else F.array().cast("array<bigint>").alias("linked")
    return vectors.where("embedding is not null").select("topic", "id", "embedding", linked)


def _with_itself(vectors: DataFrame, block: int | None) -> DataFrame:
    """Every row in the units of its block with each block of the topic."""
    rows = _usable(vectors)
    rows = rows.join(_sizes(rows, block, "blocks"), "topic").withColumn("own", _own("blocks"))
    rows = rows.select("topic", "id", "embedding", "linked", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    return rows.select("topic", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), (F.col("own") > F.col("with")).cast("int").alias("side"), "id", "embedding", "linked")


def _with_others(asked: DataFrame, vectors: DataFrame, block: int | None) -> DataFrame:
    """Every asked row (side 0) in units with each block of the topic's rows (side 1)."""
    ours, rows = _usable(asked), _usable(vectors)
    sizes = _sizes(ours, block, "asked").join(_sizes(rows, block, "blocks"), "topic")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = ours.join(sizes, "topic").select("topic", _own("asked").alias("i"), upto("blocks").alias("j"), F.lit(0).alias("side"), "id", "embedding", "linked")
    right = rows.join(sizes, "topic").select("topic", upto("asked").alias("i"), _own("blocks").alias("j"), F.lit(1).alias("side"), "id", "embedding", "linked")
    return left.unionByName(right)


def similar_pairs(vectors: DataFrame, floor: float, block: int | None = None) -> DataFrame:
    """(topic, a, b, similarity) for a < b of one topic with cosine at or above ``floor``."""
    found = _run(_with_itself(vectors, block), _pairs_of(floor), "l long, r long, similarity double")
    return found.select("topic", F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b"), "similarity")


def counted_pairs(vectors: DataFrame, low: float, high: float, block: int | None = None) -> DataFrame:
    """(topic, n): pairs with cosine between ``low`` and ``high``; a unit gives counts, no pairs."""
    found = _run(_with_itself(vectors, block), _pairs_of(low, high), "n long")
    return found.groupBy("topic").agg(F.sum("n").alias("n")).where("n > 0")


def similar_to(asked: DataFrame, vectors: DataFrame, floor: float, block: int | None = None) -> DataFrame:
    """(topic, id, neighbour, similarity): for every asked row (topic, id, embedding) the other rows of the topic with cosine at or above ``floor``."""
    return _run(_with_others(asked, vectors, block), _pairs_of(floor), "id long, neighbour long, similarity double")


def nearest_to(asked: DataFrame, vectors: DataFrame, k: int, floor: float, block: int | None = None) -> DataFrame:
    """(id, neighbour, similarity, rank): for every asked row the k nearest rows of the topic at or above the floor, itself included if it is there."""
    return _ranked(_run(_with_others(asked, vectors, block), _best_of(k, floor, False), "id long, neighbour long, similarity double"), k)


def nearest_pairs(vectors: DataFrame, k: int, floor: float, block: int | None = None) -> DataFrame:
    """(topic, a, b, similarity) for a < b where either is among the k nearest of the other: at most k pairs a row."""
    near = nearest(vectors, k, floor, block).select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b"), "similarity").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    return near.join(vectors.select(F.col("id").alias("a"), "topic"), "a").select("topic", "a", "b", "similarity")


def nearest(vectors: DataFrame, k: int, floor: float, block: int | None = None) -> DataFrame:
    """(id, neighbour, similarity, rank): the k nearest rows of the same topic at or above the floor, none of those that a row's ``linked`` (ids, on both rows) has, if there is such a column."""
    return _ranked(_run(_with_itself(vectors, block), _best_of(k, floor, True), "id long, neighbour long, similarity double"), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("id").orderBy(F.desc(F.round("similarity", 9)), "neighbour")
    return found.drop("topic").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
