"""Stored vector index: k-means cells, byte codes of residuals, exact re-ranking.

Cells are fitted on a bounded sample (``SAMPLE`` rows of least hash), every row is indexed. The index is a table partitioned by cell and sorted by tenant
inside, so a search reads the cells it probes and, of them, the row groups of its tenants. Filters are plain predicates on the index's own columns: they are applied
inside the probe, before anything is ranked, so that a narrow filter costs no results. A search ranks by codes (a byte a dimension, the embeddings aren't read), then
fetches the embeddings of ``refine`` times k rows a query and ranks these by exact cosine. ``exact`` leaves the cells aside and multiplies all rows that pass with all
queries, in blocks (``knn``).

Work is dealt in units of (cell, block of rows, block of queries) of bounded size: neither a cell with a third of all rows nor a cell that all queries probe is one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import knn

#: Rows the cells are fitted on; cells at most; rows and queries of a unit; rounds of k-means.
SAMPLE, CELLS, BLOCK, QUERIES, ROUNDS = 16_384, 4096, 8192, 1024, 12
#: Queries whose cells are listed at once.
ASKED = 64


@dataclass
class Index:
    """A written index: rows (id, kept columns, embedding, code, scale, cell), the cells' centres and sizes."""

    rows: DataFrame
    centres: np.ndarray
    sizes: DataFrame


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _vectors(col: pa.Array) -> np.ndarray:
    return _unit(np.array(col.to_pylist(), np.float64).reshape(len(col), -1))


def centres_of(x: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Unit centres of k-means by cosine; an empty cell takes the row that is worst off."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = x @ centres.T
        of = near.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        empty = np.flatnonzero(np.bincount(of, minlength=len(centres)) == 0)
        sums[empty] = x[np.argsort(near.max(1))[: len(empty)]]
        centres = _unit(sums)
    return centres


def _usable(vectors: DataFrame) -> DataFrame:
    fine = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("embedding", lambda x: x != 0)
    return vectors.where(fine)


def build(vectors: DataFrame, path: str, keep: tuple[str, ...] = (), sort: str | None = None, sample: int = SAMPLE, cells: int | None = None) -> Index:
    """Write the index of (id, embedding, columns to keep) to ``path``. Vectors that are null, zero or not finite can't be found and aren't indexed."""
    spark = vectors.sparkSession
    rows = _usable(vectors).select("id", *keep, "embedding")
    n = rows.count()
    share = min(1.0, (sample + 6 * sample**0.5) / max(n, 1))
    drawn = rows if share >= 1 else rows.where(F.xxhash64("id") < F.lit(int(-(2**63) + share * 2**64)))
    x = _vectors(drawn.orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").toArrow().column("embedding").combine_chunks()) if n else np.zeros((0, 0))
    centres = centres_of(x, cells or min(CELLS, max(1, math.isqrt(n)))) if n else x
    sent = spark.sparkContext.broadcast(centres)  # at most CELLS of them

    def coded(batches):
        for b in (b.slice(lo, QUERIES) for b in batches for lo in range(0, b.num_rows, QUERIES)):
            v = _vectors(b.column("embedding"))
            cell = (v @ sent.value.T).argmax(1) if len(v) else np.zeros(0, int)
            rest = v - sent.value[cell] if len(v) else v
            scale = np.maximum(np.abs(rest).max(1, initial=0.0), 1e-12) / 127
            code = np.rint(rest / scale[:, None]).astype(np.int8)
            made = [pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale, pa.float64()), pa.array(cell.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, "code", "scale", "cell"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    made = rows.mapInArrow(coded, f"{schema}, code binary, scale double, cell int")
    # a large cell is written by several tasks
    dealt = made.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(max(1, n // (CELLS * BLOCK))))).sortWithinPartitions("cell", *([sort] if sort else []))
    dealt.write.partitionBy("cell").parquet(f"{path}/rows")
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>").write.parquet(f"{path}/centres")
    read = spark.read.schema(made.schema).parquet(f"{path}/rows")
    read.groupBy("cell").agg(F.count("*").alias("n")).write.parquet(f"{path}/sizes")
    return opened(spark, path, made.schema)


def opened(spark: SparkSession, path: str, schema=None) -> Index:
    """An index written before."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    centres = spark.read.parquet(f"{path}/centres").orderBy("cell").toPandas()["centre"].tolist()  # at most CELLS rows
    return Index(reader.parquet(f"{path}/rows"), np.array(centres, np.float64).reshape(len(centres), -1 if centres else 0), spark.read.parquet(f"{path}/sizes"))


def _probed(queries: DataFrame, sent, probes: int) -> DataFrame:
    """(qid, q, cell): the ``probes`` cells nearest to every query."""

    def run(batches):
        # a query is written once a cell
        for b in (b.slice(lo, ASKED) for b in batches for lo in range(0, b.num_rows, ASKED)):
            v = _vectors(b.column("embedding"))
            n = min(probes, len(sent.value))
            cells = np.argsort(-(v @ sent.value.T), axis=1, kind="stable")[:, :n] if len(v) else np.zeros((0, n), int)
            take = pa.array(np.repeat(np.arange(len(v)), n))
            q = pa.array([x.tobytes() for x in v], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("qid").take(take), q.take(take), pa.array(cells.ravel().astype(np.int32))], names=["qid", "q", "cell"])

    return queries.select("qid", "embedding").mapInArrow(run, f"qid {queries.schema['qid'].dataType.simpleString()}, q binary, cell int")


def _unit_best(sent, most: int, exact: bool):
    """Sorted rows of units (cell, block, qblock), queries before index rows -> each unit's ``most`` best rows of every query, by code or by embedding; ties by id."""

    def run(batches):
        key, asked, names, held = None, [], [], []
        out_type = None

        def finish():
            parts = []
            if held and asked:
                ids = [i for h in held for i in h[0]]
                s = np.round(np.concatenate([h[1] for h in held]), 9)
                for j, name in enumerate(names):
                    least = np.partition(s[:, j], len(s) - most)[len(s) - most] if len(s) > most else -np.inf
                    best = sorted(np.flatnonzero(s[:, j] >= least).tolist(), key=lambda i: (-s[i, j], ids[i]))[:most]  # noqa: B023
                    parts += [(name, key[0], ids[i], float(s[i, j])) for i in best]
            return parts

        def emit(parts):
            return pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in parts], out_type[0]), pa.array([p[1] for p in parts], pa.int32()), pa.array([p[2] for p in parts], out_type[1]), pa.array([p[3] for p in parts], pa.float64())], names=["qid", "cell", "id", "near"]
            )

        for b in batches:
            out_type = (b.schema.field("qid").type, b.schema.field("id").type)
            marks = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "block", "qblock", "side")], 1) if b.num_rows else np.zeros((0, 4), int)
            begin = np.flatnonzero(np.r_[True, (marks[1:] != marks[:-1]).any(1)]) if len(marks) else []
            for lo, hi in zip(begin, [*begin[1:], len(marks)]):
                now, part = tuple(int(x) for x in marks[lo, :3]), b.slice(lo, hi - lo)
                if now != key:
                    if parts := finish():
                        yield emit(parts)
                    key, asked, names, held = now, [], [], []
                if marks[lo, 3] == 0:
                    asked += [np.frombuffer(x) for x in part.column("q").to_pylist()]
                    names += part.column("qid").to_pylist()
                elif asked:
                    q = np.array(asked)
                    if exact:
                        s = _vectors(part.column("v")) @ q.T
                    else:
                        code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.int8).reshape(hi - lo, -1)
                        s = (sent.value[key[0]] @ q.T) + part.column("scale").to_numpy()[:, None] * (code.astype(np.float64) @ q.T)
                    held.append((part.column("id").to_pylist(), s))
        if parts := finish():
            yield emit(parts)

    return run


def search(index: Index, queries: DataFrame, k: int = 10, probes: int = 16, floor: float = -1.0, where: Column | None = None, refine: int = 4, exact: bool = False) -> DataFrame:
    """(qid, id, similarity, rank): for every query (qid, embedding) the k nearest rows that pass ``where``, of the cells probed, by exact cosine; ties by id.

    ``exact`` looks at every row. Queries that are null, zero or not finite find nothing.
    """
    spark = queries.sparkSession
    if exact and index.rows.schema["id"].dataType == T.LongType() == queries.schema["qid"].dataType:
        one = F.lit("").alias("topic")
        rows = index.rows if where is None else index.rows.where(where)
        found = knn.nearest_to(_usable(queries).select(one, F.col("qid").alias("id"), "embedding"), rows.select(one, "id", "embedding"), k, floor)
        return found.select(F.col("id").alias("qid"), F.col("neighbour").alias("id"), "similarity", "rank")
    if not len(index.centres):
        found = T.StructType([queries.schema["qid"], index.rows.schema["id"], T.StructField("similarity", T.DoubleType()), T.StructField("rank", T.IntegerType())])
        return spark.createDataFrame([], found)
    asked = _usable(queries)
    blocks = max(1, math.ceil(asked.count() / QUERIES))
    sent = spark.sparkContext.broadcast(index.centres)
    found = _probed(asked, sent, len(index.centres) if exact else probes).withColumn("qblock", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
    per_cell = F.ceil(F.col("n") / BLOCK).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    wanted = found.select("cell").distinct()
    sizes = index.sizes.join(wanted, "cell", "left_semi").withColumn("blocks", per_cell).select("cell", "blocks")
    rows = index.rows if where is None else index.rows.where(where)
    kind = index.rows.schema["embedding"].dataType
    form = (F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("scale"), F.col("embedding").alias("v")) if exact else (F.col("code"), F.col("scale"), F.lit(None).cast(kind).alias("v"))
    narrow = rows.select("cell", "id", *form).join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # only blocks of queries that probe the cell are met; sizes and these pairs have at most CELLS rows (times blocks of queries)
    narrow = narrow.join(found.select("cell", "qblock").distinct(), "cell")
    none = lambda name, df: F.lit(None).cast(df.schema[name].dataType).alias(name)
    order = ["cell", "block", "qblock", "side", "qid", "q", "id", "code", "scale", "v"]
    left = found.join(F.broadcast(sizes), "cell").select("cell", upto(F.col("blocks")).alias("block"), "qblock", F.lit(0).alias("side"), "qid", "q", none("id", index.rows), F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("scale"), F.lit(None).cast(kind).alias("v"))
    right = narrow.select("cell", "block", "qblock", F.lit(1).alias("side"), none("qid", queries), F.lit(None).cast("binary").alias("q"), "id", "code", "scale", "v").select(*order)
    dealt = left.select(*order).unionByName(right).repartition("cell", "block", "qblock").sortWithinPartitions("cell", "block", "qblock", "side")
    types = [index.rows.schema["id"].dataType.simpleString(), queries.schema["qid"].dataType.simpleString()]
    most = k if exact else refine * k
    near = dealt.mapInArrow(_unit_best(sent, most, exact), f"qid {types[1]}, cell int, id {types[0]}, near double")
    near = near.withColumn("rn", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("near"), "id"))).where(F.col("rn") <= most).drop("rn")
    full = near.select("qid", "cell", "id").join(index.rows.select("cell", "id", "embedding"), ["cell", "id"]).join(asked.select("qid", F.col("embedding").alias("own")), "qid")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    cosine = dot("embedding", "own") / (F.sqrt(dot("embedding", "embedding")) * F.sqrt(dot("own", "own")))
    ranked = full.select("qid", "id", cosine.alias("similarity")).where(F.col("similarity") >= floor)
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("similarity", 9)), "id")
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(qid, wanted, met, recall) of a search against the exact one."""
    hits = exact.select("qid", "id").join(found.select("qid", "id").withColumn("hit", F.lit(1)), ["qid", "id"], "left")
    return hits.groupBy("qid").agg(F.count("*").alias("wanted"), F.count("hit").alias("met"), (F.count("hit") / F.count("*")).alias("recall"))
