"""Ranked lexical search: impact-ordered postings, score at a time, safe early stop.

Terms are the maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z lower-cased. With N documents that have a term, L terms
in all, df documents holding a term, a document of n terms and tf occurrences in it, a term weighs floor(1000 ln((2N + 2) / (2 df + 1))) and
its impact in the document is 10^9 tf div (1000 tf + 8 m), m = 25 + 75 n N div L. A document's score for an item is the sum of weight x impact
over the item's terms, repeats included.

The plan: one scan of the texts writes (doc_id, n, terms, tfs) of the terms asked for (``postings``); N, L and df are aggregated from it. Tasks
then cut its rows into shards of bounded size and invert them: a shard's postings lie grouped by (term, impact), impacts descending. For an item
whole impact groups are taken in descending order of what they add, from all its terms at once, and added to the documents' accumulators.
Before each step the next impact of every term bounds what a document may still gain. As soon as that sum is below the k-th best score of the
task so far, no document unseen can come in; the accumulators that the bound leaves are completed from their documents' own lists. If it never gets
there, all groups are taken. Either way scores are exact and ties go to the smaller doc_id. The task's best k pass on to its next shard, so that later
shards stop earlier; a task returns k rows an item. These meet in two steps, by (item, part) and by item.

Items are searched in chunks of at most ``chunk`` pairs of item and term (the proven bound of what is sent to tasks), one scan of the texts each.

Defined cases: null and empty texts have no terms, are in no count and never found; an item without terms finds nothing; items alike in id and
text count once, one id with several texts is as many items; repeated rows are documents of their own and take ranks of their own; a document without
an id comes last among equal scores; with no documents or no items there are no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import alnum_words, batch, ddl, map_batches, materialise, settings

TOP = 10
#: Pairs of item and term that are sent to tasks at a time.
CHUNK = 400_000
#: A shard's postings and documents; texts of an Arrow batch.
SHARD_POSTINGS, SHARD_DOCS, BATCH = 1_500_000, 16_384, 1000
#: Impacts are below this; a posting's key is term * IMPACTS + (IMPACTS - 1 - impact).
IMPACTS = 1 << 20
#: Parts of the tasks' results that are merged apart.
SALTS = 64


@dataclass
class Items:
    """Items asked together: their ids, their terms as numbers with how often each has it, and the terms by number."""

    ids: list
    terms: list[np.ndarray]
    times: list[np.ndarray]
    numbers: dict[bytes, int]


def chunks(items: DataFrame, chunk: int = CHUNK) -> Iterator[Items]:
    """Distinct (item_id, text) with terms, at most ``chunk`` (plus one item's) pairs of item and term at a time."""
    now, n = Items([], [], [], {}), 0
    for row in items.select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        found = Counter(alnum_words(row.text))
        if not found:
            continue
        now.ids.append(row.item_id)
        now.terms.append(np.array([now.numbers.setdefault(w, len(now.numbers)) for w in found], np.int64))
        now.times.append(np.array(list(found.values()), np.int64))
        n += len(found)
        if n >= chunk:
            yield now
            now, n = Items([], [], [], {}), 0
    if now.ids:
        yield now


def postings(docs: DataFrame, sent) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: its length, and which of the terms asked for it holds how often."""

    def start():
        numbers = sent.value.numbers

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            n, terms, tfs = [], [], []
            for text in b.column("text").to_pylist():
                words = alnum_words(text)
                found = Counter(filter(numbers.__contains__, words))
                n.append(len(words))
                terms.append([numbers[w] for w in found])
                tfs.append(list(found.values()))
            out = batch(doc_id=b.column("doc_id"), n=(n, pa.int64()), terms=(terms, pa.list_(pa.int32())), tfs=(tfs, pa.list_(pa.int32())))
            return out.filter(pa.array(np.array(n, np.int64) > 0))

        return run

    narrow = docs.select("doc_id", "text")
    with settings(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=BATCH):
        return materialise(map_batches(narrow, f"{ddl(narrow.select('doc_id'))}, n long, terms array<int>, tfs array<int>", start))


def weights(made: DataFrame, terms: int) -> tuple[np.ndarray, int, int]:
    """Weight of every term asked for, by number; N and L."""
    total, size = (int(x) for x in made.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first())
    counts = made.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()  # at most one row a term
    df = np.zeros(terms)
    df[counts.column("t").to_numpy()] = counts.column("count").to_numpy()
    return np.floor(1000 * np.log((2 * total + 2) / (2 * df + 1))).astype(np.int64), total, size


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges, one after another."""
    n = end - begin
    return np.repeat(begin - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())


class Shard:
    """Documents of a shard with their own lists, and inverted: postings by term, impacts descending."""

    def __init__(self, parts: list[pa.RecordBatch], total: int, size: int):
        flat = lambda c: np.concatenate([p.column(c).flatten().to_numpy(zero_copy_only=False) for p in parts]).astype(np.int64)
        self.kind = parts[0].schema.field("doc_id").type
        self.ids = [i for p in parts for i in p.column("doc_id").to_pylist()]
        lengths = np.concatenate([p.column("terms").value_lengths().to_numpy(zero_copy_only=False) for p in parts]).astype(np.int64)
        m = np.array([25 + 75 * n * total // size for p in parts for n in p.column("n").to_pylist()], np.int64)
        self.term, tf, doc = flat("terms"), flat("tfs"), np.repeat(np.arange(len(lengths)), lengths)
        self.ends = np.cumsum(lengths)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
        key = self.term * IMPACTS + (IMPACTS - 1 - self.impact)
        order = np.argsort(key, kind="stable")
        self.keys, self.docs = key[order], doc[order]
        # where each document stands among equal scores
        self.place = np.empty(len(self.ids), np.int64)
        self.place[sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] if self.ids[i] is not None else 0))] = np.arange(len(self.ids))

    def best(self, terms: np.ndarray, factors: np.ndarray, k: int, least: int, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of the k best scores and the scores; those below ``least`` may be left out. ``whole`` holds 0 for every term."""
        keys, n = self.keys, len(self.keys)
        at, ends = np.searchsorted(keys, terms * IMPACTS), np.searchsorted(keys, (terms + 1) * IMPACTS)
        acc = np.zeros(len(self.ids), np.int64)
        while True:
            open_ = at < ends
            gains = np.where(open_, factors * (IMPACTS - 1 - (keys[np.minimum(at, n - 1)] & (IMPACTS - 1))), 0)
            bound = int(gains.sum())
            if not bound or bound < least:
                break  # all is taken, or no document unseen can reach the k-th best
            top = max(1, int(gains.max()) // 2)
            # all impact groups that add ``top`` or more
            lowest = -(-top // factors)
            upto = np.searchsorted(keys, terms * IMPACTS + np.clip(IMPACTS - 1 - lowest, -1, IMPACTS - 1), side="right")
            upto = np.clip(upto, at, ends)
            take = _ranges(at, upto)
            add = np.repeat(factors, upto - at) * (IMPACTS - 1 - (keys[take] & (IMPACTS - 1)))
            np.add.at(acc, self.docs[take], add)
            at = upto
            if len(acc) >= k:
                least = max(least, int(np.partition(acc, len(acc) - k)[len(acc) - k]))
        found = np.flatnonzero(acc + bound >= max(least, 1))
        score = acc[found]
        if bound and len(found):
            # complete what the bound leaves from the documents' own lists
            whole[terms] = factors
            begin = np.r_[0, self.ends[:-1]][found]
            own = _ranges(begin, self.ends[found])
            score = np.zeros(len(found), np.int64)
            np.add.at(score, np.repeat(np.arange(len(found)), self.ends[found] - begin), whole[self.term[own]] * self.impact[own])
            whole[terms] = 0
        order = np.lexsort((self.place[found], -score))[:k]
        order = order[score[order] > 0]
        return found[order], score[order]


def _shards(batches, total: int, size: int) -> Iterator[Shard]:
    parts, n, rows = [], 0, 0
    for b in batches:
        if b.num_rows:
            parts.append(b)
            n, rows = n + len(b.column("terms").flatten()), rows + b.num_rows
        if n >= SHARD_POSTINGS or rows >= SHARD_DOCS:
            yield Shard(parts, total, size)
            parts, n, rows = [], 0, 0
    if parts:
        yield Shard(parts, total, size)


def _ranked(made: DataFrame, sent, weighed, k: int) -> DataFrame:
    """(item, doc_id, score): the best k of every item in every task."""
    def run(batches):
        items, (weight, total, size) = sent.value, weighed.value
        best: list[list] = [[] for _ in items.ids]
        asked = [(t[weight[t] > 0], (weight[t] * x)[weight[t] > 0]) for t, x in zip(items.terms, items.times)]
        whole = np.zeros(len(weight), np.int64)
        key = lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0)
        kind = pa.null()
        for shard in _shards(batches, total, size):
            kind = shard.kind
            for held, (terms, factors) in zip(best, asked):
                if not len(terms) or not len(shard.keys):
                    continue
                docs, scores = shard.best(terms, factors, k, held[-1][0] if len(held) == k else 0, whole)
                if len(docs):
                    held += zip(scores.tolist(), (shard.ids[d] for d in docs.tolist()))
                    held.sort(key=key)
                    del held[k:]
        rows = [(i, d, s) for i, held in enumerate(best) for s, d in held]
        if rows:
            yield batch(item=([r[0] for r in rows], pa.int32()), doc_id=([r[1] for r in rows], kind), score=([r[2] for r in rows], pa.int64()))

    return made.mapInArrow(run, f"item int, {ddl(made.select('doc_id'))}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, chunk: int = CHUNK) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item, with a score above 0."""
    spark = docs.sparkSession
    out = None
    item_id = items.schema["item_id"]
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for asked in chunks(items, chunk):
        sent = spark.sparkContext.broadcast(asked)
        made = postings(docs, sent)
        weighed = spark.sparkContext.broadcast(weights(made, len(asked.numbers)))
        found = _ranked(made, sent, weighed, k).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        # a task's rows come from one partition: parts of the tasks first, then the parts
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(asked.ids)), T.StructType([T.StructField("item", T.IntegerType()), item_id]))  # at most ``chunk`` rows
        one = materialise(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], T.StructType([item_id, T.StructField("rank", T.IntegerType()), docs.schema["doc_id"], T.StructField("score", T.LongType())]))
    return out


ORACLE = r"""
with d as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
size as (select count(*) filter (len(w) > 0) as n_docs, cast(sum(len(w)) as bigint) as n_terms from d),
tf as (select r, t, count(*) as tf from (select r, unnest(w) as t from d) group by all),
df as (select t, count(*) as df from tf group by t),
weight as (select t, cast(floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1))) as bigint) as w from df, size),
length as (select r, doc_id, 25 + (75 * len(w) * n_docs) // n_terms as m from d, size where len(w) > 0),
items as (
  select row_number() over () as q, item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from (select distinct item_id, text from benchmark)),
asked as (select q, t, count(*) as times from (select q, unnest(w) as t from items) group by all),
scores as (
  select q, r, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
  from asked join weight using (t) join tf using (t) join length using (r) group by q, r),
ranked as (
  select q, doc_id, score, row_number() over (partition by q order by score desc, doc_id) as rank
  from scores join length using (r) where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked join items using (q) where rank <= 10
"""
