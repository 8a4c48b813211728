"""LM scoring: stupid backoff over word pairs, computed relationally.

A pair (b, c) that some other document has scores n(b c) / n(b), where the pair's count leaves the scored document's
own occurrences out; any other scores ``ALPHA`` * n(c) / N. The counts of single words, n(b), n(c) and N, are those of
the whole corpus, the scored document included: the own document is left out exactly where it would decide whether the
model backs off. A document's score is the mean natural log over its pairs. Counts cover every document of the input.

The relational plan: texts become rows of word hashes once (``tokens``). Words and pairs are counted by aggregations
whose map side has summed each batch, so a very frequent pair reaches the count table as one row a task. The count
table keeps pairs counted at least twice; no other can be seen elsewhere. Documents are exploded to distinct pairs with
their count in the document, joined to the count table by the hash of the pair (a shuffle join of its own that hashes the
table's part, where each key stands once; hot keys of the documents' side AQE splits), and what each pair adds is summed
by document. Pairs are taken in ``slices`` of their keys, one after another, each with its own rows of the table only;
what a slice shuffles is gone before the next, which bounds the disk.

The most frequent words, at most ``vocabulary`` of them (16 bytes each, 8 MB), travel to every task and are numbered, so
a pair of two of them is an exact key of one number, from which its words' counts are found again. Pairs with a rarer word
(``rare``) carry both words' hashes and find their counts by two more joins with the whole table of words: same scores, longer rows.

Defined cases: a text of fewer than two words has no pair and score null; a null text has no words; repeated rows
are documents of their own, each part of the other's corpus; a null doc_id passes through, and ids may have any type;
an empty table gives no rows; other columns are passed over, whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import K1, K3, batch, blank_words, ddl, discard, map_batches, materialise, mix, settings, word_hashes

ALPHA = 0.4
VOCABULARY = 500_000
SLICES = 2
#: Texts of an Arrow batch; pairs that a task holds before it counts them.
BATCH, HELD = 1000, 3_000_000
#: Bits of a word's number in the key of a pair.
WORD_BITS = 31


def tokens(docs: DataFrame) -> DataFrame:
    """(row, doc_id, words) of every row: word hashes in order, written once."""

    def start():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            every = [word_hashes(blank_words(t)) for t in b.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, every)], dtype=np.int32)
            flat = np.concatenate(every).view(np.int64) if every else np.zeros(0, np.int64)
            return batch(row=b.column("row"), doc_id=b.column("doc_id"), words=pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))

        return run

    narrow = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    with settings(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=BATCH):
        # words repeat: a wide dictionary page keeps them at two or three bytes each
        return materialise(map_batches(narrow, f"{ddl(narrow.select('row', 'doc_id'))}, words array<long>", start), parquet__dictionary__page__size=16 << 20)


def _words(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch and, for each, the number of its text in the batch."""
    col = b.column("words")
    flat = col.flatten().to_numpy(zero_copy_only=False).view(np.uint64) if b.num_rows else np.zeros(0, np.uint64)
    return flat, np.repeat(np.arange(b.num_rows, dtype=np.uint16 if b.num_rows < 65_536 else np.int64), col.value_lengths().to_numpy(zero_copy_only=False))


def _counted(of, name: str):
    """A task's batches -> (name, c): how often each key that ``of`` finds in a batch occurs, summed over HELD of them."""

    def run(batches):
        held, n = [], 0

        def flush():
            k, c = np.unique(np.concatenate(held), return_counts=True)
            return batch(**{name: (k.view(np.int64), pa.int64())}, c=(c.astype(np.int64), pa.int64()))

        for b in batches:
            held.append(of(b))
            n += len(held[-1])
            if n >= HELD:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return run


def word_counts(made: DataFrame) -> DataFrame:
    """(w, c): count of every word of the corpus by its 64-bit hash."""
    return made.select("words").mapInArrow(_counted(lambda b: _words(b)[0], "w"), "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of all words at or above the least power of two that at most ``most`` words reach."""
    by_size = dict(tuple(r) for r in counts.groupBy(F.floor(F.log2("c")).cast("int").alias("e")).count().collect())  # at most 64 rows
    n, least = 0, 64
    for e in sorted(by_size, reverse=True):
        if n + by_size[e] > most:
            break
        n, least = n + by_size[e], e
    table = counts.where(F.col("c") >= F.lit(float(2**least))).toArrow()
    w, c = (table.column(k).to_numpy() for k in ("w", "c"))
    w = w.view(np.uint64) if len(w) else np.zeros(0, np.uint64)
    order = np.argsort(w)
    return w[order], np.asarray(c, np.int64)[order]


def _places(known: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Where each of w stands among the sorted hashes known; any place if it isn't there.

    Hashes are spread evenly, so the top bits lead to a bucket of few: less time than a binary search of all of them for each word.
    """
    shift = np.uint64(64 - max(1, len(known).bit_length()))
    bucket = (known >> shift).astype(np.int64)
    begin = np.r_[0, np.cumsum(np.bincount(bucket, minlength=1 << (64 - int(shift))))]
    at = begin[(w >> shift).astype(np.int64)]
    most = int(np.diff(begin).max(initial=1))
    at = np.minimum(at, len(known) - 1)
    left = np.flatnonzero(known[at] < w)
    for _ in range(most - 1):
        if not len(left):
            break
        at[left] = np.minimum(at[left] + 1, len(known) - 1)
        left = left[known[at[left]] < w[left]]
    return at


def _pairs(b: pa.RecordBatch, known: np.ndarray):
    """Every pair of a batch: place of its first word, key, whether a word is rare; and the words, and the text of each."""
    w, doc = _words(b)
    first = np.flatnonzero(doc[1:] == doc[:-1])
    if len(known):
        at = _places(known, w)
        rare = known[at] != w
    else:
        at, rare = np.zeros(len(w), np.int64), np.ones(len(w), bool)
    odd = rare[first] | rare[first + 1]
    exact = at[first].astype(np.int64) << WORD_BITS | at[first + 1]
    hashed = ~(mix(w[first] * K1 + w[first + 1] * K3) >> np.uint64(1)).view(np.int64)  # below 0
    return first, np.where(odd, hashed, exact), odd, w, doc


def pair_counts(made: DataFrame, sent) -> DataFrame:
    """(key, c) of the pairs that occur twice or more in the corpus."""
    keys = made.select("words").mapInArrow(_counted(lambda b: _pairs(b, sent.value)[1], "key"), "key long, c long")
    # a task's keys are distinct already: they are shuffled as they are, not aggregated before it once more
    return keys.repartition("key").groupBy("key").agg(F.sum("c").alias("c")).where("c > 1")


def counted(table: DataFrame, rare: bool, part: int = 0, parts: int = 1) -> DataFrame:
    """The rows of the count table that ``exploded`` with the same arguments can meet."""
    if rare:
        return table.where("key < 0")
    mine = F.pmod(F.col("key").bitwiseXOR(F.shiftright("key", WORD_BITS)), F.lit(parts)) == part
    return table.where((F.col("key") >= 0) & mine if parts > 1 else F.col("key") >= 0)


def exploded(made: DataFrame, sent, rare: bool, part: int = 0, parts: int = 1) -> DataFrame:
    """(key, row, times), and for rare pairs the hashes b and c: distinct pairs of each row with their count in it."""

    def start():
        known = sent.value

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            first, key, odd, w, doc = _pairs(b, known)
            take = odd == rare
            if parts > 1:
                take &= (key ^ (key >> WORD_BITS)) % parts == part
            first, key, whose = first[take], key[take], doc[first[take]]
            if not rare and b.num_rows * max(len(known), 1) ** 2 < 1 << 62:
                # text and pair as one number, which needs no order of places
                n = max(len(known), 1)
                one = (whose.astype(np.int64) * n + (key >> WORD_BITS)) * n + (key & ((1 << WORD_BITS) - 1))
                one, times = np.unique(one, return_counts=True)
                pair = one % (n * n)
                return batch(key=((pair // n) << WORD_BITS | pair % n, pa.int64()), row=b.column("row").take(pa.array(one // (n * n))), times=(times.astype(np.int64), pa.int64()))
            order = np.argsort(key, kind="stable")
            order = order[np.argsort(whose[order], kind="stable")]
            key, whose, first = key[order], whose[order], first[order]
            new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (whose[1:] != whose[:-1])]) if len(key) else np.zeros(0, int)
            times = np.diff(np.r_[new, len(key)])
            words = {"b": (w[first[new]].view(np.int64), pa.int64()), "c": (w[first[new] + 1].view(np.int64), pa.int64())} if rare else {}
            return batch(key=(key[new], pa.int64()), row=b.column("row").take(pa.array(whose[new])), times=(times, pa.int64()), **words)

        return run

    return map_batches(made.select("row", "words"), f"key long, row long, times long{', b long, c long' if rare else ''}", start)


def _summed(found: DataFrame, total: int) -> DataFrame:
    """(row, n_pairs, n_seen, added) from pairs with count n of the pair, nb and nc of its words."""
    other = F.coalesce("n", F.lit(0)) - F.col("times")
    seen = F.log(other) - F.log("nb")
    unseen = F.log("nc") + float(np.log(ALPHA)) - float(np.log(max(total, 1)))
    added = F.sum(F.when(other > 0, seen).otherwise(unseen) * F.col("times")).alias("added")
    return found.groupBy("row").agg(F.sum("times").alias("n_pairs"), F.sum(F.when(other > 0, F.col("times")).otherwise(0)).alias("n_seen"), added)


def score(docs: DataFrame, vocabulary: int = VOCABULARY, slices: int = SLICES) -> DataFrame:
    """(doc_id, n_pairs, n_seen, score) of every row; score is the mean log of stupid-backoff scores."""
    spark = docs.sparkSession
    made = tokens(docs)
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=BATCH):
        counts = materialise(word_counts(made))
        total = int(counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
        known, times = frequent(counts, vocabulary)
        sent = spark.sparkContext.broadcast(known)
        numbered = pa.table({"id": pa.array(np.arange(len(known)), pa.int64()), "nw": pa.array(times, pa.int64())})
        numbered = materialise(spark.createDataFrame(numbered, "id long, nw long"))  # at most ``vocabulary`` rows
        table = materialise(pair_counts(made, sent)).withColumnRenamed("c", "n")

        sums = []
        for k in range(slices):
            found = exploded(made, sent, False, k, slices).join(counted(table, False, k, slices).hint("shuffle_hash"), "key", "left")
            for word, name in ((F.shiftright("key", WORD_BITS), "nb"), (F.col("key").bitwiseAND(F.lit((1 << WORD_BITS) - 1)), "nc")):
                of = numbered.select(F.col("id").alias(f"id_{name}"), F.col("nw").alias(name))
                found = found.join(F.broadcast(of), word == F.col(f"id_{name}"))
            sums.append(materialise(_summed(found, total)))
        found = exploded(made, sent, True).join(counted(table, True).hint("shuffle_hash"), "key", "left")
        found = found.join(counts.select(F.col("w").alias("b"), F.col("c").alias("nb")).hint("merge"), "b")
        found = found.join(counts.select(F.col("w").alias("c"), F.col("c").alias("nc")).hint("merge"), "c")
        sums.append(materialise(_summed(found, total)))
    discard(counts, numbered)
    by_row = reduce(DataFrame.unionByName, sums).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("n_pairs", "n_seen", "added")))
    out = made.select("row", "doc_id").join(by_row, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", zero("n_pairs"), zero("n_seen"), F.when(F.col("n_pairs") > 0, F.col("added") / F.col("n_pairs")).alias("score"))


ORACLE = r"""
with d as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
words as (select w, count(*) as n from (select unnest(w) as w from d) group by w),
own as (select r, w[i] as b, w[i + 1] as c, count(*) as times from (select r, w, unnest(range(1, len(w))) as i from d) group by all),
pairs as (select b, c, sum(times) as n from own group by all),
added as (
  select o.r, o.times, p.n > o.times as seen,
    case when p.n > o.times then ln(p.n - o.times) - ln(nb.n) else ln(nc.n) + ln(0.4) - ln((select sum(n) from words)) end as score
  from own o join pairs p using (b, c) join words nb on nb.w = o.b join words nc on nc.w = o.c),
sums as (
  select r, sum(times) as n_pairs, sum(times) filter (seen) as n_seen, sum(score * times) as added from added group by r)
select d.doc_id, cast(coalesce(n_pairs, 0) as bigint) as n_pairs, cast(coalesce(n_seen, 0) as bigint) as n_seen, round(added / n_pairs, 6) as score
from d left join sums using (r)
"""
