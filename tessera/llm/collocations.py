"""Phrase collocation mining: counts of n-grams from word-id suffix arrays, merged over shards, scored and pruned relationally.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``. A task cuts
its texts into shards of about ``SHARD`` words, numbers a shard's (lang, word) pairs and lays the numbers out in one array
with 0 between pieces. Prefix doubling sorts its suffixes by their first words; runs of suffixes whose common prefix (LCP)
has n words or more are the occurrences of one n-gram, so the run's length is its count in the shard.

A phrase that occurs ``least`` times is made of words and shorter phrases that do, so two passes suffice (one more for each length above 3):

1. words and pairs of words (then every longer length but the last, of admitted parts only) by a 64-bit key: summed over shards, keys
   with ``least`` or more are kept as the bits of a filter of bounded size (``FILTER_BITS``);
2. phrases of all lengths whose parts the filters let through, as text: summed over shards and held against ``least``.

The keys and filters may let a phrase through that is too rare, never hold a frequent one back, and only the last pass counts:
results are exact whatever collides. Filters that fill up (some 10^8 frequent phrases) spare less of that pass, no more.

Defined cases: a null or empty text has no words; a null lang is ``und``; repeated rows are texts of their own; doc_id and other
columns are not read; a table without a candidate, an empty one too, gives no rows; equal ranks can't be, the phrase decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import K1, K3, batch, materialise, mix, raw_bytes, settings

LEAST, LONGEST, SHARE, TOP = 10, 3, 50, 2000
#: Words of a shard; texts of an Arrow batch.
SHARD, BATCH = 1_000_000, 250
#: Bits of a filter (16 MB) at most.
FILTER_BITS = 1 << 27
#: Parts of a language that are ranked apart before they meet.
SALTS = 32
#: Piece ends become a full stop between blanks, which no word can be.
_PIECES = bytes(46 if chr(b) in ".,;:!?" or 10 <= b <= 13 else b for b in range(256))


def pieces(text: str | None) -> list[bytes]:
    """Words in order, with ``b"."`` at the piece ends."""
    return raw_bytes(text).lower().translate(_PIECES).replace(b".", b" . ").split()


class Numbers(dict):
    """Number of every word of a shard in one language; 0 for words that the filter holds back and for piece ends."""

    def __init__(self, shard: Shard, lang: str):
        super().__init__({b".": 0})
        # not the shard itself: in a ring with its numbers it would stay until the collector happens to come by
        self.words, self.whose, self.keys, self.lang = shard.words, shard.whose, shard.keys, lang
        self.bits = shard.filters[0] if shard.filters else None
        self.seed = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))

    def __missing__(self, word: bytes) -> int:
        key = xxhash.xxh3_64_intdigest(word, self.seed)
        at = 0
        if self.passes(key):
            at = len(self.words)
            self.words.append(word)
            self.whose.append(self.lang)
            self.keys.append(key)
        self[word] = at
        return at

    def passes(self, key: int) -> bool:
        if self.bits is None:
            return True
        p = key % (len(self.bits) * 64)
        return bool(int(self.bits[p >> 6]) >> (p & 63) & 1)


class Shard:
    """Texts of some ``SHARD`` words as one array of word numbers; n-grams from its suffix array.

    ``sequence`` ends the reading of texts: it gives back the numbers by word, which take most of a shard's memory.
    """

    def __init__(self, filters: list[np.ndarray]):
        self.filters, self.words, self.whose, self.keys, self.langs, self.parts, self.n, self.totals = filters, [b""], [""], [0], {}, [], 0, {}

    def add(self, lang: str | None, text: str | None) -> None:
        lang = "und" if lang is None else lang
        words = pieces(text)
        if not words:
            return
        numbers = self.langs.get(lang) or self.langs.setdefault(lang, Numbers(self, lang))
        self.parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
        self.parts.append(np.zeros(1, np.int32))
        self.n += len(words)
        self.totals[lang] = self.totals.get(lang, 0) + len(words) - words.count(b".")

    def sequence(self, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """The word numbers, padded with ``longest`` zeros, and how many of the next words belong to one admitted phrase.

        Filter k + 1 speaks of phrases of k + 1 words: a stretch of m words is admitted if all its stretches of that length are.
        """
        seq = np.concatenate([*self.parts, np.zeros(longest + 1, np.int32)])
        self.keys = np.array(self.keys, np.uint64)
        self.parts.clear()
        self.langs.clear()
        length = (seq > 0).astype(np.int8)
        for m in range(2, longest + 1):
            longer = np.zeros(len(seq), bool)
            longer[:-1] = (length[:-1] == m - 1) & (length[1:] >= m - 1)
            if m <= len(self.filters):
                at = np.flatnonzero(longer)
                bits = self.filters[m - 1]
                p = self.gram_keys(seq, at, m) % np.uint64(len(bits) * 64)
                longer[at] = (bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
            length[longer] = m
        return seq, length

    def gram_keys(self, seq: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
        """64-bit keys of the phrases of m words at the places given."""
        h = self.keys[seq[at]]
        for k in range(1, m):
            h = mix(h * K1 + self.keys[seq[at + k]] * K3)
        return h

    def intervals(self, shortest: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, the sequence, a place of each n-gram, its count) for n-grams of the lengths asked for."""
        seq, length = self.sequence(longest)
        at = np.flatnonzero(length >= shortest)
        if not len(at):
            return
        # prefix doubling: after each step suffixes are ranked by twice as many words
        rank, depth = seq, 1
        while depth < longest:
            pair = rank.astype(np.int64)
            pair *= int(rank.max()) + 1
            pair[:-depth] += rank[depth:]
            depth *= 2
            if depth < longest:
                order = np.argsort(pair)
                pair = pair[order]
                rank = np.empty(len(pair), np.int32)
                rank[order] = np.cumsum(np.r_[False, pair[1:] != pair[:-1]], dtype=np.int32)
                del order
            else:
                rank = pair  # the last step's pairs are sorted themselves, only where phrases start
        suffixes = at[np.argsort(rank[at])]
        del rank, at
        # words that neighbours in the array have in common, no further than either's phrase reaches
        lcp, alike = np.zeros(len(suffixes), np.int8), np.ones(len(suffixes) - 1, bool)
        reach = np.minimum(length[suffixes[1:]], length[suffixes[:-1]])
        for k in range(longest):
            alike &= (seq[suffixes[1:] + k] == seq[suffixes[:-1] + k]) & (reach > k)
            lcp[1:][alike] = k + 1
        for m in range(shortest, longest + 1):
            # suffixes too short for m words stand alone between the runs
            begin = np.flatnonzero(lcp < m)
            count = np.diff(np.r_[begin, len(suffixes)])
            whole = length[suffixes[begin]] >= m
            yield m, seq, suffixes[begin[whole]], count[whole]


def _by_shard(batches, filters: list[np.ndarray], rows) -> Iterator[pa.RecordBatch]:
    """``rows(shard)`` of one shard after another; a shard is gone before the next is begun."""
    shard = Shard(filters)
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            shard.add(lang, text)
            if shard.n >= SHARD:
                yield from rows(shard)
                shard = Shard(filters)
    if shard.n:
        yield from rows(shard)


def key_counts(docs: DataFrame, shortest: int, longest: int, filters: list) -> DataFrame:
    """(key, a): occurrences of every phrase of the lengths asked for whose shorter parts pass the filters, by 64-bit key."""

    def rows(shard):
        for m, seq, at, count in shard.intervals(shortest, longest):
            for k in range(0, len(at), 1 << 16):
                key = shard.gram_keys(seq, at[k : k + (1 << 16)], m)
                yield batch(key=(key.view(np.int64), pa.int64()), a=(count[k : k + (1 << 16)].astype(np.int64), pa.int64()))

    made = docs.select("lang", "text").mapInArrow(lambda batches: _by_shard(batches, [f.value for f in filters], rows), "key long, a long")
    return made.groupBy("key").agg(F.sum("a").alias("a"))


def _filter(counts: DataFrame, least: int):
    """The keys with ``least`` or more as bits, sent to the executors: at most ``FILTER_BITS`` of them."""
    kept = materialise(counts.where(F.col("a") >= least).select("key"))
    bits = 1 << min(FILTER_BITS.bit_length() - 1, max(16, (16 * kept.count()).bit_length()))
    # the key taken as unsigned; bits is a power of two, so its lowest bits are the remainder
    at = kept.select(F.col("key").bitwiseAND(F.lit(bits - 1)).alias("p"))
    words = at.groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v")).toArrow()
    held = np.zeros(bits // 64, np.int64)
    held[words.column("w").to_numpy()] = words.column("v").to_numpy()
    return counts.sparkSession.sparkContext.broadcast(held.view(np.uint64))


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, words, phrase, a) of all phrases of up to ``longest`` words with ``least`` occurrences or more; words 0 and phrase '' have the count of all words of lang."""
    filters: list = []

    def rows(shard):
        yield batch(lang=(list(shard.totals), pa.string()), words=([0] * len(shard.totals), pa.int32()), phrase=([""] * len(shard.totals), pa.string()), a=(list(shard.totals.values()), pa.int64()))
        for m, seq, at, count in shard.intervals(1, longest):
            for k in range(0, len(at), 1 << 14):
                here = at[k : k + (1 << 14)]
                numbers = np.stack([seq[here + j] for j in range(m)], 1).tolist()
                phrases = [b" ".join([shard.words[j] for j in gram]).decode("utf-8", "replace") for gram in numbers]
                yield batch(lang=([shard.whose[gram[0]] for gram in numbers], pa.string()), words=([m] * len(here), pa.int32()), phrase=(phrases, pa.string()), a=(count[k : k + (1 << 14)].astype(np.int64), pa.int64()))

    with settings(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=BATCH):
        # words and pairs share a scan and a filter
        first = min(2, longest - 1)
        filters += [_filter(key_counts(docs, 1, first, []), least)] * first
        for length in range(first + 1, longest):
            filters.append(_filter(key_counts(docs, length, length, list(filters)), least))
        found = docs.select("lang", "text").mapInArrow(lambda batches: _by_shard(batches, [f.value for f in filters], rows), "lang string, words int, phrase string, a long")
        merged = found.groupBy("lang", "words", "phrase").agg(F.sum("a").alias("a"))
        return materialise(merged.where((F.col("a") >= least) | (F.col("words") == 0)))


def _part(first: int, n: int):
    """n words of the phrase from the first-th on."""
    return F.array_join(F.slice(F.split("phrase", " "), first, n), " ")


def _cut(candidates: DataFrame, counts: DataFrame, m: int, k: int) -> DataFrame:
    """Candidates of m words cut after k: their score, with k, l and r."""
    of = lambda n, part, name: counts.where(F.col("words") == n).select(F.col("lang"), F.col("phrase").alias(part), F.col("a").alias(name))
    big = lambda c: F.col(c).cast("decimal(18,0)")
    cut = candidates.where(F.col("words") == m).select("lang", "phrase", "words", "a", _part(1, k).alias("first"), _part(k + 1, m - k).alias("rest"))
    # both sides of each join are shuffled for it alone, so that a very common word's rows can be split
    found = cut.join(of(k, "first", "l"), ["lang", "first"]).join(of(m - k, "rest", "r"), ["lang", "rest"])
    found = found.withColumn("square", big("a") * big("a") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("product", big("l") * big("r"))
    return found.select("lang", "phrase", "words", "a", F.lit(k).alias("k"), "l", "r", F.expr("cast(square div product as long)").alias("score"))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of 2 to ``longest`` words of every language.

    A candidate occurs ``least`` times or more. Its score is floor(1000000 a a / (l r)) at the cut that makes it least, the earliest of
    equals. Candidates go that stand inside a longer one with ``share`` hundredths of their occurrences or more.
    """
    counts = phrase_counts(docs, longest, least)
    candidates = counts.where("words >= 2")
    cuts = None
    for m in range(2, longest + 1):
        for k in range(1, m):
            cut = _cut(candidates, counts, m, k)
            cuts = cut if cuts is None else cuts.unionByName(cut)
    scored = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("best"))
    inner = None
    for m in range(3, longest + 1):
        longer = candidates.where(F.col("words") == m)
        for n in range(2, m):
            for first in range(1, m - n + 2):
                one = longer.select("lang", _part(first, n).alias("phrase"), F.col("a").alias("above"))
                inner = one if inner is None else inner.unionByName(one)
    scored = scored.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    if inner is not None:
        scored = scored.join(inner.groupBy("lang", "phrase").agg(F.max("above").alias("above")), ["lang", "phrase"], "left")
        scored = scored.where(F.col("above").isNull() | (100 * F.col("above") < share * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # each part of a language keeps its best before the parts meet
    parts = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("words = 0").select("lang", F.col("a").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
with p as (
  select coalesce(lang, 'und') as lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
totals as (select lang, cast(sum(len(w)) as bigint) as n from w group by lang),
grams as (
  select lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') as phrase
  from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from w, (select unnest([1, 2, 3]) as m) where len(w) >= m)),
f as (select lang, m, phrase, count(*) as a from grams group by all having count(*) >= 10),
words as (select *, string_split(phrase, ' ') as s from f where m >= 2),
cut as (
  select lang, m, phrase, a, k, array_to_string(s[1:k], ' ') as first, array_to_string(s[k + 1:m], ' ') as rest
  from (select *, unnest(range(1, m)) as k from words)),
scored as (
  select c.lang, c.phrase, c.m, c.a, c.k, x.a as l, y.a as r,
    cast((cast(1000000 as hugeint) * c.a * c.a) // (cast(x.a as hugeint) * y.a) as bigint) as score
  from cut c join f x on x.lang = c.lang and x.m = c.k and x.phrase = c.first join f y on y.lang = c.lang and y.m = c.m - c.k and y.phrase = c.rest),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (
  select lang, phrase, max(a) as above
  from (select lang, a, unnest([array_to_string(s[1:2], ' '), array_to_string(s[2:3], ' ')]) as phrase from words where m = 3) group by all),
kept as (select b.* from best b left join inside i on i.lang = b.lang and i.phrase = b.phrase and b.m = 2 where i.above is null or 100 * i.above < 50 * b.a)
select lang, rank, phrase, a, l, r, n, score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) join totals using (lang)
where rank <= 2000
"""
