"""Mixing sources to target weights, in DataFrame operations only.

The words of a source's documents, in a pseudorandom document order, are one stream cut into blocks of
``block_words``. The mix has as many slots as the targets are blocks, in output shards of ``shard_blocks`` slots. Every slot of the first
half draws its source by the targets' shares: a shard's counts are multinomial. The shards of the second half draw by what each source still
lacks: whole parts of the expectation, and a multinomial draw of the rest, so that totals end within about a slot of the targets whatever came before. The
counts by (shard, source) are written (``counts_of``), and a shard's slots of a source are the next so many numbers of that source.
Slot i of a source takes block perm(i mod blocks), perm being a keyed pseudorandom permutation of the source's block numbers, so that every block
comes before any comes again. Slots and blocks are joined by (source, block): ``mixed`` has one row for every part of a
document in a slot, ``texts`` cuts out the words, and ``mix`` sums what each document gave. A source never has more than ``cap`` slots a block.

Sources sorted by code point (null last) weigh 1, 2, 3, repeating, unless weights are given; a target stops
at ``cap`` times its source's size and the excess is reshared by weight, which is the level where the sum
of min(cap * size, weight * level) reaches the total.

Document offsets come from sums over (source, bucket of documents) and a running sum inside a bucket. There are as many
buckets as the square root of the number of rows, so that neither a bucket's rows nor a source's buckets become many, and a source
with a third of all rows is spread over all of them. One row a source is
gathered to rank and fill targets: that table has as many rows as there are sources.

Defined cases: null or empty texts have size 0 and are never taken; a source of no words has target 0; an
empty table gives no rows; repeated rows each hold a place of their own in the stream; other columns are
passed over. Reruns agree: every draw is a hash.
"""

from __future__ import annotations

from functools import reduce
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise

BLOCK_WORDS = 64
SHARD_BLOCKS = 65_536
#: Slots that one row is exploded to.
CHUNK = 65_536
#: Cells of [0, 1) by which draws meet the sources' shares.
GRID = 1024
#: Rows of shares that are broadcast; more are joined by shuffle.
MOST_SENT = 100_000
SEED = 20_240_101


def n_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def _unit(*parts) -> Column:
    """A uniform number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0**-53)


def target_table(sizes: DataFrame, cap: float = 3.0) -> DataFrame:
    """(no_source, source) sizes -> with weight and target. One row a source; ranked in one partition."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy("no_source", "source")))
    ranked = ranked.withColumn("weight", ((F.col("rank") - 1) % 3 + 1).cast("double")).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by_level = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    ranked = ranked.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    ranked = ranked.withColumn("level", F.max(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("level"))).over(everything))
    target = F.least(F.col("most"), F.col("weight") * F.coalesce(F.col("level"), F.lit(float("inf"))))
    return ranked.select("no_source", "source", "source_size", "weight", target.alias("target"))


def _shares(rows: DataFrame, share: str) -> DataFrame:
    """(cell, no_source, source, low, high): the part of [0, 1) that falls to each source by its share, a row for each of ``GRID`` cells it touches."""
    order = Window.orderBy("no_source", "source")
    own = rows.where(F.col(share) > 0).select("no_source", "source", F.sum(share).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto"))
    total = F.max("upto").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    own = own.select("no_source", "source", (F.coalesce(F.lag("upto").over(order), F.lit(0.0)) / total).alias("low"), (F.col("upto") / total).alias("high"))
    first, last = F.floor(F.col("low") * GRID), F.least(F.floor(F.col("high") * GRID), F.lit(GRID - 1))
    return own.select(F.explode(F.sequence(first, last)).alias("cell"), "no_source", "source", "low", "high")


def _picked(slots: DataFrame, shares: DataFrame, seed: int) -> DataFrame:
    """(shard, no_source, source, slots): slots (shard, j) that each draw a source, counted."""
    at = slots.select("shard", _unit("shard", "j", F.lit(seed)).alias("at")).withColumn("cell", F.floor(F.col("at") * GRID))
    # the planner takes exploded slots for as few as the rows they come from: the shares are sent if they are few, else both sides are shuffled
    shares = shares.hint("broadcast" if shares.count() <= MOST_SENT else "merge")
    found = at.join(shares, "cell").where((F.col("low") <= F.col("at")) & (F.col("at") < F.col("high")))
    return found.groupBy("shard", "no_source", "source").agg(F.count("*").alias("slots"))


def _numbered(first: int, shards: int, total: int, each: int, spark) -> DataFrame:
    """(shard, j): slots 0.. of each shard from ``first`` on, ``each`` of them but for the last, ``total`` in all."""
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(0, shards, 1, wide).select(F.col("id"), F.least(F.lit(each).cast("long"), F.lit(total) - F.col("id") * each).alias("n"))
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK).cast("long")))).repartition(wide, "id", "chunk")
    j = F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("n"), (F.col("chunk") + 1) * CHUNK) - 1))
    return rows.select((F.col("id") + first).alias("shard"), j.alias("j"))


def counts_of(sources: DataFrame, shard_blocks: int = SHARD_BLOCKS, draw_seed: int = SEED + 2) -> DataFrame:
    """(no_source, source, shard, slots, first): how many slots of a source each shard draws, and the first of their numbers. Written once.

    ``sources`` has ``blocks`` and ``want`` (slots wanted) and may have ``most_slots``, which a source's slots never pass.
    """
    spark = sources.sparkSession
    s = sources.where("want > 0").select("no_source", "source", "want")
    total = round(s.agg(F.sum("want")).first()[0] or 0)
    free = total - total // 2
    shards, rest = -(-free // shard_blocks), total - free
    drawn = materialise(_picked(_numbered(0, shards, free, shard_blocks, spark), _shares(s, "want"), draw_seed))
    parts = [drawn]
    if rest:
        have = drawn.groupBy("no_source", "source").agg(F.sum("slots").alias("have"))
        lacks = s.join(have, ["no_source", "source"], "left").withColumn("lack", F.greatest(F.lit(0.0), F.col("want") - F.coalesce("have", F.lit(0))))
        lacks = materialise(lacks)
        scale = rest / (lacks.agg(F.sum("lack")).first()[0] or 1.0)
        lacks = lacks.withColumn("whole", F.floor(F.col("lack") * scale).cast("long")).withColumn("part", F.col("lack") * scale - F.col("whole"))
        left = rest - (lacks.agg(F.sum("whole")).first()[0] or 0)
        more = -(-rest // shard_blocks)
        extra = _picked(spark.range(left).select(F.lit(-1).cast("long").alias("shard"), F.col("id").alias("j")), _shares(lacks, "part"), draw_seed).drop("shard")
        late = lacks.select("no_source", "source", F.col("whole").alias("slots")).unionByName(extra).groupBy("no_source", "source").agg(F.sum("slots").alias("slots")).where("slots > 0")
        # every slot of the second half falls to one of the last shards
        late = late.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / CHUNK).cast("long"))))
        late = late.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "no_source", "source", "chunk")
        late = late.select("no_source", "source", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("slots"), (F.col("chunk") + 1) * CHUNK) - 1)).alias("j"))
        shard = F.floor(_unit("no_source", "source", "j", F.lit(draw_seed)) * more).cast("long") + shards
        parts.append(late.groupBy(shard.alias("shard"), "no_source", "source").agg(F.count("*").alias("slots")).select("shard", "no_source", "source", "slots"))
    before = Window.partitionBy("no_source", "source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = reduce(DataFrame.unionByName, parts).withColumn("first", F.coalesce(F.sum("slots").over(before), F.lit(0).cast("long")))
    if "most_slots" in sources.columns:
        counts = counts.join(sources.select("no_source", "source", "most_slots"), ["no_source", "source"]).withColumn("slots", F.least("slots", F.col("most_slots") - F.col("first"))).where("slots > 0")
    return materialise(counts.select("no_source", "source", "shard", "slots", "first"))


def permuted(i: Column, blocks: Column, no_source: Column, source: Column, seed: int = SEED, rounds: int = 16) -> Column:
    """Place of i under a keyed pseudorandom permutation of 0..blocks-1 (a swap-or-not shuffle).

    A round pairs x with key - x modulo the count and swaps the two or not by a hash bit of the pair, so
    every round is a permutation for any count, with no table.
    """

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(no_source, source, r, F.lit(seed)), blocks) - x, blocks)
        bit = F.xxhash64(F.greatest(x, other), r, no_source, source, F.lit(seed + 1)).bitwiseAND(F.lit(1).cast("long"))
        return F.when(bit == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.pmod(i, blocks).cast("long"), swap)


def blocks_of(docs: DataFrame, block_words: int = BLOCK_WORDS, buckets: int | None = None, cap: float = 3.0, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Documents with their place in their source's stream, and the sources with sizes, targets and block counts; the texts are read once."""
    sized = docs.select("doc_id", F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source"), n_words(F.col("text")).alias("size"))
    sized = materialise(sized)
    buckets = buckets or 1 + isqrt(sized.count())
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(buckets)))
    sums = sized.groupBy("no_source", "source", "bucket").agg(F.sum("size").alias("bucket_size"))
    of_source = Window.partitionBy("no_source", "source")
    sums = sums.withColumn("base", F.coalesce(F.sum("bucket_size").over(of_source.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    sizes = sums.groupBy("no_source", "source").agg(F.sum("bucket_size").alias("source_size"))
    sources = target_table(sizes, cap)
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    sources = sources.withColumn("blocks", blocks).withColumn("most_slots", F.floor(blocks * float(cap)).cast("long")).withColumn("want", F.when(F.col("blocks") > 0, F.col("target") / F.col("source_size") * F.col("blocks")).otherwise(0.0))
    placed = sized.join(sums.drop("bucket_size"), ["no_source", "source", "bucket"])
    inside = Window.partitionBy("no_source", "source", "bucket").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "size")
    placed = placed.withColumn("off", F.col("base") + F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    return materialise(placed.drop("base", "bucket")), materialise(sources)


def slots_of(sources: DataFrame, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED, draw_seed: int | None = None) -> DataFrame:
    """The mix as (shard, no_source, source, slot, block): the slots that the written counts give each shard, and the blocks they take."""
    counts = counts_of(sources, shard_blocks, seed + 2 if draw_seed is None else draw_seed)
    # few short rows become very many: a fixed number of partitions, which isn't merged by their size before
    counts = counts.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / CHUNK).cast("long"))))
    counts = counts.join(sources.select("no_source", "source", "blocks"), ["no_source", "source"])
    counts = counts.repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "no_source", "source", "shard", "chunk")
    last = F.col("first") + F.least(F.col("slots"), (F.col("chunk") + 1) * CHUNK) - 1
    slots = counts.select("shard", "no_source", "source", "blocks", F.explode(F.sequence(F.col("first") + F.col("chunk") * CHUNK, last)).alias("slot"))
    place = permuted(F.col("slot"), F.col("blocks"), F.col("no_source"), F.col("source"), seed)
    return slots.select("shard", "no_source", "source", "slot", place.alias("block"))


def pieces_of(placed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The part of each document in each block of its source: (no_source, source, block, off, doc_id, size, from, words)."""
    last = F.floor((F.col("off") + F.col("size") - 1) / block_words).cast("long")
    full = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("off") / block_words).cast("long"), last)))
    begin = F.greatest(F.col("off"), F.col("block") * block_words)
    words = F.least(F.col("off") + F.col("size"), (F.col("block") + 1) * block_words) - begin
    return full.withColumns({"from": begin - F.col("off"), "words": words})


def mixed(placed: DataFrame, sources: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED, draw_seed: int | None = None) -> DataFrame:
    """The mixed corpus by reference: (shard, no_source, source, slot, block, off, doc_id, size, from, words), a row for each part of a document in a slot.

    A slot holds the parts of its block in order of ``off``: ``words`` words of the document from word ``from`` on. A block is in at most ``cap`` slots.
    """
    # the planner takes exploded rows for as few as the table they come from: no broadcast here
    return slots_of(sources, shard_blocks, seed, draw_seed).join(pieces_of(placed, block_words).hint("merge"), ["no_source", "source", "block"])


def texts(docs: DataFrame, **options: object) -> DataFrame:
    """The mixed corpus itself: (shard, no_source, source, slot, text), a block of words joined by blanks in each row.

    Documents are found again by (doc_id, source, size); of rows alike in these, any may give the words.
    """
    block = {k: v for k, v in options.items() if k in {"block_words", "seed"}}
    parts = mixed(*blocks_of(docs, **options), **block)
    source = F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    found = docs.select("doc_id", *source, n_words(F.col("text")).alias("size"), words.alias("all")).dropDuplicates(["doc_id", "no_source", "source", "size"])
    same = parts.doc_id.eqNullSafe(found.doc_id) & (parts.no_source == found.no_source) & (parts.source == found.source) & (parts["size"] == found["size"])
    cut = F.array_join(F.slice("all", F.col("from").cast("int") + 1, F.col("words").cast("int")), " ")
    cut = parts.join(found, same).select("shard", parts.no_source, parts.source, "slot", F.struct("off", cut.alias("t")).alias("part"))
    # at most ``block_words`` parts a slot
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["t"]), " ")
    return cut.groupBy("shard", "no_source", "source", "slot").agg(joined.alias("text"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, buckets: int | None = None, cap: float = 3.0, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED, draw_seed: int | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row: what the mixed corpus has of it."""
    placed, sources = blocks_of(docs, block_words, buckets, cap, seed)
    # an offset is one row's own: only rows of size 0 share theirs
    own = ["no_source", "source", "off", "doc_id", "size"]
    taken = mixed(placed, sources, block_words, shard_blocks, seed, draw_seed).groupBy(*own).agg(F.sum("words").alias("taken"))
    none = placed.select(*own, F.lit(0).cast("long").alias("taken"))
    by_row = taken.unionByName(none.where("size > 0")).groupBy(*own).agg(F.max("taken").alias("taken")).unionByName(none.where("size = 0"))
    # one row a source: broadcast by the optimiser when it is small, else joined by shuffle
    out = by_row.join(sources.select("no_source", "source", "source_size", "target"), ["no_source", "source"])
    return out.select("doc_id", F.when(~F.col("no_source"), F.col("source")).alias("source"), "size", "source_size", "target", "taken")
