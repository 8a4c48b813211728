"""Topic suggestion: topics near an unknown one, by cosine of their morpheme vectors over postings, then by shared words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POOL, LIMIT, FLOOR = 500, 3, 0.5


def topic_words(c: Column) -> Column:
    """Distinct lower-case words of a topic; hyphens, blanks and signs divide."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def candidates(fragments: DataFrame, pool: int = POOL) -> DataFrame:
    """(topic, n): the ``pool`` topics with the most active fragments; ties by name."""
    counted = fragments.where("valid_to_h is null and topic is not null and topic != ''").groupBy("topic").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "topic").limit(pool)


def lexical(a: Column, b: Column) -> Column:
    """1 for equal names, 0.75 if one contains the other, else the share of hyphenated parts in common (of the longer)."""
    la, lb = F.lower(a), F.lower(b)
    parts = lambda c: F.filter(F.split(c, "-"), lambda t: t != "")
    both = F.size(F.filter(parts(la), lambda t: F.array_contains(parts(lb), t)))
    most = F.greatest(F.size(parts(la)), F.size(F.array_distinct(parts(lb))))
    contained = (la != "") & (lb != "") & (F.contains(la, lb) | F.contains(lb, la))
    return F.when(la == lb, 1.0).when(contained, 0.75).when(F.least(F.size(parts(la)), F.size(parts(lb))) == 0, 0.0).otherwise(both / most)


def suggest(topics: DataFrame, asked: DataFrame, limit: int = LIMIT, floor: float = FLOOR, words=topic_words) -> DataFrame:
    """(asked, topic, n, similarity, rank): for each asked name up to ``limit`` topics (topic, n), never the name itself.

    A topic's vector has a component for each of its words, weighted by how few topics hold it (ln(1 + T / df)); the cosine is summed over postings (word, topic,
    weight), so topics without a common word are never paired for it. Topics at ``floor`` or above come first, by cosine; then those that are lexically near, by
    that score and their size. ``words`` makes the words and may be an analyser's. ``topics`` is a pool of bounded size (``candidates``); it is broadcast.
    """
    total = topics.count()
    posted = topics.select("topic", "n", F.explode(words(F.col("topic"))).alias("word"))
    df = posted.groupBy("word").agg(F.log(1 + total / F.count("*")).alias("idf"))
    weighed = posted.join(df, "word")
    norms = weighed.groupBy("topic").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    weighed = weighed.join(norms, "topic").select("word", "topic", (F.col("idf") / F.col("norm")).alias("weight"))
    names = asked.select("asked").where("trim(asked) != ''").distinct()
    # a word that no topic has still lengthens the asked vector, as the rarest word would
    mine = names.select("asked", F.explode(words(F.col("asked"))).alias("word")).join(df, "word", "left").select("asked", "word", F.coalesce("idf", F.log(F.lit(1.0 + total))).alias("idf"))
    mine = mine.withColumn("weight_a", F.col("idf") / F.sqrt(F.sum(F.col("idf") * F.col("idf")).over(Window.partitionBy("asked"))))
    cosine = mine.join(weighed, "word").groupBy("asked", "topic").agg(F.round(F.sum(F.col("weight_a") * F.col("weight")), 9).alias("cosine")).where(F.col("cosine") >= floor)
    # the pool is bounded, so are its pairs with each name
    pairs = names.join(F.broadcast(topics), F.col("asked") != F.col("topic")).join(cosine, ["asked", "topic"], "left").withColumn("lex", lexical(F.col("asked"), F.col("topic")))
    found = pairs.where("cosine is not null or lex > 0")
    order = Window.partitionBy("asked").orderBy(F.desc_nulls_last("cosine"), F.when(F.col("cosine").isNull(), F.col("lex")).desc_nulls_first(), F.desc("n"), "topic")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("asked", "topic", "n", F.col("cosine").alias("similarity"), "rank")
