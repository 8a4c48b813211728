"""Quality rules as weak supervision, in DataFrame operations only.

``base_counts`` gives exact per-document counts. Each labelling rule votes good (1), bad (-1) or abstains (0). Votes are
counted by pattern, at most 3 ** rules rows however many documents there are. Expectation maximisation over that table
fits a latent class model: one class of good texts and one for each family of junk (``FAMILIES``), each with its own
probabilities of every rule's votes, which are the rules' accuracies. Kinds of junk rarely meet in one text, so with a single class
of bad texts the largest kind would take it and the rest would pass for habits of good texts. A document's posterior is
that of the good class. ``kept`` is false where a hard base rule fails, else posterior >= 0.5: what one rule holds against
a text may be outvoted.

The texts are read once: the counts, a few numbers a document, are written, and both the patterns and the result come from them.

Defined cases: null text has no words (all counts 0, base_failed); an empty table gives no rows and the
initial parameters; repeated rows are each judged; other columns are passed over.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise

#: White space between words.
_SPACE = r"[\x20\x09-\x0D]+"

GOOD, ABSTAIN, BAD = 1, 0, -1


def _blank_count(c: Column) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, _SPACE, ""))


def base_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_letters, n_upper, n_ends, n_distinct)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    staged = docs.select("doc_id", text.alias("t"), words.alias("w"), lines.alias("l"))
    staged = staged.withColumn("h", F.transform("w", lambda w: F.xxhash64(w))).withColumn("n", F.size("w"))
    # the hash of each five-word window; windows are compared by 64-bit hashes of 64-bit word hashes
    at = lambda i, k: F.get(F.col("h"), i + k)
    windows = F.when(F.col("n") >= 5, F.transform(F.sequence(F.lit(0), F.col("n") - 5), lambda i: F.xxhash64(*(at(i, k) for k in range(5))))).otherwise(F.array().cast("array<bigint>"))
    staged = staged.withColumn("win", windows)
    # only texts with a repeated window need the sort below
    ordered = F.array_sort(F.transform("win", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    staged = staged.withColumn("o", F.when(F.size(F.array_distinct("win")) < F.size("win"), ordered))
    same = lambda a, b: F.coalesce(F.get(F.col("o"), a)["x"] == F.get(F.col("o"), b)["x"], F.lit(False))
    twice = F.filter(F.transform("o", lambda e, j: F.when(same(j, j + 1) | ((j > 0) & same(j, F.greatest(j - 1, F.lit(0)))), e["i"])), lambda i: i.isNotNull())
    staged = staged.withColumn("p", F.array_sort(twice))
    covered = F.aggregate(
        F.transform("p", lambda i, j: F.least(F.lit(5), F.coalesce(F.get(F.col("p"), j + 1) - i, F.lit(5)))), F.lit(0), lambda s, x: s + x
    )
    without = lambda pattern: F.length("t") - F.length(F.regexp_replace(F.col("t"), pattern, ""))
    return staged.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", _SPACE, "")).cast("long").alias("word_chars"),
        without(r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("l").cast("long").alias("n_lines"),
        without(r"\p{L}+").cast("long").alias("n_letters"),
        without(r"\p{Lu}+").cast("long").alias("n_upper"),
        without(r"[.!?]+").cast("long").alias("n_ends"),
        F.size(F.array_distinct("h")).cast("long").alias("n_distinct"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def votes() -> dict[str, Column]:
    """Rule name -> vote from the base counts; between a rule's two thresholds it abstains."""
    n, chars = F.col("n_words"), F.col("word_chars")
    share = lambda a, b: a / F.greatest(b, F.lit(1))

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)

    symbols, letters, caps = share(F.col("n_symbols"), chars), share(F.col("n_letters"), chars), share(F.col("n_upper"), F.col("n_letters"))
    ends, repeats, lines, mean = share(F.col("n_ends"), n), share(F.col("n_repeat_words"), n), share(F.col("n_dup_lines"), F.col("n_lines")), share(chars, n)
    variety = F.col("n_distinct") / F.greatest(F.pow(n, F.lit(0.85)), F.lit(1.0))
    return {
        "length": vote(n < 10, n >= 50),
        "symbols": vote(symbols > 0.03, symbols < 0.002),
        "letters": vote(letters < 0.88, letters > 0.94),
        "word_length": vote((mean < 3.5) | (mean > 7), (mean >= 4) & (mean <= 6.3)),
        "capitals": vote(caps > 0.3, caps < 0.06),
        "endings": vote(ends > 0.5, ends < 0.25),
        "repeats": vote(repeats > 0.2, repeats <= 0.02),
        "dup_lines": vote(lines > 0.3, lines <= 0.05),
        "variety": vote((variety < 0.6) & (n >= 20), variety >= 1.2),
    }


#: Families of junk and the rules that see them first.
FAMILIES = {
    "repetition": ("repeats", "dup_lines", "variety"),
    "markup": ("symbols", "letters", "word_length"),
    "shouting": ("capitals", "endings", "letters"),
}
#: Where estimation begins: P(bad), P(abstain), P(good) of a rule in good texts, in junk of another family and in its own.
IN_GOOD, ELSEWHERE, AT_HOME = (0.02, 0.28, 0.7), (0.1, 0.4, 0.5), (0.7, 0.2, 0.1)


def estimate(
    patterns: list[tuple[tuple[int, ...], int]], rules: list[str], families: dict[str, tuple[str, ...]] | None = None, rounds: int = 200, prior: float = 0.85, smooth: float = 1.0
) -> tuple[list[float], list[list[list[float]]]]:
    """EM over (votes, count) patterns -> class weights (good first) and P(vote | class) as tables[class][rule][vote + 1].

    Only the start says which rules see which family; every probability is then estimated, with ``smooth`` texts added
    to each vote of each rule. Stops when no weight moves by more than 1e-9.
    """
    families = FAMILIES if families is None else families
    tables = [[list(IN_GOOD) for _ in rules]] + [[list(AT_HOME if r in home else ELSEWHERE) for r in rules] for home in families.values()]
    weights = [prior] + [(1 - prior) / len(families)] * len(families)
    total = sum(c for _, c in patterns)
    for _ in range(rounds if total else 0):
        sums = [[[smooth] * 3 for _ in rules] for _ in tables]
        mass = [1.0] * len(tables)
        for pattern, count in patterns:
            for k, p in enumerate(posterior(pattern, weights, tables)):
                mass[k] += p * count
                for j, v in enumerate(pattern):
                    sums[k][j][v + 1] += p * count
        tables = [[[x / sum(row) for x in row] for row in of] for of in sums]
        before, weights = weights, [m / (total + len(tables)) for m in mass]
        if max(abs(a - b) for a, b in zip(before, weights)) < 1e-9:
            break
    return weights, tables


def posterior(pattern: tuple[int, ...], weights: list[float], tables: list[list[list[float]]]) -> list[float]:
    """Probability of each class given the votes."""
    logs = [math.log(w) + sum(math.log(t[v + 1]) for t, v in zip(of, pattern)) for w, of in zip(weights, tables)]
    top = max(logs)
    parts = [math.exp(x - top) for x in logs]
    return [p / sum(parts) for p in parts]


def judge(docs: DataFrame) -> DataFrame:
    """Base counts, base_failed, posterior and kept of every row."""
    counts = materialise(base_counts(docs))
    rules = votes()
    names = list(rules)
    patterns = counts.select(*(rules[k].alias(k) for k in names)).groupBy(*names).count().collect()  # at most 3 ** 9 rows
    weights, tables = estimate(sorted((tuple(r[k] for k in names), r["count"]) for r in patterns), names)

    def log_odds(k: int) -> Column:
        """Log of the odds of class k against good."""
        odds = F.lit(math.log(weights[k] / weights[0]))
        for j, name in enumerate(names):
            bad, none, good = (math.log(a / b) for a, b in zip(tables[k][j], tables[0][j]))
            odds = odds + F.when(F.col(f"v_{name}") == BAD, bad).when(F.col(f"v_{name}") == GOOD, good).otherwise(none)
        return odds

    against = sum((F.exp(log_odds(k)) for k in range(1, len(weights))), F.lit(0.0))
    judged = counts.withColumns({f"v_{k}": v for k, v in rules.items()}).withColumns({"base_failed": base_failed(), "posterior": 1 / (1 + against)})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5)).drop(*(f"v_{k}" for k in names))
