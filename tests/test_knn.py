"""Block products against brute force: ties by id, links left out, counts, asked rows; whatever the blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import knn


def made(spark):
    rng = np.random.default_rng(11)
    heads = rng.normal(size=(6, 8))
    x = heads[rng.integers(0, 6, 240)] + rng.integers(0, 4, 240)[:, None] * 0.15 * rng.normal(size=(240, 8))
    x[40:70] = x[40]  # copies: ties go by id
    topics = ["t" if i % 3 else "u" for i in range(240)]
    linked = [[j for j in range(240) if j != i and (i * j) % 11 == 3] for i in range(240)]
    df = spark.createDataFrame([(t, i, v.tolist(), n) for i, (t, v, n) in enumerate(zip(topics, x, linked))] + [("t", 900, None, [])], "topic string, id long, embedding array<double>, linked array<long>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    same = np.array([[a == b for b in topics] for a in topics])
    return df, s, same, linked


@pytest.mark.parametrize("block", [None, 37, 1000])
def test_blocks_against_brute_force(spark, block):
    df, s, same, linked = made(spark)
    plain, n = df.drop("linked"), len(s)
    near = lambda i, floor: [j for j in range(n) if j != i and same[i, j] and s[i, j] >= floor]
    best = lambda i, js, k: sorted(js, key=lambda j: (-s[i, j], j))[:k]
    rows = lambda df: {(r.id, r.rank): r.neighbour for r in df.collect()}
    assert rows(knn.nearest(plain, 4, 0.6, block)) == {(i, p + 1): j for i in range(n) for p, j in enumerate(best(i, near(i, 0.6), 4))}
    assert rows(knn.nearest(df, 3, 0.6, block)) == {(i, p + 1): j for i in range(n) for p, j in enumerate(best(i, [j for j in near(i, 0.6) if j not in linked[i]], 3))}
    asked = plain.where("id % 50 = 0")
    assert {(r.id, r.neighbour) for r in knn.similar_to(asked, plain, 0.6, block).collect()} == {(i, j) for i in range(0, n, 50) for j in near(i, 0.6)}
    assert rows(knn.nearest_to(asked, plain, 5, -1.0, block)) == {(i, p + 1): j for i in range(0, n, 50) for p, j in enumerate(best(i, [j for j in range(n) if same[i, j]], 5))}
    counts = {r.topic: r.n for r in knn.counted_pairs(plain, 0.3, 0.8, block).collect()}
    assert counts == {t: sum(0.3 <= s[i, j] <= 0.8 for i in range(k, n) if (i % 3 == 0) == (t == "u") for j in range(i + 1, n) if same[i, j]) for k, t in ((0, "u"), (0, "t"))}
    assert {(r.a, r.b) for r in knn.similar_pairs(plain, 0.6, block).collect()} == {(i, j) for i in range(n) for j in near(i, 0.6) if i < j}


def test_units_hold_blocks_of_bounded_size(spark):
    """F4, F10, F11, F13, F14, F16: a group of 40,000 rows is dealt a dozen times at most, not once for every 1,024 rows, and no block passes its bytes."""
    df = spark.range(40_000).select(F.lit("t").alias("topic"), "id", F.array_repeat(F.lit(1.0), 4).alias("embedding"))
    assert knn._with_itself(knn._usable(df), None).count() <= 12 * 40_000
    wide = spark.range(300).select(F.lit("t").alias("topic"), "id", F.array_repeat(F.lit(1.0), 40_000).alias("embedding"))
    assert knn._sizes(wide, None, "blocks").first().blocks == 3
