"""The stored vector index against brute force."""

import uuid

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import ivf
from tessera.sources.scratch import shared_dir


def test_index_against_brute_force(spark):
    rng = np.random.default_rng(3)
    heads = rng.normal(size=(30, 12))
    x = heads[rng.integers(0, 30, 1500)] + 0.5 * rng.normal(size=(1500, 12))
    x[700:760] = x[700]  # copies: ties go by id
    rows = [(i, f"k{i % 3}", v.tolist()) for i, v in enumerate(x)] + [(2000, "k0", None), (2001, "k0", [0.0] * 12), (2002, "k1", [float("nan")] * 12)]
    df = spark.createDataFrame(rows, "id long, key_id string, embedding array<double>")
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    built = ivf.build(df, path, ("key_id",), "key_id")
    asked = df.where("id % 50 = 0").select(F.col("id").alias("qid"), "embedding")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for keys in (("k0", "k1", "k2"), ("k1",)):
        fit = [i for i in range(1500) if f"k{i % 3}" in keys]
        want = {}
        for q in range(0, 1500, 50):
            s = np.round(u[fit] @ u[q], 9)
            want[q] = [i for _, i in sorted((-s[j], i) for j, i in enumerate(fit))[:10]]
        where = F.col("key_id").isin(*keys)
        exact = ivf.search(built, asked, where=where, exact=True)
        got = {}
        for r in exact.orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append(r.id)
        assert got == want
        again = ivf.opened(spark, path)
        assert again.rows.count() == 1500 and len(again.centres) == 38
        quality = [r.recall for r in ivf.recall(ivf.search(again, asked, where=where), exact).collect()]
        assert len(quality) == 30 and np.mean(quality) >= 0.95
    assert ivf.search(built, asked.limit(0)).count() == 0
    empty = ivf.build(df.limit(0), f"{path}-none", ("key_id",))
    assert ivf.search(empty, asked).count() == 0
    assert all(r.similarity >= 0.9 for r in ivf.search(built, asked, floor=0.9).collect())


def test_cells_are_listed_for_few_queries_at_once(spark):
    """with all cells probed, no batch lists more than ``ASKED`` queries; before, a whole batch times all cells was one."""
    from types import SimpleNamespace

    rng = np.random.default_rng(5)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 4)))], "qid long, embedding array<double>").coalesce(1)
    sent = SimpleNamespace(value=rng.normal(size=(50, 4)))
    probed = ivf._probed(asked, sent, 50)
    assert probed.count() == 15_000 and probed.select("qid", "cell").distinct().count() == 15_000
    exact = ivf.search(ivf.Index(asked.withColumnRenamed("qid", "id"), sent.value, None), asked, k=3, exact=True)
    u = np.array([r.embedding for r in asked.orderBy("qid").collect()])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    assert {(r.qid, r["rank"]): r.id for r in exact.collect()} == {(q, p + 1): j for q in range(300) for p, j in enumerate(sorted(range(300), key=lambda j: (-s[q, j], j))[:3])}
