"""Ranked search, cover trees and collocations against brute force, and on odd tables."""

import collections
import gc
import math
import random
import weakref

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tessera.llm")

from pyspark.sql import functions as F

from tessera.llm import collocations, cover_tree, ranked
from tessera.llm.common import alnum_words
from test_operators import docs_of, empty_docs, odd_docs

# ranked search


def brute_ranks(docs, items, k=10):
    words = [alnum_words(t) for _, t in docs]
    total, size = sum(map(bool, words)), sum(map(len, words))
    df = collections.Counter(w for ws in words for w in set(ws))
    out = []
    for item, text in sorted(set(items), key=repr):
        found = []
        for (doc, _), ws in zip(docs, words):
            if ws:
                tf, m = collections.Counter(ws), 25 + 75 * len(ws) * total // size
                s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf[w] // (1000 * tf[w] + 8 * m)) for w in alnum_words(text) if w in tf)
                if s > 0:
                    found.append((-s, doc is None, doc or 0))
        out += [(item, i + 1, None if missing else d, -s) for i, (s, missing, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def test_ranked_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 90}"
    docs = [(i, " ".join(word() for _ in range(rng.choice([0, 3, 12, 60, 400])))) for i in range(220)]
    docs += [(300 + i, docs[7][1]) for i in range(15)] + [(7, docs[7][1]), (None, docs[7][1]), (400, None), (401, "W1, w1! É w2"), (402, "w3 " * 20_000)]
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 5, 30])))) for i in range(25)] + [(3, "w3 w3 w3 é É"), (4, None), (5, ""), (6, "nothing here"), (6, "nothing here"), (None, "w5 w9")]
    df = docs_of(spark, [(i, t, "s") for i, t in docs])
    asked = spark.createDataFrame([(i, t, 1.0, 2) for i, t in items], "item_id long, text string, score double, rank int")
    want = brute_ranks(docs, items)
    for chunk, rows in ((400_000, 16_384), (40, 16_384), (400_000, 20)):
        # small shards pass their best on to the next
        monkeypatch.setattr(ranked, "SHARD_DOCS", rows)
        assert sorted((tuple(r) for r in ranked.search(df, asked, chunk=chunk).collect()), key=repr) == want


def test_ranked_stops_early_and_stays_exact():
    """One shard by hand: a stop before all groups are taken gives the same documents and scores as no bound at all."""
    import pyarrow as pa

    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(40, rng.integers(1, 12), replace=False)) for _ in range(3000)]
    tfs = [rng.integers(1, 9, len(r)) for r in rows]
    rows[5], tfs[5] = np.arange(30), np.full(30, 9)
    b = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(3000)), "n": pa.array([int(t.sum()) for t in tfs]), "terms": pa.array([r.tolist() for r in rows], pa.list_(pa.int32())), "tfs": pa.array([t.tolist() for t in tfs], pa.list_(pa.int32()))})
    shard, whole = ranked.Shard([b], 3000, int(sum(t.sum() for t in tfs))), np.zeros(40, np.int64)
    terms, factors = np.arange(12), np.arange(100, 112)
    whole[terms] = factors
    scores = [int((whole[r] * shard.impact[e - len(r) : e]).sum()) for r, e in zip(rows, shard.ends)]
    whole[:] = 0
    want = sorted((-s, d) for d, s in enumerate(scores) if s)[:1]
    taken = []
    ranges = ranked._ranges
    ranked._ranges = lambda x, y: taken.append(int((y - x).sum())) or ranges(x, y)
    try:
        docs, got = shard.best(terms, factors, 1, 0, whole)
    finally:
        ranked._ranges = ranges
    assert [(-s, d) for s, d in zip(got.tolist(), docs.tolist())] == want and not whole.any()
    asked = int((np.searchsorted(shard.keys, (terms + 1) * ranked.IMPACTS) - np.searchsorted(shard.keys, terms * ranked.IMPACTS)).sum())
    assert sum(taken[:-1]) < asked  # the last ranges are those of the completed documents
    assert len(shard.best(terms, factors, 1, 10**15, whole)[0]) == 0


def test_ranked_odd_tables(spark):
    items = spark.createDataFrame([(1, "same words"), (2, None)], "item_id long, text string")
    rows = ranked.search(odd_docs(spark), items).orderBy("rank").collect()
    assert [(r.item_id, r.rank, r.doc_id) for r in rows] == [(1, 1, 5), (1, 2, 5), (1, 3, 6)] and len({r.score for r in rows}) == 1
    assert ranked.search(empty_docs(spark), items).count() == 0
    assert ranked.search(odd_docs(spark), items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked.search(odd_docs(spark).withColumn("doc_id", F.col("doc_id").cast("string")), items).count() == 3


# cover trees


def brute_links(rows, cosine):
    fit = [k for k, (i, v, label) in enumerate(rows) if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    up, degree = {k: k for k in fit}, dict.fromkeys(fit, 0)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, x in enumerate(fit):
        for y in fit[n + 1 :]:
            a, b = np.array(rows[x][1], float), np.array(rows[y][1], float)
            if rows[x][2] == rows[y][2] and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                degree[x] += 1
                degree[y] += 1
                up[find(y)] = find(x)
    least = {}
    for k in fit:
        least[find(k)] = min(least.get(find(k), 10**9), rows[k][0])
    return sorted(((i, degree.get(k, 0), c := least[find(k)] if k in up else i, i == c) for k, (i, _, _) in enumerate(rows)), key=repr)


def made_vectors(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for label, groups, most in ((0, 40, 6), (1, 8, 40), (2, 3, 2)):
        for _ in range(groups):
            head = rng.normal(size=12)
            for _ in range(rng.integers(1, most + 1)):
                noise = rng.choice([0, 0.05, 0.15, 0.25])
                rows.append((len(rows), ((head + noise * rng.normal(size=12)) * rng.uniform(0.1, 9)).tolist(), label))
    rows += [(1000 + k, rows[3][1], 0) for k in range(30)]
    nan = float("nan")
    return rows + [(2000, None, 0), (2001, [0.0] * 12, 0), (2002, [nan] * 12, 0), (2003, rows[0][1], None), (None, rows[0][1], 0), (5, rows[5][1], 0), (2004, [1.0, 2.0], 0), (2005, [2.0, 4.0], 0), (2006, [], 0), (2007, [None] * 12, 1), (2008, [-0.0, 3.0], 2), (2009, [0.0, 3.0], 2)]


def test_links_against_brute_force(spark):
    rows = made_vectors(5)
    df = spark.createDataFrame([(*r, 1, True) for r in rows], "vec_id long, embedding array<double>, label int, n_links int, kept boolean")
    want = brute_links(rows, 0.93)
    assert sum(r[1] for r in want) > 500
    for most in (1024, 24):
        # small cells: rounds of splitting, many groups that meet
        assert sorted((tuple(r) for r in cover_tree.near_copies(df, most=most).collect()), key=repr) == want
    assert cover_tree.near_copies(df.limit(0)).count() == 0


def test_a_cover_tree_is_one():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    t = cover_tree.Tree.unpacked(cover_tree.Tree(np.arange(300), np.ones(300, np.int64), v).packed())
    gap = lambda x, y: np.sqrt(np.maximum(0, 2 - 2 * (x @ y.T)))
    assert len(t.nodes[0]) == 1 and len(t.nodes[-1]) == 300
    for level in range(1, len(t.nodes) - 1):
        here, radius = t.nodes[level], 2.0 ** (1 - level)
        assert set(t.nodes[level - 1]) <= set(here)
        apart = gap(v[here], v[here]) + 9 * np.eye(len(here))
        assert apart.min() > radius and gap(v, v[here]).min(1).max() <= radius + 1e-9
    for level, here in enumerate(t.nodes):
        far = gap(v, v[here])[np.arange(300), t.below[level]]
        assert all(far[t.below[level] == k].max() <= t.radius[level][k] + 1e-7 for k in range(len(here))) and t.weight[level].sum() == 300


def test_traversal_prunes_and_counts_blocks():
    """Two far bundles meet at their roots only, and a tight one is counted as a block."""
    rng = np.random.default_rng(2)
    tight = lambda at: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(np.eye(8)[at] + 0.01 * rng.normal(size=(50, 8)))
    a, b, c = (cover_tree.Tree(np.arange(50) + 100 * k, np.full(50, 2), tight(k if k < 2 else 0)) for k in range(3))
    found = cover_tree.Links()
    cover_tree.traverse(a, b, 0.93, found)
    assert not found.counts and not found.edges
    cover_tree.traverse(a, c, 0.93, found)
    out = found.result().to_pylist()
    assert {r["n"] for r in out if r["b"] is None} == {100} and len([r for r in out if r["b"] is not None]) == 99


# collocations


def brute_phrases(rows, least, share=50, top=2000):
    import re

    counts, totals = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]", piece) if x]
            totals[lang] += len(w)
            counts.update((lang, *w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    good = {g: a for g, a in counts.items() if len(g) > 2 and a >= least}
    by_lang = collections.defaultdict(list)
    for (lang, *w), a in good.items():
        if len(w) == 2 and any(100 * x >= share * a for (other, *y), x in good.items() if other == lang and len(y) == 3 and (y[:2] == w or y[1:] == w)):
            continue
        score, k = min((1_000_000 * a * a // (counts[(lang, *w[:k])] * counts[(lang, *w[k:])]), k) for k in range(1, len(w)))
        by_lang[lang].append((-score, -a, " ".join(w), counts[(lang, *w[:k])], counts[(lang, *w[k:])]))
    return sorted((lang, i + 1, p, -a, x, y, totals[lang], -s) for lang, found in by_lang.items() for i, (s, a, p, x, y) in enumerate(sorted(found, key=lambda r: (r[0], r[1], r[2].encode()))[:top]))


def test_collocations_against_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: f"W{int(rng.paretovariate(0.9)) % 40}é"
    rows = []
    for i in range(150):
        text = "".join(word() + rng.choice([" ", " ", " ", "\t", ", ", ".\n", " - "]) for _ in range(rng.choice([0, 2, 30, 200])))
        rows.append((rng.choice(["en", "de", None]), text + rng.choice(["", " of the  day", "! of the night", " in spite of it"])))
    rows += [("en", None), ("fr", "x y z " * 9), ("it", "a a a a a a a a a a a a"), ("it", "....,,,"), ("en", "of the day. " * 3000)]
    df = spark.createDataFrame([(i, t, lang, 1, 2) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, n int, rank int")
    want = brute_phrases(rows, 10)
    assert len(want) > 40 and any(r[0] == "und" for r in want)
    for shard in (1_000_000, 500):
        monkeypatch.setattr(collocations, "SHARD", shard)
        assert sorted(tuple(r) for r in collocations.collocations(df).collect()) == want
    assert sorted(tuple(r) for r in collocations.collocations(df, top=3).collect()) == [r for r in want if r[1] <= 3]
    # a filter with room for nothing holds nothing back
    monkeypatch.setattr(collocations, "FILTER_BITS", 1 << 6)
    assert sorted(tuple(r) for r in collocations.collocations(df).collect()) == want


def test_collocations_odd_tables(spark):
    assert collocations.collocations(empty_docs(spark)).count() == 0
    got = collocations.collocations(odd_docs(spark)).collect()
    assert {r.lang for r in got} <= {"en"} and [r.rank for r in sorted(got)] == list(range(1, len(got) + 1))


def test_one_shard_at_a_time(monkeypatch):
    """Without the collector's help a shard is gone before the next has its words: memory follows a shard, not the texts of a task."""
    monkeypatch.setattr(collocations, "SHARD", 30)
    alive, most = weakref.WeakSet(), []
    begin = collocations.Shard.__init__

    def counted(self, filters):
        begin(self, filters)
        alive.add(self)

    def rows(shard):
        most.append(len(alive))
        yield from shard.intervals(1, 3)
        assert not shard.langs and not shard.parts

    monkeypatch.setattr(collocations.Shard, "__init__", counted)
    texts = pa.RecordBatch.from_pydict({"lang": ["en", None] * 50, "text": [f"a b c. word{i} a b" for i in range(100)]})
    gc.disable()
    try:
        found = sum(int(count.sum()) for m, _, _, count in collocations._by_shard([texts], [], rows) if m == 3)
    finally:
        gc.enable()
    assert found == 200 and len(most) == 20 and max(most) == 1
