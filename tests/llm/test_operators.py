"""Small tests of each training-data operator: hand-made cases, brute force, and odd tables."""

import collections
import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

pytest.importorskip("tessera.llm")

from pyspark.sql import functions as F

from tessera.llm import decontaminate, html_text, lm, minhash, mixing, quality, queries, rules, substrings, toxicity, url_filter
from tessera.llm.common import alnum_words, blank_words, least_hashed
from tests_llm_helpers import brute_components, brute_hits

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words int, size int, kept boolean, path string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 9.0, 9, 9, True, "p") for i, t, s in rows], DOCS)


def odd_docs(spark):
    """Nulls, blanks, one word, repeated rows, ties and a very long text, with clashing extra columns."""
    long_text = " ".join(f"word{i % 977} item{i % 1013}." for i in range(15_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (5, "same words here now", "b"), (5, "same words here now", "b"), (6, "same words here now", None), (None, "no id at all", "c"), (7, long_text, "c")]
    return docs_of(spark, rows)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_words():
    assert blank_words("A b\u00a0c\nD É") == ["a".encode(), "b\u00a0c".encode(), b"d", "É".encode()]
    assert alnum_words("It's É-9!") == [b"it", b"s", "É".encode(), b"9"]
    assert blank_words(None) == [] and alnum_words("") == []


# toxicity and quality


def test_toxicity_learns_and_takes_odd_rows(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        t = [rng.choice(words) for _ in range(30)] + (["vile", "brute"] if bad else [])
        rng.shuffle(t)
        rows.append((i, " ".join(t), "s"))
        labels.append((i, 1, int(bad)))
    docs, labelled = docs_of(spark, rows), labels_of(spark, [*labels, (None, 1, 1), (3, None, None), (0, 1, 0)])
    model = toxicity.fit(docs, labelled)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i, *_ in labels if got[i].held_out]
    assert 40 < len(held) < 130
    assert sum(got[i].predicted == int(i % 4 == 0) for i in held) >= 0.95 * len(held)
    odd = toxicity.score(odd_docs(spark), model).collect()
    assert len(odd) == 9 and all(0 <= r.score <= 1 for r in odd) and sum(r.doc_id is None for r in odd) == 1
    assert toxicity.score(empty_docs(spark), model).count() == 0
    blank = toxicity.fit(docs, labels_of(spark, []))
    assert {r.score for r in toxicity.score(docs, blank).collect()} == {0.5}
    clean = toxicity.clean_documents(docs, labelled)
    assert clean.columns == docs.columns and 290 <= clean.count() <= 310


def test_quality_learns_from_positives_alone(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.where("quality = 1").unionByName(labels.where("quality = 0").withColumn("quality", F.lit(None).cast("int")))
    model = quality.fit(docs, flipped)
    assert 0.5 < model.prior <= 0.98
    odd = quality.score(odd_docs(spark), model).collect()
    assert len(odd) == 9 and all(0 <= r.score <= 1 for r in odd)
    assert quality.score(empty_docs(spark), model).count() == 0
    none = quality.fit(docs, labels_of(spark, []))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}


def test_prior_and_risk_on_made_up_statistics():
    rng = np.random.default_rng(3)
    good = lambda n: rng.normal(0, 1, (n, 16))
    bad = lambda n: rng.normal(0, 1, (n, 16)) + np.r_[4.0, np.zeros(15)]
    p, u = good(1500), np.concatenate([good(1200), bad(300)])
    model = quality.fit_arrays(p, u)
    assert abs(model.prior - 0.8) < 0.06
    assert (model.score(good(400)) >= 0.3).mean() > 0.95 and (model.score(bad(400)) < 0.5).mean() > 0.85


def test_ftrl_against_brute_force(spark, sf):
    """The update rule once more, coordinate by coordinate, over the same features in the same order."""
    rows = sorted((r.doc_id, r.text, r.toxic) for r in spark.sql(f"select d.doc_id, d.text, max(l.toxic) toxic from parquet.`{sf}/documents.parquet` d join parquet.`{sf}/labels.parquet` l using (doc_id) where crc32(cast(cast(doc_id as string) as binary)) % 5 != 0 group by all").collect())
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels, epochs=2)
    hashes, z, n, bias, bias_n = toxicity._Hashes(), collections.defaultdict(float), collections.defaultdict(float), 0.0, 0.0
    x = [sorted(set(map(int, hashes.features(t, model.bits)))) for _, t, _ in rows]
    weight = lambda j: 0.0 if abs(z[j]) <= model.l1 else -(z[j] - math.copysign(model.l1, z[j])) / ((model.beta + math.sqrt(n[j])) / model.alpha + model.l2)
    order = np.random.default_rng(7)
    for _ in range(2):
        for i in order.permutation(len(rows)):
            w = {j: weight(j) for j in x[i]}
            g = 1 / (1 + math.exp(-(sum(w.values()) + bias))) - rows[i][2]
            for j in x[i]:
                sigma = (math.sqrt(n[j] + g * g) - math.sqrt(n[j])) / model.alpha
                z[j] += g - sigma * w[j]
                n[j] += g * g
            bias_n += g * g
            bias -= model.bias_rate * model.alpha * g / (model.beta + math.sqrt(bias_n))
    at, w, b = model.sparse()
    want = {j: weight(j) for j in z if weight(j)}
    assert set(map(int, at)) == set(want) and b == pytest.approx(bias, abs=1e-9)
    assert all(v == pytest.approx(want[int(j)], rel=1e-5) for j, v in zip(at, w))
    for r in toxicity.score(docs, model).collect()[:60]:
        t = next(d.text for d in docs.where(F.col("doc_id") == r.doc_id).collect()) if r.doc_id % 7 == 0 else None
        if t is not None:
            odds = bias + sum(want.get(j, 0.0) for j in set(map(int, hashes.features(t, model.bits))))
            assert r.score == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-5)


def test_samples_are_the_least_by_hash(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    key = F.xxhash64("doc_id")
    for most in (1, 50, 3000, 30_000):
        want = [r.doc_id for r in ids.orderBy(key, "doc_id").limit(most).collect()]
        assert [r.doc_id for r in least_hashed(ids, key, most, "doc_id").collect()] == want
    repeated = docs_of(spark, [(1, "z", "s"), (1, "a", "s"), (2, None, "s"), (2, "b", "s")])
    got = toxicity.training_rows(repeated, labels_of(spark, [(1, 1, 1), (2, 1, 0), (9, 1, 1)]), "toxic", 10).collect()
    assert sorted(map(tuple, got)) == sorted((i, t, y) for i, t, y in [(1, "a", 1), (2, "b", 0)] if not spark.range(1).select(toxicity.held_out(F.lit(i))).first()[0])


def test_quality_against_brute_force(spark, sf):
    """The sample is whole here: the same arrays and a plain reading of the model give the same scores."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = {r.doc_id: r.h for r in docs.select("doc_id", toxicity.held_out("doc_id").alias("h")).collect()}
    good = sorted({r.doc_id for r in labels.collect() if r.quality == 1 and r.doc_id in texts and not held[r.doc_id]})
    model = quality.fit_arrays(np.array([quality.statistics(texts[i]) for i in good]), np.array([quality.statistics(texts[i]) for i in sorted(texts)]))
    for r in quality.score(docs, quality.fit(docs, labels)).collect():
        x = quality.statistics(texts[r.doc_id])
        odds = model.bias + sum(model.weights[j][sum(e <= v for e in model.edges[j])] for j, v in enumerate(x))
        assert r.score == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-9) and r.predicted == (r.score >= 0.3)


def test_non_negative_risk_by_finite_differences():
    """One small step of plain descent on the stated risk, whichever of its two branches holds."""
    rng = np.random.default_rng(2)
    ap, au = rng.integers(0, quality.BINS, (30, 3)), rng.integers(0, quality.BINS, (50, 3))
    sig = lambda g: 1 / (1 + np.exp(-g))
    for prior in (0.1, 0.9):
        w, b = quality._descend(ap, au, prior, 1)
        flat = lambda a, w, b: w[a + np.arange(3) * quality.BINS].sum(1) + b

        def risk(w, b):
            up, uu, pn = sig(-flat(ap, w, b)).mean(), sig(flat(au, w, b)).mean(), sig(flat(ap, w, b)).mean()
            rest = uu - prior * pn
            return prior * up + rest if rest >= 0 else -rest

        z, eps = np.zeros(3 * quality.BINS), 1e-6
        grad = np.array([(risk(z + eps * (np.arange(len(z)) == k), 0.0) - risk(z - eps * (np.arange(len(z)) == k), 0.0)) / (2 * eps) for k in range(len(z))])
        sure = abs(grad) > 1e-5  # the first step of Adam goes against the sign of each partial derivative
        assert sure.any() and (np.sign(w[sure]) == -np.sign(grad[sure])).all()
        slope = (risk(z, eps) - risk(z, -eps)) / (2 * eps)
        assert abs(slope) < 1e-5 or np.sign(b) == -np.sign(slope)


# mixing


def test_targets_by_iteration(spark):
    sizes = {"a": 100, "b": 4000, "c": 50, "d": 900, "é": 0, "z": 2000}
    rows = [(False, s, n) for s, n in sizes.items()] + [(True, "", 700)]
    got = {(r.no_source, r.source): r.target for r in mixing.target_table(spark.createDataFrame(rows, "no_source boolean, source string, source_size long")).collect()}
    order = sorted(rows, key=lambda r: (r[0], r[1].encode()))
    weight = {(r[0], r[1]): i % 3 + 1 for i, r in enumerate(order)}
    total, fixed, free = sum(r[2] for r in rows), {}, {(r[0], r[1]): r[2] for r in rows}
    while True:
        level = (total - sum(fixed.values())) / sum(weight[k] for k in free)
        over = [k for k in free if weight[k] * level > 3 * free[k]]
        if not over:
            break
        for k in over:
            fixed[k] = 3 * free.pop(k)
    want = fixed | {k: weight[k] * level for k in free}
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 64, 1000):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(False), F.lit("x")).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))
    moved = [r.p for r in spark.range(1000).select(mixing.permuted(F.col("id"), F.lit(1000).cast("long"), F.lit(False), F.lit("x")).alias("p")).collect()]
    assert sum(i == p for i, p in enumerate(moved)) < 20


def test_mix_comes_near_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = mixing.mix(docs).collect()
    size = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    assert len(got) == len(size) and all(r.size == size[r.doc_id] and 0 <= r.taken <= 3 * r.size for r in got)
    by = collections.defaultdict(lambda: [0, 0, 0])
    for r in got:
        by[r.source][0] += r.taken
        by[r.source][1] = r.target
        by[r.source][2] += r.size
        assert r.source_size >= r.size
    assert all(abs(t - want) <= max(200, 0.05 * want) for t, want, _ in by.values())
    assert abs(sum(want for _, want, _ in by.values()) - sum(size.values())) < 1e-3
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()))


def test_mix_takes_odd_rows(spark):
    got = mixing.mix(odd_docs(spark)).collect()
    assert len(got) == 9 and all(r.taken <= 3 * r["size"] for r in got)
    assert mixing.mix(empty_docs(spark)).count() == 0


def test_shards_follow_expectation(spark):
    sources = spark.createDataFrame([(False, "a", 100, 70.4), (False, "b", 300, 500.3), (True, "", 50, 29.3)], "no_source boolean, source string, blocks long, want double")
    got = mixing.counts_of(sources, shard_blocks=60).collect()
    assert sum(r.slots for r in got) == 600 and sum(r.slots for r in got if r.shard == 0) == 60
    for key, want in (("a", 70.4), ("b", 500.3), ("", 29.3)):
        mine = sorted((r.shard, r["first"], r.slots) for r in got if r.source == key)
        assert abs(sum(m[2] for m in mine) - want) <= 10 and all(a[1] + a[2] == b[1] for a, b in zip(mine, mine[1:]))
    capped = mixing.counts_of(sources.withColumn("most_slots", F.lit(70).cast("long")), shard_blocks=60).groupBy("source").agg(F.sum("slots").alias("n")).collect()
    assert max(r.n for r in capped) == 70


def spark_hash(*parts):
    """The engine's 64-bit hash of columns, once more: XXH64 with the hash of the columns before as seed."""
    h = 42
    for p in parts:
        if p is not None:
            data = p.encode() if isinstance(p, str) else p[0].to_bytes(4, "little", signed=True) if isinstance(p, tuple) else int(p).to_bytes(4 if isinstance(p, bool) else 8, "little", signed=True)
            h = xxhash.xxh64_intdigest(data, h)
    return h


def brute_mix(rows, block_words, shard_blocks, seed, draw_seed):
    """Taken words by (source, doc_id, size): targets given, everything drawn and placed anew. ``rows`` are (doc_id, source, size)."""
    signed = lambda h: h - (h >> 63 << 64)
    unit = lambda *p: (spark_hash(*p) >> 11) * 2.0**-53
    buckets = 1 + math.isqrt(len(rows))
    of = collections.defaultdict(list)
    for doc, source, size in rows:
        of[source is None, source or ""].append((signed(spark_hash(doc, (seed,))) % buckets, signed(spark_hash(doc, (seed + 1,))), doc if doc is not None else -1, size, doc))
    sizes = {k: sum(r[3] for r in v) for k, v in of.items()}
    order = sorted(of, key=lambda k: (k[0], k[1].encode()))
    weight = {k: i % 3 + 1 for i, k in enumerate(order)}
    fixed, free = {}, dict(sizes)
    while free:
        level = (sum(sizes.values()) - sum(fixed.values())) / sum(weight[k] for k in free)
        over = [k for k in free if weight[k] * level > 3 * free[k]]
        if not over:
            break
        for k in over:
            fixed[k] = 3 * free.pop(k)
    target = fixed | {k: weight[k] * level for k in free}
    blocks = {k: -(-sizes[k] // block_words) for k in order}
    want = {k: target[k] / sizes[k] * blocks[k] for k in order if sizes[k]}
    total = round(sum(want.values()))

    def pick(shares, at):
        upto, names = 0.0, [k for k in order if shares.get(k, 0) > 0]
        ends = [upto := upto + shares[k] for k in names]
        return names[min(sum(e <= at * ends[-1] for e in ends), len(names) - 1)]

    counts, number = collections.Counter(), total - total // 2
    for i in range(number):
        counts[pick(want, unit(i // shard_blocks, i % shard_blocks, (draw_seed,)))] += 1
    lack = {k: max(0.0, want[k] - counts[k]) for k in want}
    scale = (total - number) / sum(lack.values())
    whole = {k: math.floor(lack[k] * scale) for k in lack}
    part = {k: lack[k] * scale - whole[k] for k in lack}
    for j in range(total - number - sum(whole.values())):
        counts[pick(part, unit(-1, j, (draw_seed,)))] += 1
    taken = collections.Counter()
    for k in want:
        times = collections.Counter()
        for i in range(min(counts[k] + whole[k], 3 * blocks[k])):
            x = i % blocks[k]
            for r in range(1, 17):
                other = (signed(spark_hash(k[0], k[1], (r,), (seed,))) % blocks[k] - x) % blocks[k]
                if spark_hash(max(x, other), (r,), k[0], k[1], (seed + 1,)) & 1:
                    x = other
            times[x] += 1
        off = 0
        for *_, size, doc in sorted(of[k], key=lambda r: r[:4]):
            for w in range(off, off + size):
                taken[k, doc, size] += times[w // block_words]
            off += size
    return +taken, target


def test_taken_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(9_001, "one two three", None), (9_001, "one two three", None), (9_002, None, None), (9_003, "solo", "zz")]
    docs = docs_of(spark, rows)
    brief = [(i, source, len((t or "").split())) for i, t, source in rows]
    seen = []
    for draw_seed in (7, 8):
        want, target = brute_mix(brief, 16, 500, mixing.SEED, draw_seed)
        got = collections.Counter()
        for r in mixing.mix(docs, block_words=16, shard_blocks=500, draw_seed=draw_seed).collect():
            key = (r.source is None, r.source or "")
            got[key, r.doc_id, r["size"]] += r.taken
            assert abs(r.target - target[key]) < 1e-6
        assert +got == want
        seen.append(got)
    assert seen[0] != seen[1]  # what is taken follows from the draw


def test_texts_hold_the_blocks_of_their_slots(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    placed, sources = mixing.blocks_of(docs, block_words=16)
    text = {r.doc_id: (r.text or "").split() for r in docs.collect()}
    stream = collections.defaultdict(list)
    for r in sorted(placed.collect(), key=lambda r: r.off):
        stream[r.no_source, r.source] += [(r.doc_id, k) for k in range(r["size"])]
    slots = {(r.no_source, r.source, r.slot): (r.shard, r.block) for r in mixing.slots_of(sources).collect()}
    blocks = mixing.texts(docs, block_words=16).collect()
    assert len(blocks) == len(slots)
    for r in blocks[:200]:
        shard, b = slots[r.no_source, r.source, r.slot]
        assert r.shard == shard and r.text.split() == [text[i][k] for i, k in stream[r.no_source, r.source][b * 16 : b * 16 + 16]]


def test_shards_draw_multinomial_counts(spark):
    sources = spark.createDataFrame([(False, "a", 100, 30_000.0), (False, "b", 300, 9_000.2), (True, "", 50, 999.8)], "no_source boolean, source string, blocks long, want double")
    got = mixing.counts_of(sources, shard_blocks=1000).collect()
    for key, want in (("a", 30_000), ("b", 9_000), ("", 1_000)):
        n = [r.slots for r in got if r.source == key and r.shard < 20]
        assert abs(sum(r.slots for r in got if r.source == key) - want) <= 2 and max(r.shard for r in got) == 39
        n += [0] * (20 - len(n))
        spread = sum((x - want / 40) ** 2 for x in n) / (want / 40 * (1 - want / 40_000))
        assert 6 < spread < 45  # chi square of 20 degrees: neither fixed counts nor clumps


# URL filter


def test_url_filter_against_rules(spark):
    urls = ["http://a.example.com/en/71", "http://A.EXAMPLE.com/en/8?x", "ftp://com/en/", "http://xcom/en/1", "https://b.net/de/1", "https://q.example.net/de/8#t", "http://org", "http://www.org/es/2", "no scheme", None, "http:///en/", "x://a.b.org:80/es/", "http://example.com?/en/7"]
    rows = [(i, u, "h", "clash") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    listed = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = {r.page_id: r for r in url_filter.judge(pages, listed).collect()}
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = max(((h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), key=lambda r: len(r[0]), default=(None, "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, *fit), u
    assert url_filter.judge(pages.limit(0), listed).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, listed.limit(0)).collect()} == {"allow"}


def test_registered_rules_are_the_contracts(spark):
    """The contract's words, written out: block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/."""
    want = {
        "http://com/en/": ("com/en/", "block"),
        "http://a.example.com/en/71": ("example.com/en/7", "allow"),
        "http://example.com/en/8": ("com/en/", "block"),
        "http://b.net/de/1": ("net/de/", "allow"),
        "http://q.example.net/de/8": ("example.net/de/8", "block"),
        "http://example.net/de/7": ("net/de/", "allow"),
        "http://www.org/es/2": ("org/es/", "block"),
        "http://www.org/de/2": (None, "allow"),
    }
    pages = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    listed = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, listed).collect()}
    assert got == dict(enumerate(want.values()))


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where(F.xxhash64("key") % 97 == 0)
    n = listed.count()
    cascade = url_filter.Cascade(listed, universe, n, 200)  # a wrong estimate makes several levels
    assert len(cascade.levels) > 1
    hit = universe.where(cascade.has(F.col("key")))
    assert hit.count() == n and hit.join(listed, "key", "left_anti").count() == 0


# HTML


def test_html_blocks():
    page = "<head><title>t</title></head><body><nav>Home</nav><header>Site</header><article><header><h1>A &amp; b</h1></header><p class='intro'>x <b>y</b>z<br>w<script>bad()</script><p>1 &lt; 2 &#8364; &amp c<div class='share-bar'>Share</div><ul><li>one<li>two</ul><section id=comments><p>me too</section></article><aside>Side</aside><div class=ad>Buy</div><form><input>Go</form><footer>F</footer>"
    assert html_text.main_text(html_text.blocks(page), []) == "A & b\n\nx yz w\n\n1 < 2 € & c\n\none\n\ntwo"
    assert html_text.blocks(None) == [] and html_text.blocks("") == [] and html_text.blocks("<p>open <b>never closed") == [("open never closed", 1)]


def test_html_keeps_what_an_article_says():
    text = lambda h, *others: html_text.main_text(html_text.blocks(h), [html_text.blocks(o) for o in others])
    said = "<div class='search-tips'><p>How to search well</p></div><p id='related-work'>Related work</p><p class='notice'>Note</p><div class='notice-period'>Two weeks</div><h2 class='menu'>Menu</h2><ul class='comment-style'><li>Be brief</li></ul>"
    assert text(f"<article><p>one</p>{said}</article>") == "one\n\nHow to search well\n\nRelated work\n\nNote\n\nTwo weeks\n\nMenu\n\nBe brief"
    for part in ("class='ad'", "class='box ads'", "id=comments", "class='share-bar'", "class='nav_list'", "class='ad-slot top'"):
        assert text(f"<article><p>one</p><div {part}><p>Buy</p></div></article>") == "one"
    # a list that may be part of the article goes if other pages have it too
    related = "<div class='related'><p>See also</p></div></article>"
    assert text("<article><p>one</p>" + related) == "one\n\nSee also" and text("<article><p>one</p>" + related, "<article><p>two</p>" + related) == "one"
    assert text("<p>x</p><div class='search-tips'>y</div>") == "x"


def test_html_that_is_not_well_formed():
    text = lambda h, *others: html_text.main_text(html_text.blocks(h), [html_text.blocks(o) for o in others])
    assert text("<article><p>one</p><button>Go<p>two</p></article>") == "one\n\ntwo"
    assert text("<article><p>a</p><svg><svg><text>x</text></svg><text>y</text></svg><p>b</p></article>") == "a\n\nb"
    assert text("<p>a<select><option>x<option>y</select> b<video>v</video><p>c<noscript>n") == "a b\n\nc"
    assert text("<article class='promo'><p>kept</p></article><div id=content>beside</div><div class=promo>gone</div>") == "kept\n\nbeside"
    assert text("<body class='search-results has-sidebar'><p>kept") == "kept" and text("<article>x</article><script>never closed <p>y") == "x"
    assert text("<head><title>t</title><p>no end of head") == "no end of head" and text("<svg/><p>after") == "after"
    long_page = "<p>" + "word " * 200_000 + "<p>".join(f"line {k}" for k in range(20_000))
    assert len(text(long_page)) > 1_000_000
    assert text("<div>top</div><p>mine</p>", "<div>top</div><p>theirs</p>") == "mine"
    # a copy on one side is no template, and one with the same lines says nothing
    assert text("<div>top</div><p>mine</p>", "<div>top</div><p>mine</p><p>more</p>", "<div>top</div><p>theirs</p>") == "mine"
    assert text("<div>top</div><p>mine</p>", "<div>top</div><p>mine</p>") == "top\n\nmine"
    assert text("<div>top</div><article>mine</article>", "<div>top</div><article>mine</article><p>x") == "mine"


def test_differencing_against_brute_force(spark):
    """Beside an article, shared lines go by alignment alone; pairing and alignment are done once more by hand."""
    rng = random.Random(8)
    rows = []
    for k in range(120):
        host, path = f"h{rng.choice('abc')}.org", f"/{rng.choice(['x', 'y/z', 'é'])}/{rng.randint(0, 30)}"
        parts = rng.sample(range(6), rng.randint(0, 6))
        lines = [f"<div>site {host} part {j}</div>" for j in (sorted(parts) if rng.random() < 0.8 else parts)]
        own = f"<article><p>Story {k}</p></article>" if k % 3 else f"<div>Tale {k}</div>"
        rows.append((k, f"http://{host}{path}", "".join([*lines[:3], own, *lines[3:]]), "clash", "clash", 3))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, lines string, range int")
    split = lambda r: re.match(r"http://([^/]*)(.*)", r[1]).groups()
    order = sorted(rows, key=lambda r: (*(x.encode() for x in split(r)), r[0]))

    def lcs(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    found = [{r.page_id: r.text for r in html_text.extract(pages, most).collect()} for most in (4, 4096)]
    assert found[0] == found[1] and len(found[0]) == len(rows)
    lost = 0
    for at, r in enumerate(order):
        mine, text = [t for t, _ in html_text.blocks(r[2])], found[0][r[0]].split("\n\n")
        near = [[t for t, _ in html_text.blocks(o[2])] for o in order[max(at - 1, 0) : at + 2] if o is not r and split(o)[0] == split(r)[0]]
        near = [o for o in near if o != mine]
        kept, gone = [t for t in mine if t in text], [t for t in mine if t not in text]
        assert kept == text and (f"Story {r[0]}" in text or f"Tale {r[0]}" in text)
        # every line occurs once a page: what went is a common subsequence of all, and with one neighbour a longest one
        assert all([t for t in o if t in gone] == gone for o in near) and (near or not gone)
        if len(near) == 1:
            assert len(gone) == lcs(mine, near[0])
        lost += len(gone)
    assert lost > 50


def test_lcs_is_longest():
    rng = random.Random(5)
    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        got, it = html_text.shared(a, b), iter(b)
        assert len(got) == d[-1][-1] and all(a[k] in it for k in got)


def test_differencing_without_markup(spark):
    page = lambda k: f"<div>Top of site</div><div>Story {k} says much that no other page says, at length.</div><div>Bottom line</div>"
    rows = [(k, f"http://h{k % 2}.org/p/{k:03}", page(k), "x") for k in range(40)] + [(100, None, None, "x"), (101, "bad", "<p>alone", "x"), (7, "http://h1.org/p/007", page(7), "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    for bounds in (4096, 3):
        got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(pages, bounds).collect()}
        for k in range(40):
            if k not in (7, 5, 9):  # the repeated page pairs with itself, which is a copy
                assert got[k][0] == f"Story {k} says much that no other page says, at length.", (k, bounds)
        assert got[100] == ("", 0) and got[101] == ("alone", 5)
    assert html_text.extract(pages, 3).count() == 43 and html_text.extract(pages.limit(0)).count() == 0


# near-dedup


def test_minhash_against_brute_force(spark):
    rng = random.Random(11)
    words = [f"t{i}" for i in range(500)]
    texts, base = [], [rng.choice(words) for _ in range(120)]
    for i in range(150):  # one large group of near copies, at all similarities round the threshold
        t = list(base)
        for _ in range(rng.randint(0, 14)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append((i, " ".join(t)))
    for i in range(150, 260):
        texts.append((i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))))
    texts += [(300, "a b"), (301, "A  b"), (302, "a"), (303, None), (304, "")]
    for size in (2, 5):
        want = brute_components(texts, size, 80)
        docs = docs_of(spark, [(i, t, "s") for i, t in texts])
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.classes_of(docs, size, 80).collect()}
        assert got == want
    old = minhash.CELL
    minhash.CELL = 8  # many cells
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.classes_of(docs, 2, 80).collect()}
    finally:
        minhash.CELL = old
    assert got == brute_components(texts, 2, 80)
    one = minhash.one_of_each(docs, 5, 80)
    assert one.columns == docs.columns and one.count() == len({c for _, c in brute_components(texts, 5, 80).values()})


def test_lm_slices_share_no_counts(spark):
    texts = [(i, f"the cat sat on the mat and the {w} ran from the cat to a{i % 3} mat") for i, w in enumerate(("dog", "cow", "dog", "hen") * 5)]
    made = lm.tokens(spark.createDataFrame(texts, "doc_id long, text string"))
    counts = lm.word_counts(made)
    for most in (4, 1000):  # with rare words and without
        sent = spark.sparkContext.broadcast(lm.frequent(counts, most)[0])
        table = lm.materialise(lm.pair_counts(made, sent))
        keys = lambda df: [r.key for r in df.select("key").collect()]
        parts = [(False, k, 3) for k in range(3)] + [(True, 0, 1)]
        got = [set(keys(lm.counted(table, *p))) for p in parts]
        assert sorted(k for g in got for k in g) == sorted(keys(table))  # each row of the table goes to one join
        for g, p in zip(got, parts):
            met = set(keys(lm.exploded(made, sent, *p)))
            assert met & set(keys(table)) == g
    assert lm.score(spark.createDataFrame(texts, "doc_id long, text string"), 4, 3).select("doc_id", F.round("score", 9)).exceptAll(
        lm.score(spark.createDataFrame(texts, "doc_id long, text string"), 1000, 1).select("doc_id", F.round("score", 9))).count() == 0


def test_components_stop_at_stars(spark, monkeypatch):
    real, written = minhash.materialise, []
    monkeypatch.setattr(minhash, "materialise", lambda df, **o: written.append(1) or real(df, **o))
    comps = lambda pairs: {(r.node, r.comp) for r in minhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert comps([(1, 5), (1, 6), (2, 7), (3, 3)]) == {(1, 1), (5, 1), (6, 1), (2, 2), (7, 2)}
    assert len(written) == 1  # stars already: only the edges are written
    assert comps([(9, 8), (8, 7), (7, 4), (4, 5), (5, 2), (20, 21), (21, 22)]) == {(n, 2) for n in (2, 4, 5, 7, 8, 9)} | {(n, 20) for n in (20, 21, 22)}
    assert comps([]) == set()


def test_minhash_reads_few_texts_at_a_time(spark, monkeypatch):
    real, sets_of, sizes, scans = minhash.materialise, minhash._sets_of, [], []
    monkeypatch.setattr(minhash, "materialise", lambda df, **o: sizes.append(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) or real(df, **o))
    monkeypatch.setattr(minhash, "_sets_of", lambda *a: scans.append(1) or sets_of(*a))
    base = [f"w{i}" for i in range(40)]
    texts = [(i, " ".join(base[:39] + [f"x{i}"])) for i in range(30)] + [(100, "alone in the world"), (101, None)]
    got = minhash.links(spark.createDataFrame(texts, "doc_id long, text string"), 2, 80)
    assert set(sizes[:5]) == {str(minhash.SET_BATCH)}  # texts and signatures are described in small batches too
    assert len(scans) == 2  # both sides of the hub round in one scan, the cells in another
    assert {r.node for r in minhash.components(got[2]).collect()} == {r.node for r in got[1].where("doc < 30").collect()}


def test_minhash_odd_rows(spark):
    got = minhash.classes_of(odd_docs(spark), 2, 80).collect()
    assert len(got) == 9
    by = {r.doc_id: r for r in got}
    assert by[6].component_id == 5 and not by[6].kept and by[5].kept and by[1].n_shingles == 0 and by[1].kept and by[4].n_shingles == 1
    assert minhash.classes_of(empty_docs(spark), 2, 80).count() == 0


def test_posterior_bound():
    looks = [20, 130]
    assert [m / n for m, n in zip(minhash.least_matches(0.8, looks), looks)] == pytest.approx([0.35, 0.63], abs=0.06)


# decontamination


def test_decontamination_against_brute_force(spark):
    rng = random.Random(2)
    words = "a b c d e".split()
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 5, 12, 13, 14, 20])))) for i in range(30)] + [(90, None), (3, "x y z")]
    items = [(i, t) for i, t in items if t is None or len(t.split()) != 1]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), "s") for i in range(60)] + [(70, items[5][1] + " Q! " + (items[7][1] or ""), "s"), (71, None, "s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for chunk in (1000, 7):
        got = {r.doc_id: r for r in decontaminate.judge(docs_of(spark, rows), bench, chunk=chunk).collect()}
        for i, t, _ in rows:
            w = alnum_words(t)
            hit, who = brute_hits(w, items)
            assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].contaminated) == (len(w), hit, len(who), hit > 0 and 20 * hit >= len(w)), (i, chunk)
    assert len(decontaminate.judge(odd_docs(spark), bench).collect()) == 9
    assert decontaminate.judge(empty_docs(spark), bench).count() == 0
    assert not any(r.n_hit for r in decontaminate.judge(odd_docs(spark), bench.limit(0)).collect())
    marked = odd_docs(spark).withColumns({"__row": F.lit(1), "__n_words": F.lit(2), "_spans": F.lit("x")})
    for chunk in (1000, 7):
        judged, mark = decontaminate._judged(marked, bench, 13, chunk)
        assert judged.count() == 9 and judged.columns[: len(marked.columns)] == marked.columns and mark == "___"
    clean = decontaminate.clean_documents(odd_docs(spark), bench)
    assert clean.columns == odd_docs(spark).columns and clean.where("n_words = 9").count() == clean.count()


def test_decontamination_takes_items_without_id(spark):
    items = [(None, "alpha beta gamma"), (None, "delta epsilon"), (7, "zeta eta"), (7, None)]
    rows = [(1, "x alpha beta gamma y delta epsilon", "s"), (2, "zeta eta alpha beta gamma", "s"), (3, "zeta eta", "s"), (4, "none", "s")]
    docs, bench = docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    con.execute("create table documents as select * from (values " + ", ".join(f"({i}, '{t}')" for i, t, _ in rows) + ") d(doc_id, text)")
    con.execute("create table benchmark as select * from (values (null, 'alpha beta gamma'), (null, 'delta epsilon'), (7, 'zeta eta'), (7, null)) b(item_id, text)")
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = sorted(con.execute(f"select {', '.join(names)} from ({queries.ORACLES['op7_decontaminate']})").fetchall())
    for chunk in (1000, 1):
        assert sorted(map(tuple, decontaminate.judge(docs, bench, chunk=chunk).select(*names).collect())) == want
    assert [r[2:4] for r in want] == [(5, 1), (5, 2), (2, 1), (0, 0)]


# substring dedup


def test_sentences_join_to_the_text():
    for t in ("A b. C d!  E?\nF\n\n\nG h", "x" * 500 + " y. z", "\n\n a", " ".join("w" for _ in range(100)), "Mr. X. went", ""):
        assert "".join(substrings.sentences(t)) == t


def test_cuts_follow_the_rule():
    """Texts cut together, in arrays, against one text's places one after another; runs against their words."""
    rng = random.Random(4)
    some = lambda: "".join(rng.choice(["a", "b ", "c. ", "\n", "d! ", "e  ", "\u00e9 ", "| \n"]) for _ in range(rng.randint(0, 150)))
    texts = ["", None, "  ", " a", " \n a b\n", "a\vb.\fc d", " ".join(["x"] * 100), *(some() for _ in range(200))]
    made = substrings.Cut(texts)
    for k, t in enumerate(texts):
        alone, words = substrings.Cut([t]), re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", t or "")
        v = alone._values((t or "").encode().lower() + b"\n").tolist()
        assert [x >> 63 == 0 for x in v[1:]] == ["\n" in w or w.split()[0][-1] in ".!?" for w in words[:-1]]
        cuts, last = [], 0
        for p in [*range(4, len(v) - 3), len(v)]:
            if p < len(v) and not (v[p] < min(v[p - 3 : p]) and v[p] <= min(v[p : p + 4])):
                continue
            while p - last > 8:
                last = min(range(last + 4, min(last + 8, p - 4) + 1), key=v.__getitem__)
                cuts.append(last)
            if p < len(v):
                cuts.append(p)
                last = p
        assert (made.start[made.whose == k] - made.first[k]).tolist() == ([0, *cuts] if words else []), t
        assert made.strings(k, t or "") == substrings.sentences(t or "")
    hashes = {}
    for k, i, h in zip(*(x.tolist() for x in made.runs(3, 12))):
        words = tuple("".join(made.strings(k, texts[k])[i : i + 3]).encode().lower().split())
        assert len(words) >= 12 and hashes.setdefault(h, words) == words
    assert len(set(hashes.values())) == len(hashes) > 100


def test_substring_slices_are_small():
    """A batch is cut a MB of text at a time, whatever its size."""
    b = pa.RecordBatch.from_pydict({"text": ["word " * 2000] * 1000 + [None]})
    parts = list(substrings._slices(b))
    assert sum(x.num_rows for x in parts) == 1001 and max(x.num_rows for x in parts) <= 105


def test_substring_dedup_removes_later_copies(spark):
    passage = "One two three four five six. Seven eight nine ten eleven twelve. Thirteen fourteen fifteen sixteen seventeen. Alpha beta gamma delta epsilon zeta eta."
    rows = [(1, f"Start of the first. {passage} End of the first.", "s"), (2, f"Other words open this one. {passage} And others close it.", "s"), (3, "Nothing shared at all here. Truly nothing. Nor there.", "s"), (4, passage, "s")]
    got = {r.doc_id: r for r in substrings.dedup(docs_of(spark, rows)).collect()}
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1]
    assert got[2].text == "Other words open this one. And others close it." and got[2].n_removed == 4
    assert got[4].text == ""
    odd = substrings.dedup(odd_docs(spark)).collect()
    assert len(odd) == 9 and sum(r.text is None for r in odd) == 1
    assert substrings.dedup(empty_docs(spark)).count() == 0
    assert substrings.clean_documents(odd_docs(spark)).columns == odd_docs(spark).columns
    clash = odd_docs(spark).withColumns({c: F.lit(7) for c in ("own_th", "th", "cut_doc", "cut", "n_removed", "__kept_n_removed")})
    cleaned = substrings.clean_documents(clash)
    assert cleaned.columns == clash.columns and {r.n_removed for r in cleaned.collect()} == {7}
    assert {r.n_removed for r in substrings.dedup(clash).collect()} != {7}


def test_substring_dedup_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    seen, want = {}, {}
    for i, t in sorted(docs):
        pieces = substrings.sentences(t or "")
        gone = set()
        clean = [p.encode().lower().split() for p in pieces]
        for k in range(len(pieces) - 2):
            run = clean[k : k + 3]
            if all(run) and sum(map(len, run)) >= 12:
                key = b" ".join(w for s in run for w in s)
                if seen.setdefault(key, (i, k)) != (i, k):
                    gone |= {k, k + 1, k + 2}
        want[i] = "".join(p for k, p in enumerate(pieces) if k not in gone)
    got = {r.doc_id: r.text for r in queries.op8_substrings(spark, sf).collect()}
    assert got == want and any(want[i] != t for i, t in docs)


def test_substring_dedup_finds_passages_at_any_offset(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(2000)]
    some = lambda n, stop: " ".join(rng.choice(words) + (". " if stop and rng.random() < 0.08 else "") for _ in range(n))
    rows, passages = [], []
    for k in range(60):
        stop = k % 2 == 1
        passages.append(some(51 + k % 3 * 15, stop).split())
        for j in range(2):
            rows.append((1000 * j + k, f"{some(rng.randint(1, 60), stop)} {' '.join(passages[k])} {some(rng.randint(1, 60), stop)}", "s"))
    got = {r.doc_id: r.text for r in substrings.dedup(docs_of(spark, rows)).collect()}
    for k, p in enumerate(passages):
        assert got[k] == rows[2 * k][1]
        left = sum(w.rstrip(".") in {x.rstrip(".") for x in p} for w in got[1000 + k].split())
        assert left <= len(p) // 2, (k, left)


def test_substring_dedup_joins_short_sentences(spark):
    short = " ".join(f"Word{i}{'' if i % 5 == 4 else '.'}" for i in range(60))
    rows = [(1, f"This is the first. {short} Its end is here.", "s"), (2, f"That other one. {short} And there it stops.", "s")]
    for per_part in (substrings.CHARS_PER_PART, 20):
        assert substrings.repeated_runs(docs_of(spark, rows), chars_per_part=per_part).count() == 1
    got = {r.doc_id: r.text for r in substrings.dedup(docs_of(spark, rows)).collect()}
    assert got[1] == rows[0][1] and len(got[2].split()) <= 7 + 30
    assert substrings.dedup(docs_of(spark, rows).withColumn("doc_id", F.concat(F.lit("id"), "doc_id"))).where("n_removed > 0").count() == 1


# quality rules


def test_base_counts_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(900, None), (901, ""), (902, "a b c d e a b c d e"), (903, "x\nx\n \n \nx y"), (904, "a a a a a a a"), (905, "#$ é\u00a0ö & <|>")]
    got = {r.doc_id: r for r in rules.judge(docs_of(spark, [(i, t, "s") for i, t in rows])).collect()}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        wins = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = {j for k in range(len(w) - 4) if wins[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        failed = len(w) < 10 or 100 * len(rep) > 20 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep), failed), i
        assert not (r.kept and failed)
    assert rules.judge(empty_docs(spark)).count() == 0 and rules.judge(odd_docs(spark)).count() == 9


def vote_by_hand(t):
    """Votes of one text by plain Python."""
    w, lines = (t or "").encode().split(), [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    w = [x.decode() for x in w]
    n, chars = len(w), sum(map(len, w))
    letters, caps = sum(c.isalpha() for c in t or ""), sum(c.isupper() for c in t or "")
    wins = collections.Counter(tuple(w[k : k + 5]) for k in range(n - 4))
    rep = len({j for k in range(n - 4) if wins[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)})
    share = lambda a, b: a / max(b, 1)
    vote = lambda bad, good: -1 if bad else 1 if good else 0
    sym, let, cap, end = share(sum((t or "").count(c) for c in "#*$%&|<>"), chars), share(letters, chars), share(caps, letters), share(sum((t or "").count(c) for c in ".!?"), n)
    mean, dup, var, rep = share(chars, n), share(len(lines) - len(set(lines)), len(lines)), len(set(w)) / max(n**0.85, 1), share(rep, n)
    return (
        vote(n < 10, n >= 50), vote(sym > 0.03, sym < 0.002), vote(let < 0.88, let > 0.94), vote(mean < 3.5 or mean > 7, 4 <= mean <= 6.3), vote(cap > 0.3, cap < 0.06),
        vote(end > 0.5, end < 0.25), vote(rep > 0.2, rep <= 0.02), vote(dup > 0.3, dup <= 0.05), vote(var < 0.6 and n >= 20, var >= 1.2),
    )


def test_posterior_against_brute_force(spark, sf):
    """EM once more, over documents one by one with numpy."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    v = np.array([vote_by_hand(t) for t in texts.values()]) + 1
    names = list(rules.votes())
    t = np.array([[rules.IN_GOOD] * 9] + [[rules.AT_HOME if r in f else rules.ELSEWHERE for r in names] for f in rules.FAMILIES.values()])
    pi = np.array([0.85, 0.05, 0.05, 0.05])
    of = lambda: np.log(pi)[:, None] + sum(np.log(t[:, j, v[:, j]]) for j in range(9))
    for _ in range(200):
        p = np.exp(of() - of().max(0))
        p /= p.sum(0)
        t = np.stack([np.stack([1 + p[:, v[:, j] == x].sum(1) for x in range(3)], 1) for j in range(9)], 1)
        t /= t.sum(2, keepdims=True)
        before, pi = pi, (p.sum(1) + 1) / (v.shape[0] + 4)
        if abs(pi - before).max() < 1e-9:
            break
    p = np.exp(of() - of().max(0))
    want = dict(zip(texts, p[0] / p.sum(0)))
    got = {r.doc_id: r for r in rules.judge(docs_of(spark, [(i, x, "s") for i, x in texts.items()])).collect()}
    assert all(got[i].posterior == pytest.approx(want[i], abs=1e-6) for i in texts)
    assert all(got[i].kept == (not got[i].base_failed and want[i] >= 0.5) for i in texts if abs(want[i] - 0.5) > 1e-6)


def test_em_finds_planted_accuracies():
    rng = np.random.default_rng(4)
    names = [f"r{j}" for j in range(6)]
    families = {"a": ("r0", "r1", "r2"), "b": ("r3", "r4", "r5")}
    good, home, away = (0.04, 0.26, 0.7), (0.8, 0.15, 0.05), (0.06, 0.44, 0.5)
    kind = rng.choice(3, 20_000, p=[0.8, 0.12, 0.08])
    planted = np.array([[good] * 6, [home] * 3 + [away] * 3, [away] * 3 + [home] * 3])
    draw = rng.random((len(kind), 6, 1))
    votes = (draw > planted[kind].cumsum(2)[:, :, :2]).sum(2) - 1
    patterns = collections.Counter(tuple(map(int, r)) for r in votes)
    weights, tables = rules.estimate(sorted(patterns.items()), names, families)
    assert weights == pytest.approx([0.8, 0.12, 0.08], abs=0.015)
    assert np.abs(np.array(tables) - planted).max() < 0.05
    assert rules.estimate([], names, families)[0] == pytest.approx([0.85, 0.075, 0.075])


def test_one_bad_vote_is_outvoted(spark, sf):
    rows = [(r.doc_id, r.text, "s") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(10_000 + i, t + "\n" + "\n".join(["One more line of it."] * k), "s") for k in (1,) for i, (_, t, _) in enumerate(rows) if t and len(t.split()) > 100][:40]
    got = {r.doc_id: r for r in rules.judge(docs_of(spark, rows)).collect()}
    votes = {i: vote_by_hand(t) for i, t, _ in rows}
    one = [i for i in votes if votes[i].count(-1) == 1]
    assert any(got[i].kept for i in one)
    assert all(not got[i].kept for i in votes if votes[i].count(-1) >= 4)
    assert all(r.kept for i, r in got.items() if votes[i].count(1) == 9)


# language model


def test_backoff_against_brute_force(spark):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 80))), "s") for i in range(80)] + [(100, None, "s"), (101, "solo", "s"), (5, "v1 v2 v1 v2", "s")]
    texts = [blank_words(t) for _, t, _ in rows]
    c1, c2 = collections.Counter(w for t in texts for w in t), collections.Counter(p for t in texts for p in zip(t, t[1:]))
    n = sum(c1.values())
    want = []
    for (i, _, _), t in zip(rows, texts):
        o2, total, seen = collections.Counter(zip(t, t[1:])), 0.0, 0
        for p in zip(t, t[1:]):
            k = c2[p] - o2[p]
            seen += k > 0
            total += math.log(k / c1[p[0]]) if k else math.log(0.4 * c1[p[1]] / n)
        pairs = max(0, len(t) - 1)
        want.append((i, pairs, seen, round(total / pairs, 4) if pairs else None))
    key = lambda r: (r[0], r[1], r[2], r[3] or 0)
    docs = docs_of(spark, rows)
    for got in (lm.score(docs, slices=3), lm.score(docs, vocabulary=30), lm.score(docs, vocabulary=0)):
        assert sorted(((r.doc_id, r.n_pairs, r.n_seen, r.score and round(r.score, 4)) for r in got.collect()), key=key) == sorted(want, key=key)
    odd = sorted(((r.doc_id, r.n_pairs, r.n_seen) for r in lm.score(odd_docs(spark)).collect()), key=str)
    assert odd == sorted([(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 0, 0), (5, 3, 3), (5, 3, 3), (6, 3, 3), (None, 3, 0), (7, 29_999, 0)], key=str)
    assert lm.score(empty_docs(spark)).count() == 0
    named = docs.select(F.concat(F.lit("id"), "doc_id").alias("doc_id"), "text")
    assert {r.doc_id for r in lm.score(named).collect()} == {f"id{i}" for i, _, _ in rows}


def test_backoff_counts_a_pair_in_full(spark):
    n = 70_000
    docs = docs_of(spark, [(1, "a " * (n + 1), "s"), (2, "a a", "s")])
    got = {r.doc_id: (r.n_pairs, r.n_seen, r.score) for r in lm.score(docs).collect()}
    assert got[1][:2] == (n, n) and got[1][2] == pytest.approx(math.log(1 / (n + 3)), abs=1e-4)
    assert got[2][:2] == (1, 1) and got[2][2] == pytest.approx(math.log(n / (n + 3)), abs=1e-4)


# queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, sf).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda d: sorted(map(str, d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_places_of_words_and_pairs_by_number():
    """Bucketed search against a binary one; pairs numbered with their text against counting by hand."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 1000):
        known = np.unique(rng.integers(0, 2**64, n, np.uint64))
        if n == 1000:
            known = np.unique(np.r_[known, known[500] + np.arange(40, dtype=np.uint64), np.uint64(0), np.uint64(2**64 - 1)])
        w = np.r_[known, known + np.uint64(1), rng.integers(0, 2**64, 500, np.uint64)]
        at = lm._places(known, w)
        inside = np.isin(w, known)
        assert (known[at][inside] == w[inside]).all() and (known[at][~inside] != w[~inside]).all()
