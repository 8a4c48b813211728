"""The pipeline against its stages on small tables."""

import pytest

pytest.importorskip("tessera.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

import collections

from tessera.llm import mixing, substrings, toxicity
from tessera.llm.common import alnum_words
from tests_llm_helpers import brute_components, brute_hits


def uncut(rows):
    """Texts without later copies of runs of pieces, by (id, text) rows in order."""
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        pieces = substrings.sentences(t or "")
        gone, clean = set(), [p.encode().lower().split() for p in pieces]
        for k in range(len(pieces) - 2):
            run = clean[k : k + 3]
            if all(run) and sum(map(len, run)) >= 12 and seen.setdefault(b" ".join(w for s in run for w in s), (i, k)) != (i, k):
                gone |= {k, k + 1, k + 2}
        out[i] = "".join(p for k, p in enumerate(pieces) if k not in gone) if t is not None else None
    return out


def test_stages_take_effect_and_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == names and set(after) <= set(before), name
        if name == "toxicity":
            model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
            scored = {r.doc_id: r.predicted for r in toxicity.score(spark.read.parquet(f"{sf}/documents.parquet"), model).collect()}
            assert set(after) == {i for i, p in scored.items() if not p} and all(after[i] == before[i] for i in after)
        elif name == "substring_dedup":
            assert after == uncut(before.items())
        elif name == "near_dedup":
            comps = brute_components(list(before.items()), 5, 80)
            assert set(after) == {i for i, (_, c) in comps.items() if c == i}
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            clean = set()
            for i, t in before.items():
                hit, _ = brute_hits(alnum_words(t), items)
                if not (hit and 20 * hit >= len(alnum_words(t))):
                    clean.add(i)
            assert set(after) == clean
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    size = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    assert {r.doc_id: r["size"] for r in last} == size and all(0 <= r.taken <= 3 * r["size"] for r in last)
    # words taken, from the slots' blocks and the documents' places in their streams
    placed, sources = mixing.blocks_of(docs)
    times = collections.Counter((r.no_source, r.source, r.block) for r in mixing.slots_of(sources).collect())
    want = collections.Counter()
    for r in placed.collect():
        for w in range(r.off, r.off + r["size"]):
            want[r.doc_id] += times[r.no_source, r.source, w // mixing.BLOCK_WORDS]
    assert {r.doc_id: r.taken for r in last} == {i: want[i] for i in size}


def test_stages_take_odd_rows(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, cut string, __row int"
    long_text = " ".join(f"word{i % 977} item{i % 1013}." for i in range(4_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n ", None), (4, "one", "b"), (5, "same words here now", "b"), (5, "same words here now", "b"), (None, "no id at all", "c"), (7, long_text, "c"), (8, long_text, "c")]
    docs = spark.createDataFrame([(i, t, "en", s, 0, 9.0, "c", 1) for i, t, s in rows], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert out.columns == docs.columns and {r.cut for r in out.collect()} == {"c"}
        assert out.count() == (9 if name == "toxicity" else 8)
        assert stage(spark, docs.limit(0), sf).count() == 0
        docs = out
    assert sorted((r.doc_id or -1) for r in docs.collect()) == [-1, 1, 2, 3, 4, 5, 5, 7]
    last = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()}
    assert last[1].taken == last[2].taken == last[3].taken == 0 and last[3].source is None
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0


def test_run_is_the_stages(spark, sf):
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) for _ in range(2))
    assert a == b and a
