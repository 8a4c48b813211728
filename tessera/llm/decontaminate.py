"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

A benchmark item's windows are its runs of ``window`` words, or the whole item if it has fewer. Patterns of
like length share a table: with m the least pattern length of the table, a block is the last ``2`` words (or
1 where m is 1) of the m-word prefix in view. The shift table tells for a block how far the view may move
without passing an occurrence; where the shift is 0, the block picks the bucket of patterns whose prefix
ends so, the first words pick among them, and direct comparison confirms. Every word of an occurrence is hit.

Patterns are broadcast in chunks of at most ``chunk`` windows each (a proven bound: ``chunk * window`` words);
a larger benchmark is searched chunk by chunk, and hit words and items are merged by row.

Defined cases: null or empty texts have no words, are never contaminated, and null or empty items have no
window; repeated rows are each judged; repeated items count by item_id once; items without an id
are searched like others, count as one item together and are left out of items_sha256; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import alnum_words, appended, batch, ddl, map_batches, materialise

WINDOW = 13
CHUNK = 200_000


class Table:
    """Shift table and suffix buckets of patterns no shorter than ``m`` words."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]], m: int):
        self.m, self.size = m, min(2, m)
        self.default = m - self.size + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        size = self.size
        for p, items in patterns.items():
            for q in range(size, m + 1):
                block = p[q - size : q] if size > 1 else p[q - 1]
                self.shift[block] = min(self.shift.get(block, self.default), m - q)
            last = p[m - size : m] if size > 1 else p[m - 1]
            self.bucket.setdefault(last, {}).setdefault(p[:1], []).append((p, items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int, list[str]]]:
        """(start, end, items) of every occurrence."""
        m, size, shift, default, n = self.m, self.size, self.shift, self.default, len(words)
        at = m  # the view ends before word ``at``
        while at <= n:
            block = (words[at - 2], words[at - 1]) if size > 1 else words[at - 1]
            step = shift.get(block, default)
            if step:
                at += step
                continue
            start = at - m
            for p, items in self.bucket[block].get((words[start],), ()):
                if tuple(words[start : start + len(p)]) == p:
                    yield start, start + len(p), items
            at += 1


def _in_order(items) -> list[str | None]:
    """Ids in order; the missing one comes last."""
    return sorted(items, key=lambda i: (i is None, i or ""))


def windows(items: list[tuple[object, str | None]], window: int = WINDOW) -> dict[tuple[bytes, ...], list[str]]:
    """Window -> ids of the items that have it."""
    out: dict[tuple[bytes, ...], set[str | None]] = {}
    for item_id, text in items:
        words = tuple(alnum_words(text))
        for i in range(max(1, len(words) - window + 1) if words else 0):
            out.setdefault(words[i : i + window], set()).add(None if item_id is None else str(item_id))
    return {k: _in_order(v) for k, v in out.items()}


def tables(patterns: dict[tuple[bytes, ...], list[str]], window: int = WINDOW) -> list[Table]:
    """Full windows in one table; shorter ones in tables of doubling least length, so that none slows the rest."""
    groups: dict[int, dict] = {}
    for p, items in patterns.items():
        low = window if len(p) >= window else 1 << (len(p).bit_length() - 1)
        groups.setdefault(low, {})[p] = items
    return [Table(g, m) for m, g in sorted(groups.items())]


def search(words: list[bytes], found: list[Table]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged hit intervals and the items that occur."""
    spans, items = [], set()
    for t in found:
        for a, b, who in t.search(words):
            spans.append((a, b))
            items.update(who)
    spans.sort()
    merged: list[tuple[int, int]] = []
    for a, b in spans:
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged, items


def _chunks(benchmark: DataFrame, window: int, chunk: int) -> Iterator[dict[tuple[bytes, ...], list[str]]]:
    """Windows of the benchmark, at most ``chunk`` (plus one item's) at a time."""
    part: dict[tuple[bytes, ...], list[str]] = {}
    for row in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        for p, items in windows([(row.item_id, row.text)], window).items():
            part[p] = _in_order({*part.get(p, ()), *items})
        if len(part) >= chunk:
            yield part
            part = {}
    if part:
        yield part


def _digest(n: int, spans: list[tuple[int, int]], items: set[str]) -> tuple:
    hit = sum(b - a for a, b in spans)
    return n, hit, len(items), hashlib.sha256(",".join(sorted(i for i in items if i is not None)).encode()).hexdigest(), hit > 0 and 20 * hit >= n


#: The digest's columns and their Arrow types.
_DIGEST = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_()}
_OUT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _columns(rows: list[tuple], mark: str) -> dict:
    return {mark + k: ([r[j] for r in rows], t) for j, (k, t) in enumerate(_DIGEST.items())}


def _judged(docs: DataFrame, benchmark: DataFrame, window: int, chunk: int) -> tuple[DataFrame, str]:
    """The rows of docs with the digest's columns, each with a mark before its name that no column of docs begins with; and the mark."""
    mark = "_"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    spark = docs.sparkSession
    names = docs.columns
    schema = f"{ddl(docs)}, {', '.join(mark + c for c in _OUT.split(', '))}"
    parts = _chunks(benchmark, window, chunk)
    first, second = next(parts, {}), next(parts, None)
    sent = spark.sparkContext.broadcast(first)

    def single():
        held = tables(sent.value, window)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            words = map(alnum_words, b.column("text").to_pylist())
            return appended(b, names, **_columns([_digest(len(w), *search(w, held)) for w in words], mark))

        return run

    if second is None:
        return map_batches(docs, schema, single), mark

    def occurrences(sent):
        def start():
            held = tables(sent.value, window)

            def run(b: pa.RecordBatch) -> pa.RecordBatch:
                found = [(r, *search(alnum_words(t), held)) for r, t in zip(b.column(row).to_pylist(), b.column("text").to_pylist())]
                found = [(r, [x for s in spans for x in s], _in_order(items)) for r, spans, items in found if spans]
                return batch(**{row: ([f[0] for f in found], pa.int64())}, spans=([f[1] for f in found], pa.list_(pa.int32())), items=([f[2] for f in found], pa.list_(pa.string())))

            return run

        return start

    row, spans_of, items_of = (mark + c for c in ("row", "spans", "items"))
    keyed = materialise(docs.withColumn(row, F.monotonically_increasing_id()))
    narrow, found = keyed.select(row, "text"), None
    # one chunk is held and sent at a time; each is one scan of the texts
    for part in chain((first, second), parts):
        sent = spark.sparkContext.broadcast(part)
        one = materialise(map_batches(narrow, f"{row} long, spans array<int>, items array<string>", occurrences(sent)))
        sent.destroy()
        found = one if found is None else found.unionByName(one)
    # at most one row a chunk for each document
    merged = found.groupBy(row).agg(F.flatten(F.collect_list("spans")).alias(spans_of), F.array_distinct(F.flatten(F.collect_list("items"))).alias(items_of))

    def summed():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for t, flat, items in zip(*(b.column(c).to_pylist() for c in ("text", spans_of, items_of))):
                spans: list[tuple[int, int]] = []
                for a, z in sorted(zip((flat or [])[::2], (flat or [])[1::2])):
                    if spans and a <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(z, spans[-1][1]))
                    else:
                        spans.append((a, z))
                rows.append(_digest(len(alnum_words(t)), spans, set(items or ())))
            return appended(b, names, **_columns(rows, mark))

        return run

    return map_batches(keyed.join(merged, row, "left").drop(row), schema, summed), mark


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row."""
    judged, mark = _judged(docs.select("doc_id", "text"), benchmark, window, chunk)
    return judged.select("doc_id", *(F.col(mark + c).alias(c) for c in _DIGEST))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with the columns they came with."""
    judged, mark = _judged(docs, benchmark, WINDOW, CHUNK)
    return judged.where(~F.col(f"{mark}contaminated")).select(*docs.columns)


ORACLE = r"""
with d as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
b as (
  select item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
starts as (
  select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0),
wins as (
  select distinct item_id, least(len(w), 13) as k, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') as s from starts),
lens as (select distinct k from wins),
places as (
  select r, w, k, unnest(range(1, len(w) - k + 2)) as i from d, lens where len(w) >= k),
grams as (select r, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') as s from places),
hits as (select g.r, g.i, g.k, wins.item_id from grams g join wins on wins.k = g.k and wins.s = g.s),
covered as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + k)) as p from hits) group by r),
items as (
  select r, count(*) as n_items, sha256(string_agg(item_id, ',' order by item_id)) as h
  from (select distinct r, cast(item_id as varchar) as item_id from hits) group by r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(c.n_hit, 0) as n_hit, coalesce(i.n_items, 0) as n_items,
  coalesce(i.h, sha256('')) as items_sha256,
  coalesce(c.n_hit, 0) > 0 and 20 * coalesce(c.n_hit, 0) >= len(d.w) as contaminated
from d left join covered c using (r) left join items i using (r)
"""
