"""Substring dedup: sliding sentence spans.

A text is cut into pieces of ``LEAST_PIECE`` to ``max_words`` words, at sentence ends (after ``.``, ``!`` or ``?`` before
white space, or at a line break) where they are, and else where the words say. Each place between two words has a value:
the hash of both, sentence ends before all others. A place of less value than those nearer than ``LEAST_PIECE`` words is
a cut; where that leaves a longer piece, so is the place of least value at a distance of ``LEAST_PIECE`` to
``max_words`` words from the last cut. Two copies of a passage are therefore cut alike from the first such place inside
the passage on, whatever stands round it; a sentence of fewer words than a piece goes with a neighbour. Every run of
``span`` consecutive pieces, which has ``min_words`` words, is hashed (64 bits, A-Z lower-cased, white space as one
blank). Hashes are joined globally; pieces covered by a run that occurs anywhere earlier, in (doc_id, position) order,
are removed. The rest keeps its own characters; a removed piece goes with the white space after it. At the ends of a
passage that starts or ends inside a piece, some words stay; of random passages of 51 words in other text, about
a sixth of the words.

Only a hash that occurs more than once matters. A map task packs the runs it sends to a hash range into one row of
arrays (about 16 bytes a run), where the range's repeated hashes are found; the number of ranges follows the input
(``CHARS_PER_PART``), which bounds what a task holds. Runs of repeated hashes come out as rows; their first places come
from an aggregation with map-side combine, and the optimiser may broadcast them when they are few and splits the join
when one is hot: both sides are written or shuffled for that join alone.

Defined cases: null texts stay null, empty ones empty; a null doc_id sorts first; rows that repeat doc_id and
text are one document and are treated alike; a text of fewer than ``span`` pieces or ``min_words`` words has no run; columns beside
doc_id and text pass through unchanged, whatever their names, but that ``dedup`` replaces columns named n_sentences and n_removed.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import K1, K3, batch, ddl, fresh, materialise, mix, raw_bytes, word_hashes

SPAN, MIN_WORDS, MAX_WORDS = 3, 12, 8
LEAST_PIECE = 4

#: Bytes of text that are cut at a time.
CUT_BYTES = 1 << 20
#: More than the value of any place.
_NONE = np.uint64(2**64 - 1)

_WORDS = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
CHARS_PER_PART, PACK_RUNS = 20_000_000, 1_000_000


class Cut:
    """Texts cut into pieces, and their words' hashes; all texts lie in one array of words.

    ``words`` are the words' hashes, ``first`` is the first word of every text (and the number of words, at the end), ``start`` that of
    every piece, ``whose`` the text of every piece.
    """

    def __init__(self, texts: list[str | None], most: int = MAX_WORDS):
        """texts: of some MB together."""
        low = [raw_bytes(t).lower() for t in texts]
        every = [word_hashes(t.split()) for t in low]
        self.words = np.concatenate(every) if every else np.zeros(0, np.uint64)
        self.first = np.cumsum([0, *map(len, every)])
        n = np.diff(self.first)
        value, total = self._values(b"\n".join([*low, b""])), len(self.words)
        # cuts: places of less value than those nearer than ``near``
        near = min(LEAST_PIECE, (most + 1) // 2)
        ahead = np.arange(total) - np.repeat(self.first[:-1], n)
        low_here = (ahead >= near) & (np.repeat(n, n) - ahead >= near)
        low_here[1:] &= value[1:] < value[:-1]
        for d in range(1, near):
            if d > 1:
                low_here[d:] &= value[d:] < value[:-d]
            low_here[:-d] &= value[:-d] <= value[d:]
        low_here[self.first[:-1][n > 0]] = True
        found = [np.flatnonzero(low_here)]
        # where that leaves a longer piece, the place of least value in reach of the last cut, again and again
        at, end = found[0], np.r_[found[0][1:], total]
        while len(far := np.flatnonzero(end - at > most)):
            at, end = at[far], end[far]
            reach = at[:, None] + np.arange(near, most + 1)
            at = at + near + np.where(reach <= (end - near)[:, None], value[np.minimum(reach, total - 1)], _NONE).argmin(1)
            found.append(at)
        self.start = np.sort(np.concatenate(found))
        self.whose = np.searchsorted(self.first, self.start, "right") - 1

    def _values(self, data: bytes) -> np.ndarray:
        """Of the place before each word: the hash of both words round it, sentence ends before all others, a text's first place last."""
        byte = np.frombuffer(data, np.uint8)
        white = (byte == 32) | ((byte >= 9) & (byte <= 13))
        last = np.flatnonzero(~white[:-1] & white[1:])
        after = np.r_[np.flatnonzero(white[:-1] & ~white[1:]) + 1, len(byte)]  # where words begin; with a first word at 0 it is not among them
        lines = np.r_[np.flatnonzero(byte == 10), len(byte)]
        mark = byte[last]
        ends = (mark == 46) | (mark == 33) | (mark == 63) | (lines[np.searchsorted(lines, last)] < after[np.searchsorted(after, last, "right")])
        value = np.full(len(self.words), _NONE)
        if len(value) > 1:
            value[1:] = mix(self.words[:-1] * K1 + self.words[1:] * K3) >> np.uint64(1)
            value[1:] |= (~ends[:-1]).astype(np.uint64) << np.uint64(63)
        value[self.first[:-1][np.diff(self.first) > 0]] = _NONE
        return value

    def runs(self, span: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first piece, hash) of every run of ``span`` pieces with ``min_words`` words."""
        end = np.r_[self.start[1:], len(self.words)]
        i = np.arange(max(0, len(self.start) - span + 1))
        i = i[(self.whose[i] == self.whose[i + span - 1]) & (end[i + span - 1] - self.start[i] >= min_words)]
        begin, size = self.start[i], end[i + span - 1] - self.start[i]
        h = np.zeros(len(i), np.uint64)
        for k in range(int(size.max(initial=0))):
            on = np.flatnonzero(size > k)
            h[on] = mix(h[on] * K1 + self.words[begin[on] + k] * K3)
        return self.whose[i], i - np.searchsorted(self.whose, self.whose[i]), h

    def counts(self) -> np.ndarray:
        """Pieces of every text."""
        return np.bincount(self.whose, minlength=len(self.first) - 1)

    def strings(self, k: int, text: str) -> list[str]:
        """The pieces of text k; joined they are the text again."""
        whole = _WORDS.findall(text)
        if not whole:
            return [text] if text else []
        a, b = np.searchsorted(self.whose, [k, k + 1])
        cuts = (self.start[a:b] - self.first[k]).tolist()
        whole[0] = text[: len(text) - sum(map(len, whole))] + whole[0]
        return ["".join(whole[x:y]) for x, y in zip(cuts, [*cuts[1:], len(whole)])]


def sentences(text: str, max_words: int = MAX_WORDS) -> list[str]:
    """The text cut into pieces; joined they are the text again."""
    return Cut([text], max_words).strings(0, text)


def _slices(b: pa.RecordBatch):
    """Parts of a batch with about CUT_BYTES of text."""
    per = max(1, CUT_BYTES * b.num_rows // max(b.column("text").nbytes, 1))
    for k in range(0, b.num_rows, per):
        yield b.slice(k, per)


_PACK = "part long, h binary, doc binary, at binary, ids binary"


def _packed(batches, parts: int, span: int, min_words: int, max_words: int):
    """Batches of (doc_id, th, text) -> rows of packed runs by hash range."""
    pend, docs, held, before = [], [], 0, 0

    def flush() -> pa.RecordBatch:
        doc, at, h = (np.concatenate(x) for x in zip(*pend))
        order = np.argsort(h)
        h, doc, at = (x[order] for x in (h, doc, at))
        part = (h >> np.uint64(33)).astype(np.int64) * parts >> 31  # ascends with the hash
        ids = pa.Table.from_batches(docs).combine_chunks()
        out = []
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
        for a, b in zip(starts, [*starts[1:], len(part)]):
            used, back = np.unique(doc[a:b], return_inverse=True)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, ids.schema) as w:
                w.write_table(ids.take(pa.array(used)))
            out.append((int(part[a]), h[a:b].tobytes(), back.astype(np.uint32).tobytes(), at[a:b].tobytes(), sink.getvalue().to_pybytes()))
        blobs = {name: ([r[k + 1] for r in out], pa.binary()) for k, name in enumerate(("h", "doc", "at", "ids"))}
        return batch(part=([r[0] for r in out], pa.int64()), **blobs)

    for b in batches:
        for part in _slices(b):
            doc, at, h = Cut(part.column("text").to_pylist(), max_words).runs(span, min_words)
            pend.append((doc.astype(np.uint32) + np.uint32(before), at.astype(np.int32), h))
            # copied, or else they hold the batch and its texts
            docs.append(part.select(["doc_id", "th"]).take(pa.array(np.arange(part.num_rows))))
            before += part.num_rows
            held += len(h)
            if held >= PACK_RUNS:
                yield flush()
                pend, docs, held, before = [], [], 0, 0
    if held:
        yield flush()


def _repeated(batches):
    """Packed rows sorted by part -> (doc_id, th, at, h) of the runs whose hash occurs more than once."""
    part, packs = None, []

    def finish():
        keys = [np.frombuffer(p[0], np.uint64) for p in packs]
        _, back, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        begin = 0
        for (_, doc, at, ids), h in zip(packs, keys):
            keep = np.flatnonzero(times[back[begin : begin + len(h)]] > 1)
            begin += len(h)
            whose = pa.ipc.open_stream(ids).read_all().combine_chunks().take(pa.array(np.frombuffer(doc, np.uint32)[keep]))
            if len(keep):
                yield batch(**{c: whose.column(c).combine_chunks() for c in ("doc_id", "th")}, at=(np.frombuffer(at, np.int32)[keep], pa.int32()), h=(h[keep].view(np.int64), pa.int64()))

    for b in batches:
        for where, *pack in zip(*(b.column(c).to_pylist() for c in ("part", "h", "doc", "at", "ids"))):
            if where != part:
                if packs:
                    yield from finish()
                part, packs = where, []
            packs.append(pack)
    if packs:
        yield from finish()


def repeated_runs(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS, chars_per_part: int = CHARS_PER_PART) -> DataFrame:
    """(doc_id, th, cut): by document, the first pieces of its non-first runs; th is the hash of its text."""
    narrow = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").where("text is not null")
    parts = 1 + (narrow.agg(F.sum(F.length("text"))).first()[0] or 0) // chars_per_part
    packed = narrow.mapInArrow(lambda batches: _packed(batches, parts, span, min_words, max_words), _PACK)
    runs = materialise(packed.repartition("part").sortWithinPartitions("part").mapInArrow(_repeated, f"{ddl(narrow.select('doc_id'))}, th long, at int, h long"))
    place = F.struct("doc_id", "th", "at")
    firsts = materialise(runs.groupBy("h").agg(F.min(place).alias("first")))
    late = runs.join(firsts, "h").where(place != F.col("first"))
    return late.groupBy("doc_id", "th").agg(F.collect_set("at").alias("cut"))


def dedup(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS) -> DataFrame:
    """Every row of docs with its repeated sentences removed from text; two columns more: n_sentences, n_removed."""
    cuts = repeated_runs(docs, span, min_words, max_words)
    names = [c for c in docs.columns if c not in {"n_sentences", "n_removed"}]
    own, theirs, doc, at = fresh(docs, "own_th", "th", "cut_doc", "cut")
    keyed = docs.select(*names).withColumn(own, F.xxhash64("text"))
    cuts = cuts.select(F.col("doc_id").alias(doc), F.col("th").alias(theirs), F.col("cut").alias(at))
    joined = keyed.join(cuts, (F.col(own) == F.col(theirs)) & F.col("doc_id").eqNullSafe(F.col(doc)), "left").drop(own, doc, theirs)

    def run(batches):
        for b in (part for whole in batches for part in _slices(whole)):
            texts, removed = b.column("text").to_pylist(), []
            made = Cut(texts, max_words)
            # a text of blanks alone is one piece
            total = [int(n) if n or not t else 1 for n, t in zip(made.counts(), texts)]
            for k, cut in enumerate(b.column(at).to_pylist()):
                gone = {j for i in cut or () for j in range(i, i + span)}
                if gone:
                    texts[k] = "".join(p for j, p in enumerate(made.strings(k, texts[k])) if j not in gone)
                removed.append(len(gone))
            new = {n: (texts, pa.string()) if n == "text" else b.column(n) for n in names}
            yield batch(**new, n_sentences=(total, pa.int32()), n_removed=(removed, pa.int32()))

    return joined.mapInArrow(run, f"{ddl(docs.select(*names))}, n_sentences int, n_removed int")


def clean_documents(docs: DataFrame) -> DataFrame:
    """Every document with its repeated sentences removed, with the columns it came with."""
    clash = dict(zip(found := [c for c in docs.columns if c in {"n_sentences", "n_removed"}], fresh(docs, *found)))
    out = dedup(docs.withColumnsRenamed(clash)).drop("n_sentences", "n_removed")
    return out.withColumnsRenamed({v: k for k, v in clash.items()}).select(*docs.columns)
