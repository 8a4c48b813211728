"""MinHash near-dedup with sequential Bayesian verification.

Texts with equal shingle sets form a class (``node``). Class signatures are cut into bands;
classes with an equal band are candidates. A candidate pair's signatures are compared batch by batch, and the pair
is dropped as soon as the posterior probability (uniform prior) of a similarity at or above the threshold falls
under ``miss``; survivors are verified on their full shingle sets. Confirmed links are closed to components by
large-star and small-star steps.

No bucket is expanded into its pairs. First every class meets one hub, the least class of the buckets it
shares most (in two bands or more): their signatures are compared batch by batch and survivors verified, which joins nearly all of a large
group; a hub with many classes is copied to as many salted keys as they need. What is then left in a bucket with classes of several
components is compared in cells of bounded size: rows outside the bucket's largest component against each
other and against that component, never that component against itself. A pair counts in the first band it
shares. Classes with a pair that survives the posterior bound go to their cells once more with their full sets,
where surviving pairs not yet joined are verified exactly; a cell returns a forest of confirmed links, fewer
than it has rows. So no link between components is given up but by the banding and the posterior bound, whose
miss probabilities are parameters.

Defined cases: null, empty and word-less texts have no shingles and link with nothing; a text of fewer words
than a shingle is one shingle; rows that repeat a doc_id are each classed by their own text, whatever other texts
have that id; rows with a null doc_id take no part and get a null component; ids may have any type with an order;
an empty table gives no rows; other columns are passed over, whatever their names. Shingles are compared by 48 bits of a
64-bit hash: two different ones pass for the same with probability 4e-15.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import K1, K3, batch, blank_words, ddl, discard, map_batches, materialise, mix, settings, word_hashes

#: At similarity 0.8 a pair shares no band with probability (1 - 0.8 ** 5) ** 26 = 3e-5.
BANDS, ROWS = 26, 5
HASHES = BANDS * ROWS
#: Chosen miss probability of each look at a pair's signatures.
MISS = 1e-5
#: Rows of a cell's side.
CELL = 512
#: Rows of an Arrow batch: rows carry texts or shingle sets.
SET_BATCH = 500
#: Classes that one copy of a hub meets.
HUB_ROWS = 2048
#: Most bits of the filter that picks texts to read again (16 MB); it has 16 a class, or these.
FILTER_BITS = 1 << 27

_SEEDS = np.random.default_rng(20_240_607)
_XOR = _SEEDS.integers(0, 1 << 32, (HASHES, 1), dtype=np.uint32)
_MUL = _SEEDS.integers(0, 1 << 31, (HASHES, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``size`` words, or of the whole sequence if it is shorter."""
    n = len(words)
    if not n:
        return words
    run = min(size, n)
    h = words[: n - run + 1].copy()
    for k in range(1, run):
        h = mix(h * K1 + words[k : n - run + 1 + k] * K3)
    return np.unique(mix(h + np.uint64(run)))


def packed(found: np.ndarray) -> bytes:
    """A sorted set as 6 bytes a shingle: its upper 48 bits, in order."""
    return np.ascontiguousarray((found >> np.uint64(16)).astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def signature(found: np.ndarray) -> np.ndarray:
    """Least value of each hash function over the shingles."""
    low = (found & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 2048):
        np.minimum(out, ((low[None, k : k + 2048] ^ _XOR) * _MUL).min(1), out=out)
    return out


def least_matches(threshold: float, looks: list[int], miss: float = MISS) -> list[int]:
    """By number of hashes looked at, the fewest matches that leave P(J >= threshold) at ``miss`` or more.

    With a uniform prior P(J >= t | m of n) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in looks:
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
        out.append(m)
    return out


class Looks:
    """Sequential comparison of one signature with many, or of pairs row by row."""

    def __init__(self, threshold: float):
        self.ends = list(range(ROWS * 4, HASHES, ROWS * 4)) + [HASHES]
        self.least = least_matches(threshold, self.ends)

    def matches(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Matches of every surviving row of b, -1 for the pruned; a is one signature or as many as b has."""
        out = np.full(len(b), -1)
        alive = np.arange(len(b))
        seen = np.zeros(len(b), int)
        begin = 0
        for end, least in zip(self.ends, self.least):
            left = a[begin:end] if a.ndim == 1 else a[alive, begin:end]
            seen = seen + (left == b[alive, begin:end]).sum(1)
            ok = seen >= least
            alive, seen, begin = alive[ok], seen[ok], end
            if not len(alive):
                return out
        out[alive] = seen
        return out


def _signatures(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(-1, HASHES)


def _described(size: int):
    def start():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            n, sid, sig = [], [], []
            for t in b.column("text").to_pylist():
                s = shingles(word_hashes(blank_words(t)), size)
                n.append(len(s))
                sid.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
            return batch(doc_id=b.column("doc_id"), n=(n, pa.int64()), sid=(sid, pa.binary()), sig=(sig, pa.binary()))

        return run

    return start


def _band_keys(sig: np.ndarray) -> np.ndarray:
    """Bucket key of every band, by row."""
    parts = sig.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * K3, parts.shape[:2]).copy()
    for k in range(ROWS):
        key = mix(key * K1 + parts[:, :, k])
    return key.view(np.int64)


def _banded():
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        key = _band_keys(_signatures(b.column("sig")))
        take = pa.array(np.repeat(np.arange(b.num_rows), BANDS))
        return batch(key=(key.ravel(), pa.int64()), node=b.column("node").take(take))

    return run


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= percent * (len(x) + len(y) - inter)


def _verified(percent: int):
    """Pairs with 100 * intersection >= percent * union on their full sets."""

    def start():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            ok = [_similar(unpacked(x), unpacked(y), percent) for x, y in zip(b.column("ha").to_pylist(), b.column("hb").to_pylist())]
            kept = b.filter(pa.array(ok, pa.bool_()))
            return batch(a=kept.column("a"), b=kept.column("b"))

        return run

    return start


def _likely(threshold: float):
    """Pairs with signatures -> those that the posterior bound leaves."""

    def start():
        looks = Looks(threshold)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            kept = b.filter(pa.array(looks.matches(_signatures(b.column("sa")), _signatures(b.column("sb"))) >= 0))
            return batch(**{c: kept.column(c) for c in ("a", "b", "sid_a", "sid_b", "at_a", "at_b")})

        return run

    return start


def _salted(pairs: DataFrame, hubs: DataFrame, hot: DataFrame, on: str) -> DataFrame:
    """Pairs joined to their hubs' rows by ``on`` and salt: a hub of the (small) table hot, with salts, is copied that many times."""
    salts = F.coalesce("salts", F.lit(1))
    dealt = pairs.join(hot, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), salts)).drop("salts")
    copies = hubs.join(hot, "a", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts.cast("long") - 1))).drop("salts", "a")
    return dealt.join(copies, [on, "salt"]).drop("salt")


def _sets_of(docs: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """(sid, hub, hashes) of the classes asked for by (sid, at, hub), where at is the hash of the class's document; the texts are shingled again.

    A filter over the classes' documents, of bounded size and set on the executors, spares the other texts.
    """
    bits = 1 << min(FILTER_BITS.bit_length() - 1, max(16, (16 * asked.count()).bit_length()))
    at = asked.select(F.pmod("at", F.lit(bits)).alias("p"))
    words = at.groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v")).toArrow()
    held = np.zeros(bits // 64, np.int64)
    held[words.column("w").to_numpy()] = words.column("v").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(held)

    def start():
        bits = sent.value

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            p = b.column("p").to_numpy()
            b = b.filter(pa.array((bits[p >> 6] >> (p & 63)) & 1 == 1))
            sets = [x for x in (shingles(word_hashes(blank_words(t)), size) for t in b.column("text").to_pylist()) if len(x)]
            return batch(sid=([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), hashes=([packed(x) for x in sets], pa.binary()))

        return run

    narrow = docs.where("doc_id is not null").select("text", F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("p"))
    sids = asked.groupBy("sid").agg(F.max("hub").alias("hub"))
    return map_batches(narrow, "sid binary, hashes binary", start).join(sids, "sid").groupBy("sid").agg(F.max("hub").alias("hub"), F.min("hashes").alias("hashes"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u of the edges (u, v), u > v, hangs on one v, which hangs on none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").count()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of the edges (a, b): comp is the least node reachable. Large-star and small-star until only stars are left."""
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    while not _are_stars(now):
        # large star: every larger neighbour of u hangs on u's least neighbour
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        now = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: u and its smaller neighbours hang on the least of them
        low = now.groupBy("u").agg(F.min("v").alias("m"))
        hung = now.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = materialise(hung.where("u != v").distinct())
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return stars.unionByName(stars.select(F.col("comp").alias("node"), "comp").distinct())


def _cells(rows: DataFrame) -> DataFrame:
    """Bucket rows (key, node, comp) of several components, dealt to cells (key, i, j) of bounded size.

    side 1: outside the bucket's largest component, 0: in it. Side 1 meets itself in cells (i, j), i <= j,
    and side 0 in cells (i, -1 - j).
    """
    sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
    of_key = sizes.groupBy("key").agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("comps"))
    of_key = materialise(of_key.where("comps > 1"))
    rows = rows.join(of_key, "key").withColumn("side", F.when(F.col("comp") == F.col("main"), 0).otherwise(1))
    ones = F.ceil((F.col("all") - F.col("most")) / CELL).cast("long")
    zeros = F.ceil(F.col("most") / CELL).cast("long")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("side") == 1, ones).otherwise(zeros))
    rows = rows.withColumn("own", own)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    with_ones = F.transform(upto(ones), lambda k: F.struct(F.least(F.col("own"), k).alias("i"), F.greatest(F.col("own"), k).alias("j")))
    with_zeros = F.transform(upto(zeros), lambda k: F.struct(F.col("own").alias("i"), (-1 - k).alias("j")))
    mine = F.transform(upto(ones), lambda k: F.struct(k.alias("i"), (-1 - F.col("own")).alias("j")))
    cell = F.when(F.col("side") == 1, F.concat(with_ones, with_zeros)).otherwise(mine)
    return rows.select("key", "node", "comp", "side", "own", F.explode(cell).alias("cell")).select("key", "cell.i", "cell.j", "node", "comp", F.col("side").cast("long").alias("side"), "own")


class Cell:
    """The rows of one cell; which pairs of them survive the posterior bound."""

    def __init__(self, key: tuple, rows: list[tuple], looks: Looks, percent: int):
        self.i, self.j, self.looks, self.percent = key[1], key[2], looks, percent
        self.node, self.comp, self.n = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        self.sig = np.frombuffer(b"".join(r[3] for r in rows), np.uint32).reshape(-1, HASHES)
        self.side, self.own = (np.array([r[k] for r in rows], np.int64) for k in (4, 5))
        keys = _band_keys(self.sig)
        self.keys, self.band = keys, int(np.flatnonzero((keys == np.int64(key[0])).all(0))[0])

    def pairs(self):
        """(x, partners) by row x, for pairs of different components that share no earlier band, likeliest first."""
        left = np.flatnonzero((self.side == 1) & (self.own == self.i))
        right = np.flatnonzero(self.side == 0) if self.j < 0 else np.flatnonzero(self.own == self.j)
        if self.j >= 0:
            right = right[self.side[right] == 1]
        for x in left:
            y = right[self.comp[right] != self.comp[x]]
            if self.i == self.j:
                y = y[self.node[y] > self.node[x]]
            small, large = np.minimum(self.n[y], self.n[x]), np.maximum(self.n[y], self.n[x])
            y = y[100 * small >= self.percent * large]
            if self.band and len(y):
                y = y[~(self.keys[y, : self.band] == self.keys[x, : self.band]).any(1)]
            if len(y):
                m = self.looks.matches(self.sig[x], self.sig[y])
                y, m = y[m >= 0], m[m >= 0]
                if len(y):
                    yield x, y[np.argsort(-m, kind="stable")]


def _by_cell(batches, columns: tuple[str, ...]):
    """Rows of batches sorted by (key, i, j), a cell at a time."""
    cell, rows = None, []
    for b in batches:
        for key, i, j, *row in zip(*(b.column(c).to_pylist() for c in ("key", "i", "j", *columns))):
            if (key, i, j) != cell:
                if len(rows) > 1:
                    yield cell, rows
                cell, rows = (key, i, j), []
            rows.append(row)
    if len(rows) > 1:
        yield cell, rows


_CELL = ("node", "comp", "n", "sig", "side", "own", "sid", "at")


def _plausible(threshold: float, percent: int):
    """Rows of cells -> those that have a surviving pair there."""

    def run(batches):
        looks = Looks(threshold)
        for cell, rows in _by_cell(batches, _CELL):
            c = Cell(cell, rows, looks, percent)
            used = np.zeros(len(rows), bool)
            for x, y in c.pairs():
                used[x] = True
                used[y] = True
            kept = np.flatnonzero(used)
            k = len(kept)
            if k:
                place = {n: (np.full(k, cell[p]), pa.int64()) for p, n in enumerate(("key", "i", "j"))}
                sig = ([rows[r][3] for r in kept], pa.binary())
                yield batch(**place, node=(c.node[kept], pa.int64()), comp=(c.comp[kept], pa.int64()), n=(c.n[kept], pa.int64()), sig=sig, side=(c.side[kept], pa.int64()), own=(c.own[kept], pa.int64()), sid=([rows[r][6] for r in kept], pa.binary()), at=([rows[r][7] for r in kept], pa.int64()))

    return run


def _joined_in_cells(threshold: float, percent: int):
    """Rows of cells with full sets -> a forest (a, b) of confirmed links between their components."""

    def run(batches):
        looks = Looks(threshold)
        for cell, rows in _by_cell(batches, (*_CELL, "hashes")):
            c = Cell(cell, rows, looks, percent)
            sets = [unpacked(r[8]) for r in rows]
            up: dict[int, int] = {}

            def find(v: int) -> int:
                while up.setdefault(v, v) != v:
                    up[v] = up[up[v]]
                    v = up[v]
                return v

            out = []
            for x, ys in c.pairs():
                for y in ys:
                    p, q = find(int(c.comp[x])), find(int(c.comp[y]))
                    if p != q and _similar(sets[x], sets[y], percent):
                        up[max(p, q)] = min(p, q)
                        out.append((int(min(c.node[x], c.node[y])), int(max(c.node[x], c.node[y]))))
            if out:
                yield batch(a=([r[0] for r in out], pa.int64()), b=([r[1] for r in out], pa.int64()))

    return run


def links(docs: DataFrame, size: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n, sid) of every row, (sid, node, doc) of every class, and confirmed (a, b) links of nodes that join all components."""
    with settings(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=SET_BATCH):
        return _links(docs, size, percent)


def _links(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    threshold = percent / 100
    rows = materialise(map_batches(docs.select("doc_id", "text"), f"{ddl(docs.select('doc_id'))}, n long, sid binary, sig binary", _described(size)))
    classes = rows.where("doc_id is not null and sid is not null").groupBy("sid").agg(F.min("doc_id").alias("doc"), F.min("n").alias("n"), F.min("sig").alias("sig"))
    classes = materialise(classes.withColumns({"node": F.monotonically_increasing_id(), "at": F.xxhash64("doc")}))
    sigs = classes.select("node", "sig")
    buckets = map_batches(sigs, "key long, node long", _banded)
    hubs = materialise(buckets.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n"))
    met = materialise(buckets.join(hubs, "key"))

    # one hub a class: the one it shares most bands with; a pair left out here is compared below
    offered = met.where("node != hub").select("node", "hub").repartition("node").groupBy("node", "hub").agg(F.count("*").alias("n")).where("n > 1")
    chosen = offered.groupBy("node").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("hub"))
    pairs = materialise(chosen.select(F.col("hub").alias("a"), F.col("node").alias("b")))
    hot = materialise(pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_ROWS).alias("salts")).where("salts > 1"))
    of = lambda side: classes.select(F.col("node").alias(side), *(F.col(c).alias(f"{as_}{side}") for c, as_ in (("sig", "s"), ("sid", "sid_"), ("at", "at_"))))
    own = of("a").join(pairs.select("a").distinct(), "a")
    hub = F.col("a").alias("hub")
    signed = _salted(pairs.join(of("b"), "b").select("*", hub), own.select("*", hub), hot, "hub")
    kept = ["a", "b", "sid_a", "sid_b", "at_a", "at_b"]
    likely = materialise(map_batches(signed.select(*kept, "sa", "sb"), "a long, b long, sid_a binary, sid_b binary, at_a long, at_b long", _likely(threshold)))
    # the texts of both sides are read once
    asked = likely.selectExpr("sid_a as sid", "at_a as at", "a as hub").unionByName(likely.selectExpr("sid_b as sid", "at_b as at", "cast(null as long) as hub"))
    sets = materialise(_sets_of(docs, asked, size))
    hub_sets = sets.where("hub is not null").selectExpr("hub as a", "sid as sid_a", "hashes as ha")
    full = _salted(likely.join(sets.selectExpr("sid as sid_b", "hashes as hb"), "sid_b"), hub_sets, hot, "sid_a")
    first = materialise(map_batches(full.select("a", "b", "ha", "hb"), "a long, b long", _verified(percent)))
    discard(sets)

    # what is left: buckets with several components
    labelled = materialise(met.select("key", "node").join(components(first), "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    cells = materialise(_cells(labelled))
    place = ["key", "i", "j"]
    dealt = cells.join(classes.select("node", "n", "sig", "sid", "at"), "node").select(*place, *_CELL).repartition(*place).sortWithinPartitions(*place)
    wanted = materialise(dealt.mapInArrow(_plausible(threshold, percent), "key long, i long, j long, node long, comp long, n long, sig binary, side long, own long, sid binary, at long"))
    asked = wanted.selectExpr("sid", "at", "cast(null as long) as hub")
    again = wanted.join(_sets_of(docs, asked, size).drop("hub"), "sid").repartition(*place).sortWithinPartitions(*place)
    second = materialise(again.select(*place, *_CELL, "hashes").mapInArrow(_joined_in_cells(threshold, percent), "a long, b long"))
    return rows.select("doc_id", "n", "sid"), classes.select("sid", "node", "doc"), first.unionByName(second)


def classes_of(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    rows, classes, edges = links(docs, size, percent)
    named = materialise(classes.join(components(edges), "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    # written, so that the join below has shuffles of its own on both sides and a large component can be split
    least = materialise(named.groupBy("comp").agg(F.min("doc").alias("component_id")))
    named = materialise(named.join(least, "comp").select("sid", "component_id"))
    own = F.coalesce("component_id", "doc_id")
    out = rows.join(named, "sid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, with the columns it came with; documents that link with nothing, and rows without an id, stay."""
    judged = classes_of(docs, size, percent).where(F.col("doc_id").isNotNull())
    # rows that repeat an id stand and fall together: an id goes if none of its rows is kept
    gone = judged.groupBy("doc_id").agg(F.bool_or("kept").alias("any")).where(~F.col("any")).select("doc_id").alias("gone")
    mine = docs.alias("docs")
    return mine.join(gone, F.col("docs.doc_id") == F.col("gone.doc_id"), "left_anti").select(*docs.columns)
