"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

Only vectors of one label (and length) are compared. On unit vectors cosine c is the distance sqrt(2 - 2c), so the threshold is a radius.

1. Exact copies become one class with a count (``classes``).
2. Labels of more than ``CELL`` classes are split into cells: each class goes to the nearest of up to ``FAN`` classes drawn from the cell by hash;
   cells still too large are split again. Cells of one parent are a group (at most ``FAN`` of them).
3. Every cell becomes a cover tree (``Tree``): level 0 is one node; the nodes of level l are classes at least 2^(1 - l) apart that cover all others
   within that distance, and those of level l are nodes of level l + 1 too. A node hangs on the nearest node above and knows the covering radius of
   what hangs below it, measured and not just bounded.
4. Groups meet whose centres are no further apart than their covering radii and the threshold; in one task the trees of two groups are descended
   together, level by level. Node pairs with d > r_a + r_b + threshold are pruned with all below; pairs with d + r_a + r_b <= threshold are links of everything
   below, counted as a block and never listed. What is left at the leaves is decided by its cosine.
5. A task returns counts by class and a spanning forest, not its links. Counts are summed, forests become components.

Memory is bounded by two groups; nothing is collected. Results are exact. Time is that of the node pairs which bounds leave: on data without near
neighbours in many dimensions (all distances alike) no metric tree prunes above the level of single clusters, and the work is that of all pairs of clusters of a label.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and those with a null label, link with nothing, nor do vectors
of different length; rows without a vec_id link with nothing and stay, with themselves (null) as component; rows that repeat are vectors of their own, linked to
each other, under one vec_id; ties at the threshold are links; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import batch, map_batches, materialise
from tessera.llm.minhash import components

COSINE = 0.93
#: Classes of a cell; cells that one is split into at a time; rounds of splitting by distance before cells are cut by hash; rows of a cell that one task assigns.
CELL, FAN, ROUNDS, DEALT = 1024, 64, 12, 65_536
#: Slack of bounds against rounding. Links themselves are decided by the cosine alone.
EPS = 1e-7
#: The finest level's radius is 2^(1 - LEVELS); below it are the leaves.
LEVELS = 7


def _units():
    """Vectors of any scale -> unit vectors as bytes of doubles."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for v in b.column("embedding").to_pylist():
            v = np.array(v, np.float64)
            v = v / np.abs(v).max()
            out.append((v / np.sqrt(v @ v)).tobytes())
        return batch(**{c: b.column(c) for c in ("cell", "cls", "n")}, v=(out, pa.binary()))

    return run


def _vectors(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors of one length."""
    found = col.to_pylist()
    return np.frombuffer(b"".join(found), np.float64).reshape(len(found), -1)


def classes(rows: DataFrame) -> DataFrame:
    """(label, embedding, cls, first, n) of every distinct vector that can link: its least row, least vec_id and number of rows."""
    fine = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("embedding", lambda x: x != 0)
    can = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine)
    return materialise(can.groupBy("label", "embedding").agg(F.min("row").alias("cls"), F.min("vec_id").alias("first"), F.count("*").alias("n")))


def _assigned(batches) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cell, salt, kind): centres (kind 0) of a cell, then the rows that go to the nearest of them."""
    key, centres = None, None
    for b in batches:
        cell, salt, kind = (np.array(b.column(c).to_pylist(), object) for c in ("cell", "salt", "kind"))
        begin = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (salt[1:] != salt[:-1]) | (kind[1:] != kind[:-1])]) if len(cell) else []
        for lo, hi in zip(begin, [*begin[1:], len(cell)]):
            run, v = b.slice(lo, hi - lo), _vectors(b.column("v").slice(lo, hi - lo))
            if kind[lo] == 0:
                centres = np.concatenate([centres, v]) if key == (cell[lo], salt[lo]) else v
                key = (cell[lo], salt[lo])
                continue
            nearest = (v @ centres.T).argmax(1)
            yield batch(cell=([f"{cell[lo]}.{j}" for j in nearest.tolist()], pa.string()), grp=run.column("cell"), cls=run.column("cls"), n=run.column("n"), v=run.column("v"))


def cells(units: DataFrame, most: int = CELL) -> DataFrame:
    """(cell, grp, cls, n, v) with at most ``most`` rows a cell and ``FAN`` cells a group."""
    left, done = materialise(units.withColumn("grp", F.col("cell"))), []
    for turn in range(ROUNDS + 1):
        sizes = materialise(left.groupBy("cell").agg(F.count("*").alias("size")).where(F.col("size") > most))
        if not sizes.head(1):
            break
        # cells fit to stay: no cell of the table of large ones (its rows: one in ``most`` at most)
        done.append(left.join(sizes, "cell", "left_anti"))
        large = left.drop("grp").join(sizes, "cell")
        if turn == ROUNDS:
            part = F.pmod(F.xxhash64("cls"), F.ceil(F.col("size") * 2 / most).cast("long"))
            left = materialise(large.select(F.concat_ws(".", "cell", part.cast("string")).alias("cell"), F.col("cell").alias("grp"), "cls", "n", "v"))
            break
        fan = F.least(F.lit(FAN), F.ceil(F.col("size") * 2 / most).cast("int"))
        at = F.xxhash64("cls", F.lit(turn))
        # about twice as many rows as are wanted have hashes this small; only they are ranked
        drawn = large.where(at < (F.lit(-(2.0**63)) + (2 * fan + 16) / F.col("size") * 2.0**64))
        drawn = drawn.withColumn("fan", fan).withColumn("k", F.row_number().over(Window.partitionBy("cell").orderBy(at, "cls"))).where("k <= fan")
        salts = F.ceil(F.col("size") / DEALT).cast("long")
        copies = drawn.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.lit(0).alias("kind"), "cls", "n", "v")
        rows = large.select("cell", F.pmod(F.xxhash64("cls", F.lit("deal")), salts).alias("salt"), F.lit(1).alias("kind"), "cls", "n", "v")
        dealt = copies.unionByName(rows).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "kind")
        left = materialise(dealt.mapInArrow(_assigned, "cell string, grp string, cls long, n long, v binary"))
    for part in done:
        left = left.unionByName(part)
    return left


class Tree:
    """A cover tree over the unit vectors of one cell."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, v: np.ndarray):
        self.ids, self.n, self.v = ids, n, v
        every = np.arange(len(ids))
        near = self._from(0)
        nodes = [np.zeros(1, np.int64)]
        for level in range(1, LEVELS + 1):
            radius = 2.0 ** (1 - level)
            # nested: nodes of the level above stay; each new one is a class that none so far covers
            now = nodes[-1].tolist()
            while True:
                free = np.flatnonzero(near > radius)
                if not len(free):
                    break
                now.append(int(free[0]))
                near = np.minimum(near, self._from(now[-1]))
            if len(now) > len(nodes[-1]):
                nodes.append(np.array(now, np.int64))
            if len(now) == len(ids):
                break
        if len(nodes[-1]) < len(ids):
            nodes.append(every)
        self.nodes = nodes
        # each node hangs on the nearest of the level above
        self.parent = [np.zeros(1, np.int64)]
        for above, here in zip(nodes, nodes[1:]):
            up = (v[here] @ v[above].T).argmax(1)
            place = {int(c): k for k, c in enumerate(above)}
            self.parent.append(np.array([place.get(int(c), int(u)) for c, u in zip(here, up)], np.int64))
        # by level, the node that each class hangs below, and the covering radii
        leaf = np.empty(len(ids), np.int64)
        leaf[nodes[-1]] = np.arange(len(nodes[-1]))
        self.below = [leaf]
        for parent in reversed(self.parent[1:]):
            self.below.insert(0, parent[self.below[0]])
        self.radius, self.weight = [], []
        for here, below in zip(nodes, self.below):
            far, weight = np.zeros(len(here)), np.zeros(len(here), np.int64)
            np.maximum.at(far, below, self._distance((v * v[here[below]]).sum(1)))
            np.add.at(weight, below, n)
            self.radius.append(far)
            self.weight.append(weight)

    @staticmethod
    def _distance(cosine: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))

    def _from(self, k: int) -> np.ndarray:
        d = self._distance(self.v @ self.v[k])
        d[k] = 0.0
        return d

    def packed(self) -> bytes:
        out = io.BytesIO()
        levels = {f"{name}{k}": x for name in ("nodes", "parent", "below", "radius", "weight") for k, x in enumerate(getattr(self, name))}
        np.savez(out, ids=self.ids, n=self.n, v=self.v, **levels)
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        held, out = np.load(io.BytesIO(data)), cls.__new__(cls)
        out.ids, out.n, out.v = held["ids"], held["n"], held["v"]
        depth = sum(k.startswith("nodes") for k in held.files)
        for name in ("nodes", "parent", "below", "radius", "weight"):
            setattr(out, name, [held[f"{name}{k}"] for k in range(depth)])
        return out

    def descend(self, level: int, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of the next level below the given ones, and for each the place of its parent among them."""
        at = np.full(len(self.nodes[level]), -1)
        at[alive] = np.arange(len(alive))
        at = at[self.parent[level + 1]]
        below = np.flatnonzero(at >= 0)
        return below, at[below]


def _forest(x: np.ndarray, y: np.ndarray, nx: int, ny: int) -> tuple[np.ndarray, np.ndarray]:
    """Least x of the component of every x and y of a bipartite graph; y without a pair get nx."""
    of_x, of_y = np.arange(nx), np.full(ny, nx)
    while True:
        np.minimum.at(of_y, y, of_x[x])
        low = of_x.copy()
        np.minimum.at(low, x, of_y[y])
        low = low[low]
        if (low == of_x).all():
            return of_x, of_y
        of_x = low


class Links:
    """What links of the trees met so far add: a count by class, and edges that connect what they connect."""

    def __init__(self):
        self.counts: list[tuple[np.ndarray, np.ndarray]] = []
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, a: Tree, la: int, ia: np.ndarray, b: Tree, lb: int, ib: np.ndarray, hit: np.ndarray) -> None:
        """Everything below node ia[i] of a links with everything below ib[j] of b where hit[i, j]."""
        for tree, level, nodes, gain in ((a, la, ia, hit @ b.weight[lb][ib]), (b, lb, ib, a.weight[la][ia] @ hit)):
            per_node = np.zeros(len(tree.nodes[level]), np.int64)
            per_node[nodes] = gain
            self.counts.append((tree.ids, per_node[tree.below[level]]))
            if a is b:
                break
        of_a, of_b = _forest(*np.nonzero(hit), len(ia), len(ib))
        root = a.ids[a.nodes[la][ia]]
        for tree, level, nodes, label, linked in ((a, la, ia, of_a, hit.any(1)), (b, lb, ib, of_b, hit.any(0))):
            to = np.full(len(tree.nodes[level]), -1)
            to[nodes[linked]] = label[linked]
            to = to[tree.below[level]]
            mine = to >= 0
            self.edges.append((tree.ids[mine], root[to[mine]]))

    def result(self) -> pa.RecordBatch:
        """(a, b, n): counts have no b, edges no n."""
        ids, gain = (np.concatenate([np.zeros(0, np.int64), *(c[k] for c in self.counts)]) for k in (0, 1))
        ids, at = np.unique(ids, return_inverse=True)
        total = np.zeros(len(ids), np.int64)
        np.add.at(total, at, gain)
        ids, total = ids[total != 0], total[total != 0]
        x, y = (np.concatenate([np.zeros(0, np.int64), *(e[k] for e in self.edges)]) for k in (0, 1))
        x, y = x[x != y], y[x != y]
        names, at = np.unique(np.r_[x, y], return_inverse=True)
        x, y = at[: len(x)], at[len(x) :]
        least = _forest(np.r_[x, y], np.r_[np.arange(len(x)), np.arange(len(x))], len(names), len(x))[0]  # every edge a node of its own
        x = np.flatnonzero(least != np.arange(len(names)))
        return batch(
            a=(np.r_[ids, names[x]], pa.int64()),
            b=pa.concat_arrays([pa.nulls(len(ids), pa.int64()), pa.array(names[least[x]], pa.int64())]),
            n=pa.concat_arrays([pa.array(total, pa.int64()), pa.nulls(len(x), pa.int64())]),
        )


def traverse(a: Tree, b: Tree, cosine: float, found: Links) -> None:
    """Descend two trees together; ``a`` may be ``b``, then every class meets itself as well and each pair is met from both sides."""
    within = float(np.sqrt(2.0 - 2.0 * cosine))
    la = lb = 0
    ia = ib = np.zeros(1, np.int64)
    alive = np.ones((1, 1), bool)
    while True:
        cos = a.v[a.nodes[la][ia]] @ b.v[b.nodes[lb][ib]].T
        leaves = la == len(a.nodes) - 1 and lb == len(b.nodes) - 1
        if leaves:
            hit = alive & (cos >= cosine)
            if a is b:
                hit |= alive & (a.nodes[la][ia][:, None] == b.nodes[lb][ib])
            if hit.any():
                found.add(a, la, ia, b, lb, ib, hit)
            return
        d = Tree._distance(cos)
        reach = a.radius[la][ia][:, None] + b.radius[lb][ib]
        alive &= d <= reach + within + EPS
        block = alive & (d + reach <= within - EPS)
        if block.any():
            found.add(a, la, ia, b, lb, ib, block)
            alive &= ~block
        rows, cols = alive.any(1), alive.any(0)
        if not rows.any():
            return
        alive, ia, ib = alive[rows][:, cols], ia[rows], ib[cols]
        if la < len(a.nodes) - 1:
            ia, up = a.descend(la, ia)
            alive = alive[up]
        if lb < len(b.nodes) - 1:
            ib, up = b.descend(lb, ib)
            alive = alive[:, up]
        la, lb = min(la + 1, len(a.nodes) - 1), min(lb + 1, len(b.nodes) - 1)


def trees(dealt: DataFrame) -> DataFrame:
    """(label, grp, cell, tree, centre, radius): the tree of every cell, packed, with its root's vector and covering radius."""

    def build(t: pa.Table) -> pa.Table:
        tree = Tree(t.column("cls").to_numpy(), t.column("n").to_numpy(), _vectors(t.column("v")))
        one = {"grp": t.column("grp")[0].as_py(), "cell": t.column("cell")[0].as_py(), "tree": tree.packed(), "centre": tree.v[0].tolist(), "radius": float(tree.radius[0][0])}
        return pa.Table.from_pylist([one], pa.schema([("grp", pa.string()), ("cell", pa.string()), ("tree", pa.binary()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64())]))

    return materialise(dealt.groupBy("cell").applyInArrow(build, "grp string, cell string, tree binary, centre array<double>, radius double"))


def meetings(made: DataFrame, cosine: float) -> DataFrame:
    """(ga, gb): groups of one label, each with itself and with those that its covering radius and theirs let near enough."""

    def bound(t: pa.Table) -> pa.Table:
        v = np.array(t.column("centre").to_pylist())
        far = float((Tree._distance(v @ v[0]) + t.column("radius").to_numpy()).max())
        return pa.table({"grp": t.column("grp").slice(0, 1), "centre": t.column("centre").slice(0, 1), "far": pa.array([far])})

    groups = materialise(made.select("grp", "cell", "centre", "radius").groupBy("grp").applyInArrow(bound, "grp string, centre array<double>, far double"))
    groups = groups.withColumn("label", F.regexp_extract("grp", r"(?s)^(.*:\d+)[.\d]*$", 1))
    other = groups.select("label", *(F.col(c).alias(f"{c}_b") for c in ("grp", "centre", "far")))
    dot = F.aggregate(F.zip_with("centre", "centre_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    near = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot)) <= F.col("far") + F.col("far_b") + float(np.sqrt(2 - 2 * cosine)) + EPS
    return groups.join(other, "label").where("grp <= grp_b").where(near).select(F.col("grp").alias("ga"), F.col("grp_b").alias("gb"))


def links(made: DataFrame, cosine: float) -> DataFrame:
    """(a, b, n): counts of links by class (n), and edges (a, b) of a spanning forest."""

    def meet(t: pa.Table) -> pa.Table:
        side = t.column("side").to_pylist()
        held = sorted(((s, c, Tree.unpacked(x)) for s, c, x in zip(side, t.column("cell").to_pylist(), t.column("tree").to_pylist())), key=lambda r: r[:2])
        left, right = ([r[2] for r in held if r[0] == s] for s in (0, 1))
        found = Links()
        if not right:
            for i, a in enumerate(left):
                for b in left[i:]:
                    traverse(a, b, cosine, found)
                # each class met itself once
                found.counts.append((a.ids, -a.n))
        for a in left if right else ():
            for b in right:
                traverse(a, b, cosine, found)
        return pa.Table.from_batches([found.result()])

    pairs = materialise(meetings(made, cosine))
    sides = F.when(F.col("ga") == F.col("gb"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    wanted = pairs.withColumn("side", F.explode(sides)).withColumn("grp", F.when(F.col("side") == 0, F.col("ga")).otherwise(F.col("gb")))
    met = wanted.join(made.select("grp", "cell", "tree"), "grp").select("ga", "gb", "side", "cell", "tree")
    return materialise(met.groupBy("ga", "gb").applyInArrow(meet, "a long, b long, n long"))


def near_copies(vectors: DataFrame, cosine: float = COSINE, most: int = CELL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    rows = materialise(vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "embedding"))
    made = classes(rows)
    start = made.select(F.concat_ws(":", F.col("label").cast("string"), F.size("embedding").cast("string")).alias("cell"), "cls", "n", "embedding")
    units = map_batches(start, "cell string, cls long, n long, v binary", _units)
    found = links(trees(cells(units, most)), cosine)
    counts = found.where("n is not null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("others"))
    comp = materialise(components(found.where("b is not null").select("a", "b")).withColumnsRenamed({"node": "cls"}))
    judged = materialise(made.join(counts, "cls", "left").join(comp, "cls", "left").select("label", "embedding", "first", F.coalesce("comp", "cls").alias("comp"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    least = materialise(judged.groupBy("comp").agg(F.min("first").alias("component_id")))
    judged = materialise(judged.join(least, "comp").select("label", "embedding", "n_links", "component_id"))
    # rows that can't link have no class; both sides are shuffled for this join alone, so that a very common vector's rows can be split
    out = rows.where("vec_id is not null").join(judged, ["label", "embedding"], "left").select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where("vec_id is null").select("vec_id", F.lit(None).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))


ORACLE = r"""
with recursive e as (
  select row_number() over () as r, vec_id, label, embedding::double[] as v, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as norm
  from embeddings),
fit as (
  select r, vec_id, label, v, len(v) as d, norm from e
  where vec_id is not null and label is not null and norm > 0 and isfinite(norm) and len(list_filter(v, lambda x: x is null)) = 0),
pairs as (
  select a.r as x, b.r as y from fit a join fit b on a.label = b.label and a.d = b.d and a.r <> b.r
  where list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93),
reach(x, y) as (
  select r, r from fit
  union
  select reach.x, pairs.y from reach join pairs on reach.y = pairs.x),
comp as (select reach.x as r, min(fit.vec_id) as component_id from reach join fit on fit.r = reach.y group by reach.x),
n as (select x as r, count(*) as n_links from pairs group by x)
select vec_id, coalesce(n_links, 0) as n_links, coalesce(component_id, vec_id) as component_id, vec_id is not distinct from coalesce(component_id, vec_id) as kept
from e left join comp using (r) left join n using (r)
"""
