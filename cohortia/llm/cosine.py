"""Near-duplicate vectors by cosine, compared in tiles along their principal axes.

Vectors are rotated onto the principal axes of the whole table, the strongest first.  A tile pair
adds up the products of the leading axes; what the others can still add is at most the product of the
norms of the rests, and pairs whose bound stays under the threshold leave before the next axes.

1. Equal vectors of a label become one, with the number of its rows.
2. The second moments of all vectors are summed; their eigenvectors are the axes.
3. Large labels are cut into cells by a tree of cuts across leading axes.  A linked pair is at most
   sqrt(2 - 2 * threshold) apart, so a vector visits only later cells within that distance.  The tree
   is fitted on a bounded sample, every vector is dealt by it.
4. A cell of more rows than a tile holds is dealt into tiles that meet in pairs, so no task holds more
   than two tiles, whatever the size of a label or a cell.
5. A tile pair returns how many rows each of its vectors is linked to, and a spanning forest of the
   links; components of these forests give each vector its smallest reachable id.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, stored
from .components import components
from .topk import usable

# Axes of the tree, rows it is fitted on, and the largest labels that get one; the others meet tile by tile.
TREE_AXES, TREE_ROWS, TREE_LABELS = 8, 65_536, 1_000
# Fewer sample rows than this are not cut any further.
LEAST_ROWS = 32
# A cut must leave at most so much of a cell's comparisons.
WORTH = 0.9
# Bytes of a tile's vectors, and its least and most rows.
TILE_BYTES, LEAST_TILE, MOST_TILE = 2 << 20, 512, 4096
FIRST_AXES = 8
# Rounding of the rotated sums; pairs this near the threshold are decided on the given vectors.
SLACK = 1e-9
VECTOR = "id long, label string, dims int, key binary, vector binary"
FOUND = "key binary, links long, a long, b long"


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def tile_rows(dims: int) -> int:
    return int(min(MOST_TILE, max(LEAST_TILE, TILE_BYTES // (8 * max(1, dims)))))


@dataclass
class Cuts:
    """A tree of cuts: node -> (axis, value, left, right), leaves as -1 - cell; cells are numbered from left to right."""

    nodes: list[tuple[int, float, int, int]] = field(default_factory=list)
    root: int = -1
    cells: int = 1

    @staticmethod
    def fit(points: np.ndarray, rows: float, cell: int, reach: float) -> Cuts:
        """Cut ``points``, which stand for ``rows`` rows, as long as cells hold more than ``cell`` and cuts save work."""
        tree = Cuts(cells=0)

        def grow(at: np.ndarray) -> int:
            n = len(at)
            if n >= LEAST_ROWS and n * rows / len(points) > cell:
                best = None
                for axis in range(points.shape[1]):
                    x = points[at, axis]
                    cut = float(np.median(x))
                    left, visits = int((x < cut).sum()), int(((x < cut) & (x >= cut - reach)).sum())
                    work = left**2 / 2 + (n - left) ** 2 / 2 + visits * (n - left)
                    if 0 < left < n and work < WORTH * n**2 / 2 and (best is None or work < best[0]):
                        best = work, axis, cut
                if best is not None:
                    _, axis, cut = best
                    number = len(tree.nodes)
                    tree.nodes.append((axis, cut, 0, 0))
                    low = points[at, axis] < cut
                    tree.nodes[number] = (axis, cut, grow(at[low]), grow(at[~low]))
                    return number
            tree.cells += 1
            return -tree.cells

        tree.root = grow(np.arange(len(points)))
        return tree

    def deal(self, points: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, whether the row is at home there); a row visits later cells within reach of its own axes."""
        rows, cells, home = [], [], []

        def walk(node: int, at: np.ndarray, own: np.ndarray) -> None:
            if not len(at):
                return
            if node < 0:
                rows.append(at)
                cells.append(np.full(len(at), -1 - node))
                home.append(own)
                return
            axis, cut, left, right = self.nodes[node]
            x = points[at, axis]
            low = np.where(own, x < cut, x < cut + reach)
            walk(left, at[low], own[low])
            high = x >= cut - reach
            walk(right, at[high], (own & (x >= cut))[high])

        walk(self.root, np.arange(len(points)), np.ones(len(points), bool))
        return tuple(np.concatenate(x) if x else np.zeros(0, int) for x in (rows, cells, home))


def links_of(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool):
    """(rows of ``a``, rows of ``b``) of linked pairs, block by block; in one tile (``same``) each pair once.

    ``a`` and ``b`` are unit vectors, ``axes`` the principal axes as columns.
    """
    u, v = a @ axes, (a if same else b) @ axes
    dims = u.shape[1]
    ends = [FIRST_AXES]
    while ends[-1] < dims:
        ends.append(2 * ends[-1])
    ends[-1] = dims
    # Norms of what stands behind each end.
    rest = [tuple(np.sqrt((w[:, e:] ** 2).sum(axis=1)) for w in (u, v)) for e in ends]
    step = max(1, (1 << 20) // max(1, len(v)))
    for at in range(0, len(u), step):
        block = slice(at, min(at + step, len(u)))
        total = u[block, : ends[0]] @ v[:, : ends[0]].T
        open_ = total + np.outer(rest[0][0][block], rest[0][1]) >= threshold - SLACK
        if same:
            open_ &= np.arange(len(v))[None, :] > np.arange(block.start, block.stop)[:, None]
        pair = None
        for n, end in enumerate(ends[1:], 1):
            start = ends[n - 1]
            if pair is None and open_.mean() > 0.02:
                total += u[block, start:end] @ v[:, start:end].T
                open_ &= total + np.outer(rest[n][0][block], rest[n][1]) >= threshold - SLACK
                continue
            if pair is None:
                i, j = np.nonzero(open_)
                pair = i + at, j, total[i, j]
            i, j, s = pair
            if not len(i):
                break
            s = s + np.concatenate([np.einsum("pd,pd->p", u[i[k : k + 65_536], start:end], v[j[k : k + 65_536], start:end]) for k in range(0, len(i), 65_536)])
            use = s + rest[n][0][i] * rest[n][1][j] >= threshold - SLACK
            pair = i[use], j[use], s[use]
        if pair is None:
            i, j = np.nonzero(open_)
            pair = i + at, j, total[i, j]
        i, j, s = pair
        near = np.flatnonzero(s < threshold + SLACK)
        exact = np.einsum("pd,pd->p", a[i[near]], (a if same else b)[j[near]]) >= threshold
        keep = np.ones(len(i), bool)
        keep[near] = exact
        if keep.any():
            yield i[keep], j[keep]


class Forest:
    """Spanning edges of a growing graph on numbered vertices."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        roots = np.array([self.find(x) for x in range(len(self.parent))])
        # Pairs whose ends hang together already say nothing new, and of many between two trees one is enough.
        x, y = roots[a], roots[b]
        new = np.flatnonzero(x != y)
        low, high = np.minimum(x, y)[new], np.maximum(x, y)[new]
        new = new[np.unique(low * len(roots) + high, return_index=True)[1]]
        for i, j in zip(a[new].tolist(), b[new].tolist()):
            p, q = self.find(i), self.find(j)
            if p != q:
                self.parent[max(p, q)] = min(p, q)
                self.edges.append((i, j))


def near_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """The id, ``n_links``, ``component_id`` and ``kept`` of every row.

    Two rows are linked if their labels are equal and not null, their vectors of one length, and their
    cosine in double precision is at least ``threshold`` (above 0).  ``n_links`` counts the other rows
    linked directly, copies included; ``component_id`` is the smallest id reachable, ``kept`` whether it
    is the row's own.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor does
    a row without an id, whose component is null and which is kept.  Repeated rows are rows; rows that
    share an id are one vertex of the components.  Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    values = F.when(usable(col(vector_col)), F.transform(col(vector_col), lambda x: x.cast("double")))
    given = vectors.select(col(id_col).cast("long").alias("id"), col(label_col).cast("string").alias("label"), values.alias("vector"))

    def read(batches):
        for b in batches:
            ids, labels, lists = (c.to_pylist() for c in b.columns)
            keys, data = [], []
            for vertex, label, v in zip(ids, labels, lists):
                x = np.array(v or (), np.float64) + 0.0
                fits = vertex is not None and label is not None and x.any()
                data.append(x.tobytes() if fits else None)
                keys.append(xxhash.xxh3_128_digest(label.encode("utf-8", "surrogatepass") + b"\0" + x.tobytes()) if fits else None)
            dims = pa.array([None if d is None else len(d) // 8 for d in data], pa.int32())
            arrays = [b.column(0), b.column(1), dims, pa.array(keys, pa.binary()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "label", "dims", "key", "vector"])

    rows = stored(given.mapInArrow(read, VECTOR), "vectors")
    usable_rows = rows.where(F.col("key").isNotNull())
    classes = usable_rows.groupBy("key").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("dims").alias("dims"), F.first("vector").alias("vector")
    )
    classes = stored(classes, "classes")

    def moments(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            dims = b.column(0).to_numpy()
            data = b.column(1).to_pylist()
            for d in np.unique(dims).tolist():
                x = unit(np.frombuffer(b"".join(data[i] for i in np.flatnonzero(dims == d).tolist()), np.float64).reshape(-1, d))
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, s in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([r.tobytes() for r in s], pa.binary())], names=["dims", "axis", "sums"]
            )

    def add_up(t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(s, np.float64) for s in t.column("sums").to_pylist()], axis=0)
        return pa.table([t.column("dims").slice(0, 1), t.column("axis").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["dims", "axis", "sums"])

    moment = "dims int, axis int, sums binary"
    total = classes.select("dims", "vector").mapInArrow(moments, moment).groupBy("dims", "axis").applyInArrow(add_up, moment)
    axes: dict[int, np.ndarray] = {}
    matrices: dict[int, dict[int, bytes]] = {}
    # One matrix for each length of vectors.
    for r in total.collect():
        matrices.setdefault(r["dims"], {})[r["axis"]] = bytes(r["sums"])
    for d, lines in matrices.items():
        axes[d] = np.linalg.eigh(np.frombuffer(b"".join(lines[i] for i in range(d)), np.float64).reshape(d, d))[1][:, ::-1].copy()

    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    sizes = classes.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("size"))
    tile = lambda d: F.greatest(F.lit(LEAST_TILE), F.least(F.lit(MOST_TILE), F.floor(F.lit(TILE_BYTES) / (8 * d)))).cast("long")
    large = sizes.where(F.col("size") > tile(F.col("dims"))).orderBy(F.desc("size"), "label", "dims").limit(TREE_LABELS).collect()
    trees: dict[tuple[str, int], Cuts] = {}
    if large:
        names = spark.createDataFrame([(r["label"], r["dims"], r["size"]) for r in large], "label string, dims int, size long")
        sample = classes.join(F.broadcast(names), ["label", "dims"]).orderBy(F.xxhash64("key"), "key").limit(TREE_ROWS)

        def lead(batches):
            for b in batches:
                out = []
                for d, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    x = unit(np.frombuffer(v, np.float64)[None, :]) @ axes[d][:, :TREE_AXES]
                    out.append(x[0].tolist())
                yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(out, pa.list_(pa.float64()))], names=["label", "dims", "lead"])

        points: dict[tuple[str, int], list] = {}
        for r in sample.select("label", "dims", "vector").mapInArrow(lead, "label string, dims int, lead array<double>").collect():
            points.setdefault((r["label"], r["dims"]), []).append(r["lead"])
        for r in large:
            own = points.get((r["label"], r["dims"]))
            if own:
                trees[r["label"], r["dims"]] = Cuts.fit(np.array(sorted(own)), r["size"], tile_rows(r["dims"]), reach)

    def deal(batches):
        whole = Cuts()
        for b in batches:
            if not b.num_rows:
                continue
            labels, dims, data = b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()
            groups: dict[tuple[str, int], list[int]] = {}
            for i, k in enumerate(zip(labels, dims)):
                groups.setdefault(k, []).append(i)
            at, cells, home = [], [], []
            for k, members in groups.items():
                x = unit(np.frombuffer(b"".join(data[i] for i in members), np.float64).reshape(len(members), k[1]))
                i, cell, own = trees.get(k, whole).deal(x @ axes[k[1]][:, :TREE_AXES], reach)
                at.append(np.array(members)[i])
                cells.append(cell)
                home.append(own)
            place = pa.array(np.concatenate(at))
            arrays = [c.take(place) for c in b.columns]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(np.concatenate(cells), pa.int32()), pa.array(np.concatenate(home).astype(bool))], names=[*b.schema.names, "cell", "home"]
            )

    dealt = classes.select("key", "label", "dims", "vector", "id", "n").mapInArrow(
        deal, "key binary, label string, dims int, vector binary, id long, n long, cell int, home boolean"
    )
    dealt = stored(dealt, "dealt")
    cell = ["label", "dims", "cell"]
    per = tile(F.col("dims"))
    crowds = dealt.groupBy(*cell).agg(
        F.ceil(F.sum(F.col("home").cast("long")) / per).cast("int").alias("homes"), F.ceil(F.sum((~F.col("home")).cast("long")) / per).cast("int").alias("guests")
    )
    # Home tile t meets the home tiles up to itself, numbered from 0, and the tiles of guests, numbered from -1 down.
    placed = dealt.join(crowds.where((F.col("homes") > 1) | (F.col("guests") > 0)), cell, "left")
    homes, guests = F.coalesce("homes", F.lit(1)), F.coalesce("guests", F.lit(0))
    number = F.pmod(F.xxhash64("key"), F.when(F.col("home"), homes).otherwise(F.greatest(guests, F.lit(1)))).cast("int")
    placed = placed.withColumns({"homes": homes, "guests": guests, "tile": number})
    pair = lambda one, two: F.struct(one.cast("int").alias("one"), two.cast("int").alias("two"))
    with_homes = F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda o: pair(F.least(o, F.col("tile")), F.greatest(o, F.col("tile"))))
    with_guests = F.when(F.col("guests") > 0, F.transform(F.sequence(F.lit(1), F.col("guests")), lambda o: pair(-o, F.col("tile")))).otherwise(F.array().cast("array<struct<one: int, two: int>>"))
    as_guest = F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda o: pair(-1 - F.col("tile"), o))
    pairs = F.when(F.col("home"), F.concat(with_homes, with_guests)).otherwise(as_guest)
    side = F.when(F.col("home"), F.col("tile")).otherwise(-1 - F.col("tile")).alias("side")
    met = placed.select(*cell, side, F.explode(pairs).alias("pair"), "key", "id", "n", "vector").select(*cell, "pair.one", "pair.two", "side", "key", "id", "n", "vector")

    def compare(t: pa.Table) -> pa.Table:
        d = t.column("dims")[0].as_py()
        one, two = t.column("one")[0].as_py(), t.column("two")[0].as_py()
        keys, ids, n = t.column("key").to_pylist(), t.column("id").to_numpy(), t.column("n").to_numpy()
        x = unit(np.frombuffer(b"".join(t.column("vector").to_pylist()), np.float64).reshape(-1, d))
        side = t.column("side").to_numpy()
        first, second = np.flatnonzero(side == one), np.flatnonzero(side == two)
        links, forest = np.zeros(len(x), np.int64), Forest(len(x))
        for i, j in links_of(x[first], x[second], axes[d], threshold, one == two):
            i, j = first[i], second[j]
            links += np.bincount(i, n[j], len(x)).astype(np.int64) + np.bincount(j, n[i], len(x)).astype(np.int64)
            forest.join(i, j)
        some = np.flatnonzero(links)
        a, b = (ids[list(e)] for e in zip(*forest.edges)) if forest.edges else (ids[:0], ids[:0])
        return pa.table(
            [
                pa.array([keys[i] for i in some.tolist()] + [None] * len(a), pa.binary()),
                pa.array(links[some].tolist() + [None] * len(a), pa.int64()),
                pa.array([None] * len(some) + a.tolist(), pa.int64()),
                pa.array([None] * len(some) + b.tolist(), pa.int64()),
            ],
            names=["key", "links", "a", "b"],
        )

    found = stored(met.groupBy(*cell, "one", "two").applyInArrow(compare, FOUND), "links")
    links = found.where(F.col("key").isNotNull()).groupBy("key").agg(F.sum("links").alias("links"))
    # Rows that share an id are one vertex, whatever their vectors.
    edges = found.where(F.col("a").isNotNull()).select("a", "b")
    copies = usable_rows.hint("merge").join(classes.where("n > 1").select("key", F.col("id").alias("own")), "key").where(F.col("id") != F.col("own"))
    shared = copies.select(F.col("id").alias("a"), F.col("own").alias("b")).join(usable_rows.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("id").alias("a")), "a", "left_semi")
    groups = components(edges.unionByName(shared.distinct())).withColumnRenamed("id", "vertex")
    answers = classes.select("key", F.col("id").alias("vertex"), "n").join(links, "key", "left").join(groups, "vertex", "left")
    answers = answers.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "vertex").alias("class_component"))
    out = rows.select("id", "key").hint("merge").join(answers, "key", "left")
    component = F.coalesce("class_component", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )
