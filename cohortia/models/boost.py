"""Histogram boosting as Spark jobs, all models of a pack together.

A node with many rows is split by all tasks: each adds up gradients by (model, node, feature, bin) over
its own rows, one task per pair of siblings sums these histograms and finds the best splits, and the driver
receives one row per node.  A level's histograms stay distributed, so of two siblings only the one with fewer rows is
added up; the other is its parent less that.  Nodes with few rows wait until the large ones are done; then one job
sends the rows of each to one task, which grows the rest of the tree from there.

A model grown alone on many rows moves its margins on each round and keeps the bins of the tree's columns and the gradients
beside them, so the jobs of a round read these alone.  In packs of models that would be gradients per model and row, and on few
rows a round is one job: there the jobs add up the trees since margins were stored.

Gradients are whole numbers on a grid of 2^-20, so sums and trees depend neither on how the rows are
partitioned nor on where a node is grown.  Missing values are tried on both sides of every split.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .binning import BLOCK_FIELDS, BLOCK_ROWS, BLOCK_SCHEMA, MAX_BINS, bin_edges, binned, block, blocked, blocks, unpacked
from .params import BoostParams
from .ship import received, shipped

GRID_UNIT = 1 << 20
REFRESH_ROUNDS = 10
# Nodes of at most so many rows are grown to their leaves by one task; where all rows are many, nodes of a task's share
# of them up to the second number.
GROW_ROWS, MOST_GROW_ROWS = 1 << 20, 1 << 22
# Histograms of a level that the driver adds up itself, all parts together; more of them meet in a shuffle.
GATHER_BYTES = 16 << 20
# Rows a task holds before it sends them to the tasks that grow their nodes, and counts it holds of held-out scores.
SEND_ROWS = 1 << 18
LEAST_GAIN = 1e-6
# What the jobs of a round read of a model grown alone: bins of the tree's columns and gradients of the rows drawn.
READY_FIELDS = {"codes": np.uint8, "g": np.int32, "h": np.int32}
READY_SCHEMA = ", ".join(f"{name} binary" for name in READY_FIELDS)
# Curvature and rows are added up in one number: sums of curvature stay below this unit for so many rows.
COUNT_UNIT = 1 << 35
COUNT_ROWS = 1 << 16
TREE_SCHEMA = (
    "model_id int, tree int, node int, feature string, split_value double, default_left boolean, "
    "value double, gain double, cover double"
)


@dataclass(frozen=True)
class Fit:
    """One model to grow: its settings and the fold it does not see."""

    model_id: int
    params: BoostParams
    held_out: int | None = None


@dataclass
class Tree:
    """Nodes by heap position: children of i are 2i and 2i + 1; feature -1 marks a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    default_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    cover: np.ndarray
    columns: list[int] = field(default_factory=list)
    depth: int = 0

    @staticmethod
    def empty(max_depth: int, columns: list[int]) -> Tree:
        size = 2 << max_depth
        return Tree(
            np.full(size, -1, np.int32),
            np.zeros(size, np.int32),
            np.zeros(size, bool),
            np.zeros(size),
            np.zeros(size),
            np.zeros(size),
            columns,
        )


@dataclass
class Steps:
    """A tree as lookup tables: the feature of each inner node, and the node that follows each code of it."""

    feature: np.ndarray
    following: np.ndarray
    slots: int
    depth: int


def steps(tree: Tree, missing: int, own: bool = False) -> Steps:
    """With ``own`` for bins of the tree's columns alone."""
    # A node beyond these is a leaf of the last level.
    feature = tree.feature[: 1 << tree.depth, None]
    cut, default_left = tree.cut[: len(feature), None], tree.default_left[: len(feature), None]
    code, node = np.arange(missing + 1), np.arange(len(feature))[:, None]
    left = np.where(code == missing, default_left, code <= cut)
    following = np.where(feature >= 0, 2 * node + 1 - left, node)
    place = np.maximum(feature.ravel(), 0)
    if own:
        place = np.minimum(np.searchsorted(tree.columns, place), len(tree.columns) - 1)
    return Steps(place.astype(np.int64), following.ravel().astype(np.int64), missing + 1, tree.depth)


def descend(bins: np.ndarray, tree: Steps) -> np.ndarray:
    """Heap position of the node each row ends in; ``bins`` has one line per feature."""
    n = bins.shape[1]
    node, rows, codes = np.ones(n, np.int64), np.arange(n), bins.ravel()
    for _ in range(tree.depth):
        code = codes.take(tree.feature.take(node) * n + rows)
        node = tree.following.take(node * tree.slots + code)
    return node


def sampled(keys: np.ndarray, seed: int, turn: int, share: float) -> np.ndarray:
    """Rows drawn for one round, by a hash of the row and the round."""
    if share >= 1:
        return np.ones(len(keys), bool)
    with np.errstate(over="ignore"):
        mixed = keys.astype(np.uint64) + np.uint64((seed * 1_000_003 + turn * 7_919 + 1) % (1 << 63)) * np.uint64(
            0x9E3779B97F4A7C15
        )
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
        mixed ^= mixed >> np.uint64(31)
    return (mixed >> np.uint64(11)).astype(np.float64) / float(1 << 53) < share


class Sums:
    """Gradient, curvature and rows by cell, per column."""

    def __init__(self, columns: int, cells: int):
        self.done = np.zeros((3, columns, cells), np.int64)
        self.g = np.zeros((columns, cells))
        # Curvature, and rows in ``COUNT_UNIT``.
        self.both = np.zeros((columns, cells))
        self.rows = 0

    def add(self, cells: Sequence[np.ndarray], g: np.ndarray, h: np.ndarray) -> None:
        """At most ``BLOCK_ROWS`` rows, their cell per column."""
        if self.rows + len(g) > COUNT_ROWS:
            self._empty()
        self.rows += len(g)
        g, both = np.asarray(g, np.float64), h + float(COUNT_UNIT)
        for j, cell in enumerate(cells):
            self.g[j] += np.bincount(cell, g, self.g.shape[1])
            self.both[j] += np.bincount(cell, both, self.g.shape[1])

    def _empty(self) -> None:
        both = self.both.astype(np.int64)
        self.done += np.stack((self.g.astype(np.int64), both % COUNT_UNIT, both // COUNT_UNIT))
        self.g[:], self.both[:], self.rows = 0, 0, 0

    def cells(self) -> np.ndarray:
        self._empty()
        return self.done


def gradients(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1.0 / (1.0 + np.exp(-margin))
    return np.rint((p - y) * GRID_UNIT), np.rint(p * (1 - p) * GRID_UNIT)


class Boosting:
    """Models grown side by side on one set of binned rows."""

    def __init__(
        self,
        df: DataFrame,
        features: Sequence[str],
        label: str,
        row_id: str,
        fits: Sequence[Fit],
        seed: int = 7201,
        fold: str | None = None,
        max_bins: int = MAX_BINS,
        refresh: int = REFRESH_ROUNDS,
        edges: dict[str, list[float]] | None = None,
        grow_rows: int | None = None,
    ):
        self.spark = df.sparkSession
        self.features, self.fits, self.seed = list(features), list(fits), seed
        self.max_bins, self.refresh = max_bins, refresh
        self.edges = edges or bin_edges(df, self.features, label, max_bins)
        keyed = any(fit.params.subsample < 1 for fit in self.fits)
        rows = cut_lineage(blocked(binned(df, self.features, self.edges, row_id, label, fold, max_bins), len(self.fits), keyed, fold is not None))
        self.n_rows = rows.agg(F.sum(F.octet_length("y"))).first()[0] or 0
        self.n_rows //= np.dtype(BLOCK_FIELDS["y"]).itemsize
        tasks = self.spark.sparkContext.defaultParallelism
        self.grow_rows = max(GROW_ROWS, min(self.n_rows // tasks, MOST_GROW_ROWS)) if grow_rows is None else grow_rows
        self.alone = len(self.fits) == 1 and self.fits[0].held_out is None and self.n_rows > self.grow_rows
        self.parts = rows.rdd.getNumPartitions()
        if self.parts < tasks:
            rows, self.parts = rows.repartition(tasks), tasks
        self.rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        self.since_cut = 0
        self.active = [True] * len(self.fits)
        self.trees: list[list[Tree]] = [[] for _ in self.fits]
        # Trees already added to the stored margins.
        self.folded = [0] * len(self.fits)

    def close(self) -> None:
        self.rows.unpersist()

    def _recent(self) -> list[list[Tree]]:
        return [trees[done:] for trees, done in zip(self.trees, self.folded, strict=True)]

    def _columns(self, fit: Fit, turn: int) -> list[int]:
        """Features one tree may use."""
        total = len(self.features)
        take = max(1, int(total * fit.params.colsample_bytree))
        if take >= total:
            return list(range(total))
        rng = np.random.default_rng([self.seed, turn])
        return sorted(rng.permutation(total)[:take].tolist())

    def run(self, rounds: int) -> None:
        """Add one tree per round to every active model."""
        for _ in range(rounds):
            if not self.alone and max(map(len, self._recent())) >= self.refresh:
                self.fold_in()
            growing = {}
            for m, fit in enumerate(self.fits):
                if self.active[m]:
                    turn = len(self.trees[m])
                    growing[m] = Tree.empty(fit.params.max_depth, self._columns(fit, turn))
            before = self.rows
            if self.alone and growing:
                self._move(growing[0].columns)
            self._grow_large(growing)
            # The first job of the round has read all of them.
            if before is not self.rows:
                before.unpersist()
            for m, tree in growing.items():
                self.trees[m].append(tree)

    def _move(self, columns: list[int]) -> None:
        """Margins of a model grown alone with its last trees, and what the jobs of the next round read."""
        params, seed, missing, turn = self.fits[0].params, self.seed, self.max_bins, len(self.trees[0])
        shared = shipped(self.spark, self._recent()[0])
        start = math.log(params.base_score / (1 - params.base_score))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            recent = [(steps(tree, missing), tree.value) for tree in received(shared)]
            for keys, y, folds, bins, margins in blocks(batches):
                margin = margins[0]
                for tree, value in recent:
                    margin = margin + value.take(descend(bins, tree))
                ready = [bins[columns], *gradients(margin + start, y)]
                if params.subsample < 1:
                    drawn = np.flatnonzero(sampled(keys, seed, turn, params.subsample))
                    ready = [x.take(drawn, axis=-1) for x in ready]
                yield block(keys, y, folds, bins, margin, *ready, fields=BLOCK_FIELDS | READY_FIELDS)

        moved = self.rows.select(*BLOCK_FIELDS).mapInArrow(add, f"{BLOCK_SCHEMA}, {READY_SCHEMA}")
        self.since_cut += 1
        if self.since_cut > self.refresh:
            moved, self.since_cut = cut_lineage(moved), 0
        self.rows = moved.persist(StorageLevel.MEMORY_AND_DISK)
        self.folded = [len(self.trees[0])]

    def _grow_large(self, growing: dict[int, Tree]) -> None:
        """Level by level while nodes have many rows, then the subtrees of the others in one job."""
        small: dict[int, list[int]] = {}
        nodes = {m: [1] for m in growing}
        # Of the root only a bound is known.
        counts = {(m, 1): self.n_rows for m in growing}
        levels: list[DataFrame | dict] = []
        while nodes:
            large: dict[int, list[int]] = {}
            for m, some in nodes.items():
                for node in some:
                    (large if counts[m, node] > self.grow_rows else small).setdefault(m, []).append(node)
            if not large:
                break
            light = self._lighter(large, counts)
            level = next(iter(large.values()))[0].bit_length()
            deepest = level >= max(self.fits[m].params.max_depth for m in large)
            found = self._best_splits(growing, light, levels, keep=not deepest)
            nodes = self._grow(growing, large, found)
            for m, some in nodes.items():
                for node in some:
                    counts[m, node] = found[m, node // 2]["nr" if node % 2 else "nl"]
        for kept in levels:
            if isinstance(kept, DataFrame):
                kept.unpersist()
        if small:
            found = self._finish(growing, small, counts)
            while small:
                small = self._grow(growing, small, found)

    @staticmethod
    def _lighter(large: dict[int, list[int]], counts: dict) -> dict[int, list[int]]:
        """The nodes to add up: the root, or of each pair of siblings the one with fewer rows."""
        return {
            m: sorted({n if n == 1 else min((2 * (n // 2), 2 * (n // 2) + 1), key=lambda c: counts[m, c]) for n in nodes})  # noqa: B023
            for m, nodes in large.items()
        }

    def _grow(self, growing, open_nodes, found) -> dict[int, list[int]]:
        """Apply the level's splits; the nodes to look at next."""
        following: dict[int, list[int]] = {}
        for m, nodes in open_nodes.items():
            tree, params = growing[m], self.fits[m].params
            for node in nodes:
                row = found.get((m, node))
                if row is None:
                    continue
                if node == 1:
                    self._weigh(tree, 1, row["g"], row["h"], params)
                if row["feature"] is None:
                    continue
                tree.feature[node], tree.cut[node] = row["feature"], row["bin"]
                tree.default_left[node], tree.gain[node] = bool(row["default_left"]), row["gain"]
                level = node.bit_length()
                tree.depth = max(tree.depth, level)
                for child, g, h in ((2 * node, row["gl"], row["hl"]), (2 * node + 1, row["gr"], row["hr"])):
                    self._weigh(tree, child, g, h, params)
                    if level < params.max_depth:
                        following.setdefault(m, []).append(child)
        return following

    @staticmethod
    def _weigh(tree: Tree, node: int, g: int, h: int, params: BoostParams) -> None:
        tree.value[node] = -params.eta * (g / GRID_UNIT) / (h / GRID_UNIT + params.reg_lambda)
        tree.cover[node] = h / GRID_UNIT

    def _best_splits(self, growing: dict[int, Tree], light: dict[int, list[int]], levels: list[DataFrame | dict], keep: bool) -> dict:
        """Best splits of the light nodes and their siblings: one row per node.

        The sums of a pair's light node are added up and its other node is the parent's histogram in the last of ``levels`` less
        that; with ``keep`` the pairs' histograms become the next of them.  Few histograms are added up by the driver in a job of one
        stage; many by a task per pair, and they stay distributed down to the last level of the tree.
        """
        fits, missing = self.fits, self.max_bins
        columns = {m: tree.columns for m, tree in growing.items()}
        cells = self._histograms(growing, light)
        sent = self.parts * sum(len(nodes) * len(columns[m]) for m, nodes in light.items()) * 3 * 8 * (missing + 1)
        above = levels[-1] if levels else {}
        if sent <= GATHER_BYTES and not isinstance(above, DataFrame):
            summed, found, known = {}, {}, {}
            for row in cells.collect():
                key, part = (row["model"], row["node"]), cells_of(row["cells"], len(columns[row["model"]]))
                summed[key] = summed[key] + part if key in summed else part
            for (m, node), total in summed.items():
                for row, both in pair_splits(node, total, above.get((m, node >> 1)), columns[m], fits[m].params, missing):
                    found[m, row["node"]], known[m, row["node"]] = row, both
            if keep:
                levels.append(known)
            return found
        if isinstance(above, dict):
            above = self.spark.createDataFrame([(m, node, part.tobytes()) for (m, node), part in above.items()], "model int, node int, cells binary")
        cells = cells.unionByName(above.selectExpr("model", "node AS parent", "CAST(NULL AS INT) AS node", "cells"))

        def split(rows: pa.Table) -> pa.Table:
            m = rows.column("model")[0].as_py()
            light_node, summed, before = None, 0, None
            for node, data in zip(rows.column("node").to_pylist(), rows.column("cells").to_pylist(), strict=True):
                part = cells_of(data, len(columns[m]))
                if node is None:
                    before = part
                else:
                    light_node, summed = node, summed + part
            known = [] if light_node is None else pair_splits(light_node, summed, before, columns[m], fits[m].params, missing)
            known = [({**row, "model": m}, c.tobytes()) for row, c in known]
            table = {name: pa.array([row[name] for row, _ in known], kind) for name, kind in SPLIT_FIELDS}
            return pa.table({**table, "cells": pa.array([c for _, c in known], pa.binary())})

        dealt = self._dealt(cells, sum(map(len, light.values())), "model", "parent")
        found = dealt.groupBy("model", "parent").applyInArrow(split, f"{SPLIT_SCHEMA}, cells binary")
        if keep:
            levels.append(found.persist(StorageLevel.MEMORY_AND_DISK))
        return {(row["model"], row["node"]): row for row in found.drop("cells").collect()}

    def _dealt(self, df: DataFrame, groups: int, *keys: str) -> DataFrame:
        """Rows by group; no more tasks than groups, as a kept table would have all of them again in each later job."""
        return df.repartition(max(1, min(groups, int(self.spark.conf.get("spark.sql.shuffle.partitions")))), *keys)

    def _finish(self, growing: dict[int, Tree], small: dict[int, list[int]], counts: dict) -> dict:
        """The splits of all nodes below ``small``, each grown by the task that gets its rows: one Spark job."""
        fits, missing = self.fits, self.max_bins
        columns = {m: tree.columns for m, tree in growing.items()}
        source, reader = self._reader(growing, small)
        tasks, task_of = self._shares({(m, node): counts[m, node] for m, nodes in small.items() for node in nodes})

        def sent_parts(m: int, held: list) -> pa.RecordBatch:
            """One row per node, which holds the bytes of many."""
            at, own, g, h = (np.concatenate(x, axis=-1) for x in zip(*held, strict=True))
            order, ends = np.argsort(at, kind="stable"), np.cumsum(np.bincount(at))
            ends = ends[np.diff(ends, prepend=0) > 0]
            parts = [np.split(x.take(order, axis=-1), ends[:-1], axis=-1) for x in (own, g, h)]
            ids = np.asarray(small[m], np.int32)[at[order[ends - 1]]]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([task_of[m, node] for node in ids.tolist()], pa.int32()),
                    pa.array(np.full(len(ids), m, np.int32)),
                    pa.array(ids),
                    *[pa.array([x.tobytes() for x in some], pa.binary()) for some in parts],
                ],
                names=["task", "model", "node", "bins", "g", "h"],
            )

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, rows = {m: [] for m in small}, 0
            for m, at, own, g, h in reader(batches):
                inside = np.flatnonzero(at >= 0)
                if len(inside):
                    rows += len(inside)
                    codes = np.stack([line.take(inside) for line in own])
                    # Small numbers are sorted by their digits.
                    place = at.take(inside).astype(np.min_scalar_type(len(small[m])))
                    held[m].append((place, codes, g.take(inside).astype(np.int32), h.take(inside).astype(np.int32)))
                if rows >= SEND_ROWS:
                    yield from (sent_parts(k, parts) for k, parts in held.items() if parts)
                    held, rows = {k: [] for k in small}, 0
            yield from (sent_parts(k, parts) for k, parts in held.items() if parts)

        def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], list] = {}
            for batch in batches:
                for i, key in enumerate(zip(batch.column("model").to_pylist(), batch.column("node").to_pylist(), strict=True)):
                    held.setdefault(key, []).append([batch.column(name)[i].as_buffer() for name in ("bins", "g", "h")])
            while held:
                (m, node), parts = held.popitem()
                codes = np.concatenate([np.frombuffer(x, np.uint8).reshape(len(columns[m]), -1) for x, _, _ in parts], axis=1)
                g, h = (np.concatenate([np.frombuffer(part[k], np.int32) for part in parts]) for k in (1, 2))
                del parts
                found = grow_subtree(codes.T, g, h, node, columns[m], fits[m].params, missing)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([m] * len(found) if name == "model" else [r[name] for r in found], kind) for name, kind in SPLIT_FIELDS],
                    names=[name for name, _ in SPLIT_FIELDS],
                )

        sent = source.mapInArrow(send, "task int, model int, node int, bins binary, g binary, h binary")
        grown = sent.repartitionById(tasks, "task").mapInArrow(grow, SPLIT_SCHEMA)
        return {(row["model"], row["node"]): row for row in grown.collect()}

    def _shares(self, sizes: dict[tuple[int, int], int]) -> tuple[int, dict[tuple[int, int], int]]:
        """How many tasks grow nodes, and which of them each: the largest first, to the one with fewest rows.

        A task gets few rows more than the larger of a share of all and the largest node.
        """
        wanted = max(self.spark.sparkContext.defaultParallelism, -(-sum(sizes.values()) // max(1, self.grow_rows)))
        loads = [(0, task) for task in range(min(wanted, len(sizes)))]
        task_of = {}
        for key in sorted(sizes, key=lambda k: (-sizes[k], k)):
            load, task = heapq.heappop(loads)
            task_of[key] = task
            heapq.heappush(loads, (load + sizes[key], task))
        return len(loads), task_of

    def _reader(self, growing: dict[int, Tree], nodes: dict[int, list[int]]):
        """Rows, and a generator over their batches: per model the place of each row's node in ``nodes`` (-1: none), the bins
        of the tree's columns, and gradients."""
        fits, seed, missing, alone = self.fits, self.seed, self.max_bins, self.alone
        turns = {m: len(self.trees[m]) for m in growing}
        shared = shipped(self.spark, (growing, self._recent()))

        def read(batches: Iterator[pa.RecordBatch]):
            trees, recent = received(shared)
            where = {}
            for m, some in nodes.items():
                where[m] = np.full(len(trees[m].feature), -1, np.int64)
                where[m][some] = np.arange(len(some))
            grown = {m: steps(trees[m], missing, own=alone) for m in nodes}
            if alone:
                for codes, g, h in unpacked(batches, READY_FIELDS):
                    own = codes.reshape(len(trees[0].columns), -1)
                    yield 0, where[0].take(descend(own, grown[0])), own, g, h
                return
            done = {m: [(steps(tree, missing), tree.value) for tree in recent[m]] for m in nodes}
            for keys, y, folds, bins, margins in blocks(batches):
                # Models that draw the same rows share them.
                drawn, taken = {}, {}
                for m in nodes:
                    params, held_out = fits[m].params, fits[m].held_out
                    draw = (turns[m], params.subsample)
                    if draw not in drawn:
                        drawn[draw] = sampled(keys, seed, *draw) if params.subsample < 1 else np.ones(len(y), bool)
                    if (*draw, held_out) not in taken:
                        use = drawn[draw] if held_out is None else drawn[draw] & (folds != held_out)
                        rows = slice(None) if use.all() else np.flatnonzero(use)
                        taken[*draw, held_out] = rows, np.ascontiguousarray(bins[:, rows]), y[rows]
                    rows, own, truth = taken[*draw, held_out]
                    margin = margins[m, rows] + math.log(params.base_score / (1 - params.base_score))
                    for tree, value in done[m]:
                        margin = margin + value.take(descend(own, tree))
                    at = where[m].take(descend(own, grown[m]))
                    g, h = gradients(margin, truth)
                    yield m, at, [own[c] for c in trees[m].columns], g, h

        return (self.rows.select(*READY_FIELDS) if alone else self.rows), read

    def _histograms(self, growing: dict[int, Tree], open_nodes: dict[int, list[int]]) -> DataFrame:
        slots = self.max_bins + 1
        columns = {m: tree.columns for m, tree in growing.items()}
        source, reader = self._reader(growing, open_nodes)

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {m: Sums(len(columns[m]), len(nodes) * slots) for m, nodes in open_nodes.items()}
            for m, at, own, g, h in reader(batches):
                inside = np.flatnonzero(at >= 0)
                if len(inside) < len(at):
                    at, own, g, h = at.take(inside), [line.take(inside) for line in own], g.take(inside), h.take(inside)
                first = at * slots
                sums[m].add([first + line for line in own], g, h)
            for m, total in sums.items():
                by_node = total.cells().reshape(3, len(columns[m]), -1, slots).transpose(2, 0, 1, 3)
                used = [i for i, cells in enumerate(by_node) if cells[2].any()]
                ids = np.asarray(open_nodes[m], np.int32)[used]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(used), m, np.int32)),
                        pa.array(ids >> 1),
                        pa.array(ids),
                        pa.array([by_node[i].tobytes() for i in used], pa.binary()),
                    ],
                    names=["model", "parent", "node", "cells"],
                )

        return source.mapInArrow(add_up, "model int, parent int, node int, cells binary")

    def fold_in(self) -> None:
        """Add the recent trees to the stored margins, and cut the lineage there."""
        shared = shipped(self.spark, self._recent())
        missing = self.max_bins

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            recent = [[(steps(tree, missing), tree.value) for tree in trees] for trees in received(shared)]
            for keys, y, folds, bins, margins in blocks(batches):
                moved = margins.copy()
                for m, trees in enumerate(recent):
                    for tree, value in trees:
                        moved[m] += value.take(descend(bins, tree))
                yield block(keys, y, folds, bins, moved)

        old = self.rows
        moved = old.mapInArrow(add, BLOCK_SCHEMA)
        self.rows = cut_lineage(moved).persist(StorageLevel.MEMORY_AND_DISK)
        old.unpersist()
        self.folded = [len(trees) for trees in self.trees]

    def held_out_counts(self) -> DataFrame:
        """Class counts per (model, round, margin) on the rows each model does not see.

        Covers the rounds since margins were last stored.
        """
        counts = self.held_out_parts()
        return counts.groupBy("model", "round", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))

    def held_out_parts(self) -> DataFrame:
        """The held-out counts of each task; a task sends a margin once, or where it sees very many, a few times."""
        fits, missing, folded = self.fits, self.max_bins, list(self.folded)
        active = [m for m, on in enumerate(self.active) if on]
        shared = shipped(self.spark, self._recent())

        def merged(parts: list[tuple]) -> list[tuple]:
            """Counts of equal scores added up."""
            score, pos, size = (np.concatenate(x) for x in zip(*parts, strict=True))
            values, at = np.unique(score, return_inverse=True)
            return [(values, np.bincount(at, pos, len(values)), np.bincount(at, size, len(values)))]

        def sent(m: int, r: int, parts: list[tuple]) -> pa.RecordBatch:
            values, pos, size = parts[0]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(values), m, np.int32)),
                    pa.array(np.full(len(values), r, np.int32)),
                    pa.array(values),
                    pa.array(pos.astype(np.int64)),
                    pa.array((size - pos).astype(np.int64)),
                ],
                names=["model", "round", "score", "pos", "neg"],
            )

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            recent = [[(steps(tree, missing), tree.value) for tree in trees] for trees in received(shared)]
            held, waiting = {}, 0
            for _, y, folds, bins, margins in blocks(batches):
                unseen = {}
                for m in active:
                    fold = fits[m].held_out
                    if fold not in unseen:
                        rows = np.flatnonzero(folds == fold)
                        unseen[fold] = rows, np.ascontiguousarray(bins[:, rows]), y[rows]
                    rows, own, truth = unseen[fold]
                    margin = margins[m, rows]
                    for r, (tree, value) in enumerate(recent[m], folded[m] + 1):
                        margin = margin + value.take(descend(own, tree))
                        held.setdefault((m, r), []).append((margin, truth, np.ones(len(margin))))
                        waiting += len(margin)
                if waiting >= SEND_ROWS:
                    held = {key: merged(parts) for key, parts in held.items()}
                    waiting = sum(len(parts[0][0]) for parts in held.values())
                    # Few distinct scores are kept for the next blocks.
                    if waiting >= SEND_ROWS // 2:
                        yield from (sent(*key, parts) for key, parts in held.items())
                        held, waiting = {}, 0
            yield from (sent(*key, merged(parts)) for key, parts in held.items())

        return self.rows.mapInArrow(score, "model int, round int, score double, pos bigint, neg bigint")

    def tree_rows(self) -> DataFrame:
        """All grown trees, one row per node."""
        rows = []
        for fit, trees in zip(self.fits, self.trees, strict=True):
            for t, tree in enumerate(trees):
                rows += _node_rows(fit.model_id, t, tree, self.features, self.edges)
        return self.spark.createDataFrame(rows, TREE_SCHEMA)


def _node_rows(model_id: int, t: int, tree: Tree, features: Sequence[str], edges) -> list[tuple]:
    rows, waiting = [], [1]
    while waiting:
        node = waiting.pop()
        f = int(tree.feature[node])
        cover = float(tree.cover[node])
        if f < 0:
            rows.append((model_id, t, node, None, None, None, float(tree.value[node]), None, cover))
            continue
        known = edges[features[f]]
        cut = int(tree.cut[node])
        value = float(known[cut]) if cut < len(known) else math.inf
        rows.append(
            (model_id, t, node, features[f], value, bool(tree.default_left[node]), None, float(tree.gain[node]), cover)
        )
        waiting += [2 * node, 2 * node + 1]
    return rows


# What is known of a split, one row per node; no feature where none is good enough.
SPLIT_FIELDS = [
    ("model", pa.int32()), ("node", pa.int32()), ("g", pa.int64()), ("h", pa.int64()), ("feature", pa.int32()),
    ("bin", pa.int32()), ("default_left", pa.int32()), ("gain", pa.float64()),
    *[(name, pa.int64()) for name in ("gl", "hl", "gr", "hr", "nl", "nr")],
]
SPLIT_SCHEMA = (
    "model int, node int, g bigint, h bigint, feature int, bin int, default_left int, gain double, "
    "gl bigint, hl bigint, gr bigint, hr bigint, nl bigint, nr bigint"
)


def best_split(cells: np.ndarray, node: int, columns: Sequence[int], params: BoostParams, missing: int) -> dict | None:
    """The best split of a node from its sums of g, h and rows by feature and bin; no feature where none is good enough.

    Ties go to the first feature, the lowest bin and, for missing values, the right side.
    """

    def squared(x, y):
        return np.square(x / GRID_UNIT) / (y / GRID_UNIT + params.reg_lambda)

    total = cells[:, 0].sum(axis=1)
    if total[1] <= 0:
        return None
    left = np.cumsum(cells, axis=2)[:, :, :missing]
    # Missing values on the right, then on the left.
    left = np.stack((left, left + cells[:, :, missing:]), axis=3)
    right = total[:, None, None, None] - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = squared(left[0], left[1]) + squared(right[0], right[1]) - squared(total[0], total[1])
    fits = (cells[2, :, :missing, None] > 0) & (left[1] > 0) & (right[1] > 0)
    fits &= np.minimum(left[1], right[1]) >= params.min_child_weight * GRID_UNIT
    fits &= (gain > LEAST_GAIN) & (gain >= params.gamma)
    row = dict.fromkeys([name for name, _ in SPLIT_FIELDS])
    row |= {"node": node, "g": int(total[0]), "h": int(total[1])}
    if fits.any():
        f, b, side = (int(i) for i in np.unravel_index(np.argmax(np.where(fits, gain, -np.inf)), gain.shape))
        row |= {"feature": int(columns[f]), "bin": b, "default_left": side, "gain": float(gain[f, b, side])}
        for i, name in enumerate("ghn"):
            row |= {f"{name}l": int(left[i, f, b, side]), f"{name}r": int(right[i, f, b, side])}
    return row


def cells_of(data: bytes, columns: int) -> np.ndarray:
    """Sums of g, h and rows by column and bin."""
    return np.frombuffer(data, np.int64).reshape(3, columns, -1)


def pair_splits(
    node: int, summed: np.ndarray, parent: np.ndarray | None, columns: Sequence[int], params: BoostParams, missing: int
) -> list[tuple[dict, np.ndarray]]:
    """The best splits of a node and, with the parent's sums, of its sibling, beside their sums."""
    pair = [(node, summed)] if parent is None else [(node, summed), (node ^ 1, parent - summed)]
    known = [(best_split(cells, n, columns, params, missing), cells) for n, cells in pair]
    return [(row, cells) for row, cells in known if row is not None]


def grow_subtree(bins: np.ndarray, g: np.ndarray, h: np.ndarray, top: int, columns: Sequence[int], params: BoostParams, missing: int) -> list[dict]:
    """The splits of ``top`` and all nodes below it, as the level jobs find them.

    ``bins`` has one line per row and the tree's ``columns`` only.  Of two siblings only the one with fewer rows is added up.
    """
    codes = np.ascontiguousarray(bins.T)

    def histogram(rows: np.ndarray) -> np.ndarray:
        sums = Sums(len(codes), missing + 1)
        for first in range(0, len(rows), BLOCK_ROWS):
            some = rows[first : first + BLOCK_ROWS]
            sums.add([line.take(some) for line in codes], g.take(some), h.take(some))
        return sums.cells()

    found = []
    everything = np.arange(len(bins))
    waiting = [(top, everything, histogram(everything))]
    while waiting:
        node, rows, cells = waiting.pop()
        row = best_split(cells, node, columns, params, missing)
        if row is None:
            continue
        found.append(row)
        if row["feature"] is None or node.bit_length() >= params.max_depth:
            continue
        code = codes[list(columns).index(row["feature"])].take(rows)
        goes = np.where(code == missing, bool(row["default_left"]), code <= row["bin"])
        one, two = rows.compress(goes), rows.compress(~goes)
        light = histogram(one if len(one) <= len(two) else two)
        rest = cells - light
        first, second = (light, rest) if len(one) <= len(two) else (rest, light)
        waiting += [(2 * node, one, first), (2 * node + 1, two, second)]
    return found


def fit_boost(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    row_id: str,
    params: BoostParams,
    rounds: int,
    seed: int = 7201,
    max_bins: int = MAX_BINS,
    grow_rows: int | None = None,
) -> DataFrame:
    """Train one model; the result is its trees, one row per node."""
    job = Boosting(df, features, label, row_id, [Fit(0, params)], seed, max_bins=max_bins, grow_rows=grow_rows)
    try:
        job.run(rounds)
        return job.tree_rows()
    finally:
        job.close()
