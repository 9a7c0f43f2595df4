"""Regression trees on binned bytes: one engine for bagged, boosted and penalised boosted trees.

The training table is written once as blocks of packed arrays: a byte per feature (the bin of the value), a hash
of the key, and the target as a whole number (a power of two times the value). A pass over the blocks walks the
trees grown so far, adds up weight and residual per (node, feature, bin) in every task, and the best cut of a
node is read off the sums. Sums of whole numbers do not depend on the order of rows, so a model follows from the
data alone, whatever the layout, the cluster or a retry.

Several fits (folds, prepared tables) and all trees of a forest grow in the same passes, level by level, so five
folds cost as many jobs as one. A node with at most LOCAL_ROWS rows leaves the
passes: its rows go to one task, once, which grows the whole subtree below it by the same rule. So the number of
passes follows from the table's size and not from the depth, and no task ever holds more rows of a node than that
(up to LOCAL_TREES times as many where there are trees for all cores). The rows of some trees at a time are dealt,
and what they took on disk is given back. Boosted trees see what is left of the target, which is written to the shared folder every few trees.

Per-node arrays are added up and grouped with RDD operations, since the partials are arrays of numbers that SQL
aggregates cannot add; rows themselves stay in the written table.

Bins: a feature with at most ``max_bins`` values is cut between any two of them; others are cut at quantiles of
at most EDGE_ROWS rows, those whose key hashes lowest, which is all rows of a smaller table. Missing values (NaN, null)
go with the largest bin. Rows without a target are left out.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.session import materialise, scratch_done, scratch_path

#: Rows of a node that one task takes to grow the subtree below it, for each tree that every core has to grow, up to
#: so many trees.
LOCAL_ROWS, LOCAL_TREES = 1 << 16, 16
#: Rows that are dealt to subtrees at a time, or twice the table's rows if that is more. What they took on disk is
#: given back before the next are dealt.
LOT_ROWS = 1 << 25
#: Rows that choose the bin edges.
EDGE_ROWS = 200_000
#: Rows of a block, about, and of a partition of blocks at least and at most.
BLOCK_ROWS, PART_ROWS, MOST_ROWS = 1 << 16, 1 << 14, 1 << 20
#: Bytes of sums that a task holds; more nodes take several passes.
SUM_BYTES = 64 << 20
#: Bytes of sums of all tasks that the driver adds up itself; beyond it they are reduced on the executors.
DRIVER_BYTES = 64 << 20
#: Slots (node, bin) for every row of a task up to which they are counted in an array, and up to which the empty ones
#: are worked on as well.
SLOTS_A_ROW, FULL_A_ROW = 8, 1
#: Rows for every slot (node, bins of several features) from which these features are counted together.
ROWS_A_SLOT = 4
#: Levels of a subtree after which its rows are put in order of their nodes, and rows (of one node at least) that then
#: go on by themselves, so that what they need stays in a core's cache.
ORDER_EVERY, NEAR_ROWS = 3, 1 << 16
#: Boosted trees between two rewrites of the running prediction.
REWRITE_EVERY = 10
_BLOCKS = "fit int, n int, bins binary, hashes binary, residual binary"
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


@dataclass(frozen=True)
class Rules:
    """How nodes are cut and rows sampled."""

    depth: int
    split_rows: int = 2
    leaf_rows: int = 1
    l1: float = 0.0
    l2: float = 0.0
    least_gain: float = 0.0
    shrink: float = 1.0
    #: "all" rows; "bag": each row a Poisson(1) number of times; "share": each row with probability ``share``.
    sampling: str = "all"
    share: float = 1.0
    seed: int = 0


# --- the written table -----------------------------------------------------------------------


@dataclass
class Member:
    """What it takes to read the bins and whole numbers of one fit's rows."""

    n: int
    features: list[str]
    edges: list[np.ndarray]
    base: int
    unit: float


@dataclass
class Binned:
    """Blocks of the training tables of one or more fits over the same features."""

    blocks: DataFrame
    parts: int
    members: list[Member]

    def rows(self):
        """Blocks (fit, bins, hashes, what the mean leaves of the target) as arrays, kept on the executors' disks, so that
        their memory does not grow with the table; those that are lost are read again from the written table."""
        p = len(self.members[0].features)

        def read(row):
            hashes, residual = (np.frombuffer(row[c], np.int64) for c in ("hashes", "residual"))
            return row["fit"], np.frombuffer(row["bins"], np.uint8).reshape(p, row["n"]), hashes, residual

        return self.blocks.rdd.map(read).persist(StorageLevel.DISK_ONLY)

    @property
    def offsets(self) -> np.ndarray:
        """First slot of each feature's bins in a row of sums, wide enough for every fit."""
        widths = [[len(e) + 1 for e in m.edges] for m in self.members]
        return np.cumsum([0, *map(max, zip(*widths, strict=True))])


def together(tables: Sequence[Binned]) -> Binned:
    """The tables of several fits as one, to be trained in the same passes."""
    blocks, members, parts = None, [], 0
    for table in tables:
        own = table.blocks.withColumn("fit", F.col("fit") + len(members))
        blocks = own if blocks is None else blocks.unionByName(own)
        members, parts = members + table.members, parts + table.parts
    return Binned(blocks, parts, members)


def to_bins(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin of every value, a row for each feature: the number of edges below it; NaN is largest."""
    return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)]).astype(np.uint8)


def cut_points(values: np.ndarray, bins: int) -> np.ndarray:
    """Midpoints of neighbouring values; with more than ``bins`` values, those next to the quantiles."""
    v, counts = np.unique(values, return_counts=True)
    at = np.arange(len(v) - 1)
    if len(v) > bins:
        marks = np.arange(1, bins) * (counts.sum() / bins)
        at = np.unique(np.minimum(np.searchsorted(np.cumsum(counts), marks), len(v) - 2))
    return (v[at] + v[at + 1]) / 2


def _edges(rows: DataFrame, features: list[str], n: int, bins: int) -> list[np.ndarray]:
    if n > EDGE_ROWS:
        limit = -(2**63) + int(2**64 * (EDGE_ROWS / n))
        rows = rows.where(F.col("h") < limit)
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f).alias("v")) for i, f in enumerate(features)])
    values = rows.select(F.explode(pairs).alias("p")).select("p.*").where("v IS NOT NULL AND NOT isnan(v)")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [pdf["i"].iloc[0]], "e": [cut_points(pdf["v"].to_numpy(), bins)]})

    found = {r["i"]: r["e"] for r in values.groupBy("i").applyInPandas(one, "i int, e array<double>").collect()}
    return [np.array(found.get(i, []), float) for i in range(len(features))]


def _pack(edges: list[np.ndarray], base: int):
    def blocks(given: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        some, rows = [], 0
        for batch in given:
            some, rows = [*some, batch], rows + batch.num_rows
            if rows >= BLOCK_ROWS:
                yield pa.Table.from_batches(some).combine_chunks()
                some, rows = [], 0
        if rows:
            yield pa.Table.from_batches(some).combine_chunks()

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in blocks(given):
            for low in range(0, whole.num_rows, 2 * BLOCK_ROWS):
                part = whole.slice(low, 2 * BLOCK_ROWS)
                columns = [part.column(i).to_numpy() for i in range(2, part.num_columns)]
                bins = to_bins(np.stack(columns, axis=1).astype(float), edges)
                packed = [bins, np.asarray(part.column(0)), np.asarray(part.column(1)) - base]
                values = [pa.array([a.tobytes()], pa.binary()) for a in packed]
                names = ["fit", "n", "bins", "hashes", "residual"]
                sizes = [pa.array([0], pa.int32()), pa.array([part.num_rows], pa.int32())]
                yield pa.RecordBatch.from_arrays([*sizes, *values], names)

    return run


def binned(df: DataFrame, key: str, features: Sequence[str], target: str, max_bins: int = 256) -> Binned:
    """Bins the rows and writes them to the shared folder."""
    features = list(features)
    rows = df.select(
        F.xxhash64(F.col(key).cast("string")).alias("h"),
        F.col(target).cast("double").alias("y"),
        *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)],
    ).where("y IS NOT NULL AND NOT isnan(y)")
    raw = scratch_path(df.sparkSession, "train")
    rows.write.parquet(raw)
    rows = df.sparkSession.read.schema(rows.schema).parquet(raw)
    n, largest = rows.agg(F.count("*"), F.max(F.abs("y"))).first()
    if n and math.isinf(largest):
        raise ValueError(f"{target} holds infinite values")
    # Sums over all rows stay below 2^62, those of one task's node below 2^53.
    bits = min(33, 60 - n.bit_length()) - (math.frexp(largest)[1] if n and largest else 0)
    unit = 2.0**-bits
    whole = F.round(F.col("y") * 2.0**bits).cast("long")
    rows = rows.withColumn("y", whole)
    total = int(rows.agg(F.sum(F.col("y").cast("decimal(38,0)"))).first()[0] or 0)
    base = (2 * total + n) // (2 * n) if n else 0
    edges = _edges(rows, [f"f{i}" for i in range(len(features))], n, max_bins)
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(math.ceil(n / PART_ROWS), cores), math.ceil(n / MOST_ROWS))
    # Dealt by what they hold: round robin would sort all rows first.
    dealt = rows.repartition(parts, *rows.columns)
    blocks = materialise(dealt.mapInArrow(_pack(edges, base), _BLOCKS), "blocks")
    scratch_done(df.sparkSession.sparkContext, raw)
    return Binned(blocks, parts, [Member(n, features, edges, base, unit)])


# --- trees -----------------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes as parallel lists; node 0 is the root, children lie next to each other, feature -1 is a leaf.

    Values are whole numbers in the table's unit."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[int] = field(default_factory=lambda: [0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, gain: float, values: Sequence[int]) -> int:
        self.feature[node], self.cut[node], self.gain[node], self.left[node] = feature, cut, gain, len(self.feature)
        self.feature += [-1, -1]
        self.cut += [0, 0]
        self.left += [0, 0]
        self.value += list(values)
        self.gain += [0.0, 0.0]
        return self.left[node]

    def arrays(self) -> tuple[np.ndarray, ...]:
        kinds = ((self.feature, np.int16), (self.cut, np.uint8), (self.left, np.int32), (self.value, np.int64), (self.gain, float))
        return tuple(np.array(v, k) for v, k in kinds)

    def grown(self, below: Sequence[tuple[int, Grown]]) -> Grown:
        """The whole tree, with subtrees, whose node 0 is a node of this one, in their places."""
        if len(below) == 1 and len(self.feature) == 1:
            return below[0][1]
        top = self.arrays()
        parts, size = [top], len(top[0])
        for node, made in below:
            new = made.nodes()
            new[2][new[2] > 0] += size - 1
            for own, values in zip(top, new, strict=True):
                own[node] = values[0]
            parts.append(tuple(values[1:] for values in new))
            size += len(new[0]) - 1
        return Grown.of(*map(np.concatenate, zip(*parts, strict=True)))


class Grown(NamedTuple):
    """A whole tree in few bytes: ``left`` of a leaf is its place among the leaves' values; gains are those of inner nodes."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def of(cls, feature, cut, left, value, gain) -> Grown:
        """From arrays with an entry for every node."""
        leaf, left = feature < 0, left.astype(np.int32)
        left[leaf] = np.arange(np.count_nonzero(leaf))
        return cls(feature.astype(np.int16), cut.astype(np.uint8), left, value[leaf].astype(np.int64), gain[~leaf].astype(float))

    def nodes(self) -> tuple[np.ndarray, ...]:
        """Arrays with an entry for every node: feature, cut, left, value, gain."""
        leaf = self.feature < 0
        left, value, gain = np.where(leaf, 0, self.left), np.zeros(len(leaf), np.int64), np.zeros(len(leaf))
        value[leaf], gain[~leaf] = self.value, self.gain
        return self.feature.copy(), self.cut.copy(), left, value, gain

    def values(self, bins: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Value of the leaf that each of the rows reaches."""
        return self.value.take(self.left.take(walk(bins, self, rows)))


def walk(bins: np.ndarray, tree: tuple, rows: np.ndarray) -> np.ndarray:
    """Node that each of the rows reaches. All rows take a step at a time; at a leaf they stay."""
    feature, cut, left = tree[:3]
    node = np.zeros(len(rows), np.int64)
    inner = feature >= 0
    by = np.where(inner, feature, 0).astype(np.int64) * bins.shape[1]
    high = np.where(inner, cut, 255).astype(np.uint8)
    down = np.where(inner, left, np.arange(len(feature))).astype(np.int64)
    flat, steps = bins.reshape(-1), _depth(feature, left)
    for _ in range(steps):
        value = flat.take(by.take(node) + rows)
        above = value > high.take(node)
        node = down.take(node)
        node += above
    return node.astype(np.int32)


def _depth(feature: np.ndarray, left: np.ndarray) -> int:
    """Steps from the root to the deepest leaf."""
    level, depth = np.zeros(1, np.int64), 0
    while True:
        level = level[feature[level] >= 0]
        if not len(level):
            return depth
        level = np.concatenate([left[level], left[level] + 1]).astype(np.int64)
        depth += 1


def _mixed(hashes: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """A number below 2^64 per row and tree, from the key's hash: equal on every retry."""
    mixed = hashes.view(np.uint64) ^ np.uint64((0x9E3779B97F4A7C15 * (tree + 1) + seed) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        mixed ^= mixed >> np.uint64(shift)
        if factor > 1:
            mixed *= np.uint64(factor)
    return mixed


def _limit(share: float) -> int:
    """The lowest number below 2^64 whose first 53 bits, as a fraction, are not below ``share``."""
    return math.ceil(share * 2.0**53) << 11


#: Numbers from which a row counts once, twice and so on.
_TIMES = np.array([limit for limit in map(_limit, _POISSON) if limit < 2**64], np.uint64)


def _sample(hashes: np.ndarray, tree: int, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a tree and how often each counts."""
    if rules.sampling == "bag":
        mixed = _mixed(hashes, tree, rules.seed)
        rows = np.flatnonzero(mixed >= _TIMES[0])
        mixed, times = mixed.take(rows), np.ones(len(rows), np.uint8)
        for limit in _TIMES[1:5]:
            times += mixed >= limit
        often = np.flatnonzero(times == 5)
        times[often] = np.searchsorted(_TIMES, mixed.take(often), side="right")
        return rows, times.astype(np.int64)
    if rules.sampling == "share" and rules.share < 1.0:
        rows = np.flatnonzero(_mixed(hashes, tree, rules.seed) < np.uint64(_limit(rules.share)))
    else:
        rows = np.arange(len(hashes))
    return rows, np.ones(len(rows), np.int64)


# --- the best cut ----------------------------------------------------------------------------


@dataclass
class Cuts:
    """Best cut of every node: feature -1 if there is none; sums of the whole node and left of the cut."""

    feature: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    total: np.ndarray
    left: np.ndarray

    @classmethod
    def none(cls, total: np.ndarray) -> Cuts:
        k = total.shape[1]
        return cls(np.full(k, -1, np.int32), np.zeros(k, np.int64), np.full(k, -np.inf), total, np.zeros((3, k), np.int64))

    def better(self, nodes: np.ndarray, feature: int, cut: np.ndarray, gain: np.ndarray, left: np.ndarray) -> None:
        """Takes the cuts that beat those found before; on a tie the first feature and the lowest cut stay."""
        won = gain > self.gain[nodes]
        nodes = nodes[won]
        self.feature[nodes], self.cut[nodes], self.gain[nodes] = feature, cut[won], gain[won]
        self.left[:, nodes] = left[:, won]


def _score(g: np.ndarray, h: np.ndarray, rules: Rules, unit) -> np.ndarray:
    g = g * unit
    if rules.l1:
        g = np.sign(g) * np.maximum(np.abs(g) - rules.l1, 0.0)
    weight = h + rules.l2 if rules.l2 else h
    if weight.size and weight.min() > 0:
        g *= g
        g /= weight
        return g
    return np.divide(g * g, weight, out=np.zeros(g.shape), where=weight > 0)


def _gain(left, right, rows: np.ndarray, whole: np.ndarray, rules: Rules, unit) -> np.ndarray:
    """Gain of cuts from sums (residual, weight, rows) on both sides, the rows and the score of the whole node; -inf if
    not allowed."""
    sides = _score(left[0], left[1], rules, unit)
    sides += _score(right[0], right[1], rules, unit)
    gain = sides - whole
    # Rounding of the two squares is no gain.
    sides *= 1e-12
    allowed = gain > np.maximum(rules.least_gain, sides, out=sides)
    allowed &= (left[2] >= rules.leaf_rows) & (right[2] >= rules.leaf_rows) & (rows >= rules.split_rows)
    gain[~allowed] = -np.inf
    return gain


def cuts_from_sums(sums: np.ndarray, offsets: np.ndarray, rules: Rules, unit: np.ndarray, allowed: np.ndarray) -> Cuts:
    """Best cuts from sums [3, nodes, bins of all features]; ``unit`` [nodes], ``allowed`` [nodes, features]."""
    first = sums[:, :, offsets[0] : offsets[1]].sum(axis=2)
    found, whole = Cuts.none(first), _score(first[0], first[1], rules, unit)
    for f in range(len(offsets) - 1):
        low, high = offsets[f], offsets[f + 1]
        nodes = np.flatnonzero(allowed[:, f])
        if high - low < 2 or not len(nodes):
            continue
        every = len(nodes) == len(allowed)
        left = np.cumsum(sums[:, :, low : high - 1] if every else sums[:, nodes, low : high - 1], axis=2)
        total = first[:, nodes, None]
        gain = _gain(left, total - left, total[2], whole[nodes, None], rules, unit[nodes, None])
        at = gain.argmax(axis=1)
        pick = np.arange(len(nodes))
        found.better(nodes, f, at, gain[pick, at], left[:, pick, at])
    return found


#: Bits that hold a count of rows next to the sum of their weights.
_COUNT_BITS = 27


class _Adder:
    """Exact sums of (weighted residual, weight, 1) of rows per slot, two additions a row.

    Counts share a number with the weights. Sums of residuals stay below 2^53, or they are added in two parts."""

    def __init__(self, values: np.ndarray):
        self.residual, weight = values[0].astype(np.float64), values[1]
        self.exact = np.abs(self.residual).sum() < 2.0**52
        self.one = bool((weight == 1).all())
        self.apart = None
        if not self.one:
            if len(weight) >> _COUNT_BITS or int(weight.max()) * len(weight) >= 1 << (52 - _COUNT_BITS):
                self.apart = weight.astype(np.float64)
            else:
                self.both = weight * float(1 << _COUNT_BITS) + 1.0

    def take(self, rows: np.ndarray) -> _Adder:
        """The adder of some of the rows, or of all in another order."""
        made = object.__new__(_Adder)
        made.__dict__.update({k: v[rows] if isinstance(v, np.ndarray) else v for k, v in self.__dict__.items()})
        return made

    def residuals(self, slot: np.ndarray, size: int, some=slice(None)) -> np.ndarray:
        if self.exact:
            return np.bincount(slot, self.residual, size)[some].astype(np.int64)
        high = np.floor(self.residual * 2.0**-26)
        low = self.residual - high * 2.0**26
        return sum(np.bincount(slot, v, size)[some].astype(np.int64) * f for v, f in ((high, 1 << 26), (low, 1)))

    def weights(self, slot: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the weights and numbers of rows."""
        if self.one or self.apart is not None:
            counts = np.bincount(slot, minlength=size)
            return (counts if self.one else np.bincount(slot, self.apart, size).astype(np.int64)), counts
        both = np.bincount(slot, self.both, size).astype(np.int64)
        return both >> _COUNT_BITS, both & ((1 << _COUNT_BITS) - 1)


def cuts_from_rows(
    bins: np.ndarray, node: np.ndarray, values, k: int, rules: Rules, unit: float, allowed: np.ndarray
) -> Cuts:
    """The same cuts from the (node, bin) slots that rows lie in: the gains follow the rows, however many nodes there are.

    ``values`` holds weighted residual, weight and 1 of every row. With many more slots than rows they are numbered anew by sorting."""
    add = values if isinstance(values, _Adder) else _Adder(values)
    at = node.astype(np.int64)
    total = np.stack([add.residuals(at, k), *add.weights(at, k)])
    found, whole = Cuts.none(total), _score(total[0], total[1], rules, unit)
    before = np.cumsum(total, axis=1) - total
    after = before + total
    for f in np.flatnonzero(allowed):
        shift = int(bins[f].max(initial=0)).bit_length()
        wide = 1 << shift
        slot = at << shift
        slot += bins[f]
        if k * wide > SLOTS_A_ROW * len(at):
            seen, slot = np.unique(slot, return_inverse=True)
            (heavy, counts), some = add.weights(slot, len(seen)), slice(None)
        else:
            heavy, counts = add.weights(slot, 0)
            seen = some = np.flatnonzero(counts)
        one, heavy, counts = heavy is counts, heavy[some], np.cumsum(counts[some])
        heavy = counts if one else np.cumsum(heavy)
        sums = np.cumsum(add.residuals(slot, 0, some))
        own = seen >> shift
        # The last slot of a node leaves nothing on the right.
        ends = np.flatnonzero(own[1:] == own[:-1])
        if not len(ends):
            continue
        own, seen = own.take(ends), seen.take(ends)
        upto = [sums.take(ends), heavy.take(ends), counts.take(ends)]
        left = [u - b.take(own) for u, b in zip(upto, before, strict=True)]
        right = [a.take(own) - u for u, a in zip(upto, after, strict=True)]
        gain = _gain(left, right, total[2].take(own), whole.take(own), rules, unit)
        firsts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        most = np.maximum.reduceat(gain, firsts)
        best = np.flatnonzero(gain == np.repeat(most, np.diff(np.append(firsts, len(own)))))
        best = best[np.append(True, own[best][1:] != own[best][:-1])]
        own, bin_ = own[best], seen[best] & (wide - 1)
        found.better(own, f, bin_, gain[best], np.stack([side[best] for side in left]))
    return found


def _cuts(bins, node: np.ndarray, add: _Adder, k: int, rules: Rules, unit: float, offsets, allowed) -> Cuts:
    """Best cuts of nodes 0 to k - 1 from their rows: features of few bins by all their slots, the others by those with rows."""
    widths, n = np.diff(offsets), len(node)
    few = k * widths <= FULL_A_ROW * n
    full = np.flatnonzero(allowed & few)
    if not len(full):
        return cuts_from_rows(bins, node, add, k, rules, unit, allowed)
    own = np.cumsum([0, *widths[full]])
    sums = _sums(bins if len(full) == len(bins) else bins[full], np.arange(n), node, add, k, own)
    found = cuts_from_sums(sums, own, rules, np.full(k, unit), np.ones((k, len(full)), bool))
    found.feature = np.where(found.feature >= 0, full[found.feature], -1).astype(np.int32)
    if (allowed & ~few).any():
        other = cuts_from_rows(bins, node, add, k, rules, unit, allowed & ~few)
        won = (other.gain > found.gain) | ((other.gain == found.gain) & (other.feature >= 0) & (other.feature < found.feature))
        for name in ("feature", "cut", "gain"):
            getattr(found, name)[won] = getattr(other, name)[won]
        found.left[:, won] = other.left[:, won]
    return found


def _groups(widths: Sequence[int], k: int, n: int) -> list[tuple[int, ...]]:
    """Features that are counted together, so that ``n`` rows outnumber the slots (node, bins of the features)."""
    groups: list[tuple[list[int], int]] = []
    for f in np.argsort(widths, kind="stable")[::-1]:
        for i, (own, slots) in enumerate(groups):
            if slots * widths[f] * k * ROWS_A_SLOT <= n:
                groups[i] = [*own, int(f)], slots * int(widths[f])
                break
        else:
            groups.append(([int(f)], int(widths[f])))
    return [tuple(own) for own, _ in groups]


def _joint(bins: np.ndarray, group: tuple[int, ...], widths: Sequence[int]) -> np.ndarray:
    """Number of the combination of bins that a row has in the features of a group."""
    code = bins[group[0]]
    for f in group[1:]:
        code = code.astype(np.int32) * np.int32(widths[f]) + bins[f]
    return code


def _sums(bins, rows, node, values, k: int, offsets: np.ndarray, joint: dict | None = None) -> np.ndarray:
    """Sums [3, k, bins] of rows at nodes 0 to k - 1. ``joint`` keeps the combinations of bins of the same rows."""
    add, every = values if isinstance(values, _Adder) else _Adder(values), len(rows) == bins.shape[1]
    widths, joint = np.diff(offsets).tolist(), {} if joint is None else joint
    out, at = np.zeros((3, k, offsets[-1]), np.int64), node.astype(np.int64)
    for group in _groups(widths, k, len(rows)):
        if group not in joint:
            joint[group] = _joint(bins, group, widths)
        sides = [widths[f] for f in group]
        wide = math.prod(sides)
        slot = at * wide
        slot += joint[group] if every else joint[group].take(rows)
        for c, sums in enumerate((add.residuals(slot, k * wide), *add.weights(slot, k * wide))):
            sums = sums.reshape(k, *sides)
            for i, f in enumerate(group):
                rest = tuple(j + 1 for j in range(len(group)) if j != i)
                out[c, :, offsets[f] : offsets[f + 1]] = sums.sum(axis=rest) if rest else sums
    return out


def _value(sums: np.ndarray, rules: Rules, unit: float) -> np.ndarray:
    """Value of nodes, in whole units, from their sums."""
    g = sums[0] * unit
    if rules.l1:
        g = np.sign(g) * np.maximum(np.abs(g) - rules.l1, 0.0)
    weight = sums[1] + rules.l2
    mean = np.divide(g, weight, out=np.zeros(g.shape), where=weight > 0)
    return np.rint(rules.shrink * mean / unit).astype(np.int64)


def subtree(bins, residual, weight, level: int, rules: Rules, unit: float, offsets, allowed) -> Grown:
    """Grows everything below a node from its rows."""
    add, n = _Adder(np.stack([residual * weight, weight])), bins.shape[1]
    node = np.zeros(n, np.uint16)
    values = _value(np.stack([add.residuals(node, 1), *add.weights(node, 1)]), rules, unit)
    return Grown.of(*_below(np.ascontiguousarray(bins), add, node, values, level, rules, unit, offsets, allowed))


def _below(bins, add: _Adder, node, values, level: int, rules: Rules, unit: float, offsets, allowed) -> tuple[np.ndarray, ...]:
    """Arrays (feature, cut, left, value, gain) of some nodes, whose values are given, and of all that grow below them."""
    flat, rows, parts, nodes, since = bins.reshape(-1), np.arange(bins.shape[1]), [], len(values), 0
    while True:
        k = len(values)
        leaf = np.full(k, -1, np.int16), np.zeros(k, np.uint8), np.zeros(k, np.int32), values, np.zeros(k)
        if level >= rules.depth or not len(rows):
            parts.append(leaf)
            break
        found = _cuts(bins, node, add, k, rules, unit, offsets, allowed)
        split = np.flatnonzero(found.feature >= 0)
        if not len(split):
            parts.append(leaf)
            break
        rank = np.full(k, -1, np.int64)
        rank[split] = np.arange(len(split)) * 2
        first = np.where(rank >= 0, nodes + rank, 0).astype(np.int32)
        gains = np.where(rank >= 0, found.gain, 0.0)
        parts.append((found.feature.astype(np.int16), found.cut.astype(np.uint8), first, values, gains))
        pairs = _value(found.left[:, split], rules, unit), _value(found.total[:, split] - found.left[:, split], rules, unit)
        values = np.stack(pairs, axis=1).reshape(-1)
        k, nodes, level, since = len(values), nodes + len(values), level + 1, since + 1
        if level >= rules.depth:
            continue
        after = rank.take(node)
        place = np.maximum(found.feature, 0).astype(np.int64) * bins.shape[1]
        above = flat.take(place.take(node) + rows) > found.cut.astype(np.uint8).take(node)
        # Rows at leaves go, so the arrays shrink to those that are left.
        go = None if 2 * len(found.feature) == k else np.flatnonzero(after >= 0)
        after += above
        after = after if go is None else after.take(go)
        node = after.astype(np.uint16 if k <= 1 << 16 else np.uint32)
        if since >= ORDER_EVERY:
            # Rows of a node next to each other, so that sums of neighbouring rows lie together.
            order, since = np.argsort(node, kind="stable"), 0
            go, node = order if go is None else go.take(order), node.take(order)
        if go is not None:
            add, bins = add.take(go), bins.take(go, axis=1)
            flat, rows = bins.reshape(-1), np.arange(len(go))
        if not since and len(rows) > NEAR_ROWS and k > 1:
            ends = np.searchsorted(node, np.arange(k + 1))
            at, firsts = 0, []
            while at < k:
                firsts.append(at)
                at = max(at + 1, int(np.searchsorted(ends, ends[at] + NEAR_ROWS, side="right")) - 1)
            some = []
            for a, b in zip(firsts, [*firsts[1:], k], strict=True):
                own = slice(ends[a], ends[b])
                near = (node[own] - node.dtype.type(a)).astype(np.uint16)
                args = np.ascontiguousarray(bins[:, own]), add.take(own), near, values[a:b]
                made = _below(*args, level, rules, unit, offsets, allowed)
                made[2][made[0] >= 0] += nodes - (b - a)
                nodes += len(made[0]) - (b - a)
                some.append((b - a, made))
            parts += [tuple(x[:m] for x in made) for m, made in some] + [tuple(x[m:] for x in made) for m, made in some]
            break
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


# --- passes ----------------------------------------------------------------------------------


Job = tuple[int, int]


def _after(trees: Sequence[Grown]):
    """What the trees of each fit leave of the residuals of its blocks."""

    def run(block):
        fit, bins, hashes, residual = block
        return fit, bins, hashes, residual - trees[fit].values(bins, np.arange(len(residual)))

    return run


def _by_fit(jobs: Sequence[Job], used: Sequence) -> dict[int, list[int]]:
    """Places of the jobs of every fit, of those that have nodes to work on."""
    found: dict[int, list[int]] = {}
    for i, (fit, _) in enumerate(jobs):
        if len(used[i]):
            found.setdefault(fit, []).append(i)
    return found


def _pass(table: Binned, rdd: RDD, jobs: Sequence[Job], trees, wanted, rules: Rules, allowed) -> list[Cuts]:
    """Best cuts of the wanted nodes (lists of nodes per tree), from sums over all blocks."""
    p, offsets = len(table.members[0].features), table.offsets
    slots = [np.full(len(t[0]), -1, np.int32) for t in trees]
    first = np.cumsum([0, *map(len, wanted)])
    for slot, nodes in zip(slots, wanted, strict=True):
        slot[nodes] = np.arange(len(nodes))
    by_fit = _by_fit(jobs, wanted)

    def partial(blocks):
        sums = np.zeros((3, first[-1], offsets[-1]), np.int64)
        for fit, bins, hashes, residual in blocks:
            joint: dict = {}
            for i in by_fit.get(fit, ()):
                rows, weight = _sample(hashes, jobs[i][1], rules)
                own = slots[i].take(walk(bins, trees[i], rows))
                at = np.flatnonzero(own >= 0)
                if len(at) < len(rows):
                    rows, weight, own = rows.take(at), weight.take(at), own.take(at)
                values = np.stack([residual.take(rows) * weight, weight])
                sums[:, first[i] : first[i + 1]] += _sums(bins, rows, own, values, len(wanted[i]), offsets, joint)
        return sums

    masks = np.concatenate([np.broadcast_to(a, (len(w), p)) for a, w in zip(allowed, wanted, strict=True)])
    units = np.repeat([table.members[fit].unit for fit, _ in jobs], np.diff(first))
    if table.parts * 24 * first[-1] * offsets[-1] <= DRIVER_BYTES:
        parts = rdd.mapPartitions(lambda blocks: [partial(blocks)]).collect()
        found = cuts_from_sums(sum(parts), offsets, rules, units, masks)
        return [_part(found, a, b) for a, b in zip(first[:-1], first[1:], strict=True)]

    def by_node(blocks):
        sums = partial(blocks)
        return ((n, sums[:, n : n + 1]) for n in range(first[-1]))

    def choose(pair):
        n, sums = pair
        return n, cuts_from_sums(sums, offsets, rules, units[n : n + 1], masks[n : n + 1])

    reduced = rdd.mapPartitions(by_node).reduceByKey(np.add, max(1, min(int(first[-1]), table.parts)))
    got = dict(reduced.map(choose).collect())
    return [_joined([got[n] for n in range(a, b)]) for a, b in zip(first[:-1], first[1:], strict=True)]


def _part(cuts: Cuts, a: int, b: int) -> Cuts:
    return Cuts(cuts.feature[a:b], cuts.cut[a:b], cuts.gain[a:b], cuts.total[:, a:b], cuts.left[:, a:b])


def _joined(cuts: list[Cuts]) -> Cuts:
    if not cuts:
        return Cuts.none(np.zeros((3, 0), np.int64))
    flat = [np.concatenate([getattr(c, name) for c in cuts]) for name in ("feature", "cut", "gain")]
    return Cuts(*flat, *(np.concatenate([getattr(c, name) for c in cuts], axis=1) for name in ("total", "left")))


def _finish(table: Binned, rdd: RDD, jobs: Sequence[Job], trees, wanted, rules: Rules, allowed, most: int) -> list[tuple]:
    """Subtrees (job, node, tree) below the wanted (node, level, rows): their rows go to one task a node, of at most ``most`` rows."""
    offsets, units = table.offsets, [m.unit for m in table.members]
    keys = [(i, node, level) for i, nodes in enumerate(wanted) for node, level, _ in nodes]
    total = sum(rows for nodes in wanted for _, _, rows in nodes)
    slots, at = [np.full(len(t[0]), -1, np.int64) for t in trees], 0
    for slot, nodes in zip(slots, wanted, strict=True):
        slot[[n for n, _, _ in nodes]] = np.arange(at, at + len(nodes))
        at += len(nodes)
    by_fit = _by_fit(jobs, wanted)

    def deal(blocks):
        for fit, bins, hashes, residual in blocks:
            for i in by_fit.get(fit, ()):
                rows, weight = _sample(hashes, jobs[i][1], rules)
                own = slots[i].take(walk(bins, trees[i], rows))
                low, high = int(own.min(initial=0)), int(own.max(initial=-1))
                if low < high:
                    order = np.argsort((own - low).astype(np.uint16 if high - low < 1 << 16 else np.int64), kind="stable")
                    own, rows, weight = own.take(order), rows.take(order), weight.take(order)
                edges = np.flatnonzero(np.diff(own, prepend=-2, append=-2))
                for start, stop in zip(edges[:-1], edges[1:], strict=True):
                    if own[start] >= 0:
                        some = rows[start:stop]
                        yield int(own[start]), (bins.take(some, axis=1), residual.take(some), weight[start:stop].astype(np.uint8))

    def grow_below(pair):
        key, parts = pair
        i, _, level = keys[key]
        bins, residual, weight = (np.concatenate(x, axis=-1) for x in zip(*parts, strict=True))
        unit = units[jobs[i][0]]
        return key, subtree(bins, residual, weight.astype(np.int64), level, rules, unit, offsets, allowed[i])

    cores = rdd.context.defaultParallelism
    parts = max(1, min(len(keys), max(4 * cores, math.ceil(total / (2 * max(1, most))))))
    dealt = rdd.mapPartitions(deal).groupByKey(parts)
    made = dealt.map(grow_below).collect()
    # The rows are done with; without this they stay on the executors' disks until the driver collects its garbage.
    dealt._jrdd.rdd().cleanShuffleDependencies(True)
    return [(keys[key][0], keys[key][1], tree) for key, tree in made]


def _lots(small: list[list[tuple]], most: int) -> Iterator[list[list[tuple]]]:
    """The nodes (node, level, rows) of every job in lots of at most ``most`` rows, or of one node."""
    lot, rows = [[] for _ in small], 0
    for i, nodes in enumerate(small):
        for node in nodes:
            if rows and rows + node[2] > most:
                yield lot
                lot, rows = [[] for _ in small], 0
            lot[i].append(node)
            rows += node[2]
    if rows:
        yield lot


def grow(
    table: Binned, rdd: RDD, jobs: Sequence[Job], rules: Rules, allowed: Sequence[np.ndarray] | None = None
) -> list[Grown]:
    """Grows a tree for every job (fit, number of the tree), all at the same time, on the residuals of the blocks."""
    p, jobs = len(table.members[0].features), list(jobs)
    allowed = allowed or [np.ones(p, bool)] * len(jobs)
    trees = [Tree() for _ in jobs]
    small: list[list[tuple]] = [[] for _ in jobs]
    level, large = 0, [[] for _ in jobs]
    # With trees for all cores, fewer passes and larger subtrees are less work.
    local = LOCAL_ROWS * max(1, min(LOCAL_TREES, len(jobs) // rdd.context.defaultParallelism))
    for i, (fit, _) in enumerate(jobs):
        if table.members[fit].n <= local:
            small[i].append((0, 0, table.members[fit].n))
        else:
            large[i].append(0)
    most = max(1, int(SUM_BYTES // (24 * table.offsets[-1])))
    while any(large) and level < rules.depth:
        following: list[list[int]] = [[] for _ in jobs]
        queue = [(i, n) for i, nodes in enumerate(large) for n in nodes]
        for low in range(0, len(queue), most):
            wanted = [[] for _ in jobs]
            for i, n in queue[low : low + most]:
                wanted[i].append(n)
            arrays = [t.arrays()[:3] for t in trees]
            found = _pass(table, rdd, jobs, arrays, [np.array(w, int) for w in wanted], rules, allowed)
            for i, (tree, cuts) in enumerate(zip(trees, found, strict=True)):
                right = cuts.total - cuts.left
                unit = table.members[jobs[i][0]].unit
                values = [_value(s, rules, unit) for s in (cuts.total, cuts.left, right)]
                for j, node in enumerate(wanted[i]):
                    tree.value[node] = int(values[0][j])
                    if cuts.feature[j] < 0:
                        continue
                    pair = int(values[1][j]), int(values[2][j])
                    child = tree.split(node, int(cuts.feature[j]), int(cuts.cut[j]), float(cuts.gain[j]), pair)
                    for own, rows in ((child, int(cuts.left[2][j])), (child + 1, int(right[2][j]))):
                        if level + 1 < rules.depth and rows >= rules.split_rows:
                            if rows <= local:
                                small[i].append((own, level + 1, rows))
                            else:
                                following[i].append(own)
        large, level = following, level + 1
    below: list[list[tuple[int, Grown]]] = [[] for _ in jobs]
    arrays = [t.arrays()[:3] for t in trees]
    for lot in _lots(small, max(LOT_ROWS, 2 * sum(m.n for m in table.members))):
        for i, node, made in _finish(table, rdd, jobs, arrays, lot, rules, allowed, local):
            below[i].append((node, made))
    # Subtrees come as tasks end; their order is that of their places.
    return [tree.grown(sorted(own, key=lambda x: x[0])) for tree, own in zip(trees, below, strict=True)]


# --- models ----------------------------------------------------------------------------------


@dataclass
class TreeModel:
    """Grown trees with the bin edges; ``mean`` averages the trees, otherwise they add up."""

    features: list[str]
    edges: list[np.ndarray]
    base: float
    unit: float
    mean: bool
    trees: list[Grown]

    @classmethod
    def of(cls, member: Member, trees: list[Grown], mean: bool) -> TreeModel:
        return cls(member.features, member.edges, member.base * member.unit, member.unit, mean, trees)

    def first(self, n: int) -> TreeModel:
        """The model that ``n`` trees would have given: a tree depends on its number and those before it only."""
        return replace(self, trees=self.trees[:n])

    def predict(self, x: np.ndarray) -> np.ndarray:
        bins, total, rows = to_bins(x, self.edges), np.zeros(len(x), np.int64), np.arange(len(x))
        for tree in self.trees:
            total += tree.values(bins, rows)
        share = len(self.trees) if self.mean and self.trees else 1
        return self.base + total * self.unit / share

    def prediction(self) -> Column:
        """Predicted value from the feature columns."""

        @F.pandas_udf("double")
        def predicted(*columns: pd.Series) -> pd.Series:
            return pd.Series(self.predict(np.column_stack([c.to_numpy(dtype=float) for c in columns])))

        return predicted(*[F.col(f).cast("double") for f in self.features])

    def importance(self, kind: str) -> list[float]:
        """Shares of the features: "sum" of gains, "tree": the same for each tree first, "mean" gain of a cut."""
        p = len(self.features)
        total, used = np.zeros(p), np.zeros(p)
        for tree in self.trees:
            by = tree.feature[tree.feature >= 0]
            own = np.bincount(by, tree.gain, p)
            total += own / own.sum() if kind == "tree" and own.sum() else own
            used += np.bincount(by, minlength=p)
        if kind == "mean":
            total = np.divide(total, used, out=np.zeros(p), where=used > 0)
        return (total / total.sum() if total.sum() else total).tolist()

    def save(self, path: str) -> None:
        """Parquet, a row per tree with its arrays as little-endian bytes, next to the edges as JSON."""
        spark = SparkSession.active()
        kinds = ("<i4", "u1", "<i4", "<i8", "<f8")
        rows = [
            (i, *(bytearray(a.astype(k).tobytes()) for a, k in zip(tree.nodes(), kinds, strict=True)))
            for i, tree in enumerate(self.trees)
        ]
        schema = "tree int, feature binary, cut binary, left binary, value binary, gain binary"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        body = {"features": self.features, "edges": [e.tolist() for e in self.edges]}
        body |= {"base": self.base, "unit": self.unit, "mean": self.mean}
        spark.createDataFrame([(json.dumps(body),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/edges")

    @classmethod
    def load(cls, path: str) -> TreeModel:
        spark = SparkSession.active()
        body = json.loads(spark.read.text(f"{path}/edges").first()["value"])
        kinds = (("feature", "<i4"), ("cut", "u1"), ("left", "<i4"), ("value", "<i8"), ("gain", "<f8"))
        rows = spark.read.parquet(f"{path}/trees").orderBy("tree").collect()
        trees = [Grown.of(*(np.frombuffer(r[c], k) for c, k in kinds)) for r in rows]
        edges = [np.array(e, float) for e in body["edges"]]
        return cls(body["features"], edges, body["base"], body["unit"], body["mean"], trees)


def forest(table: Binned, n_trees: int, rules: Rules) -> list[TreeModel]:
    """Independent trees, grown together; a model for every fit."""
    rdd, fits = table.rows(), range(len(table.members))
    trees = grow(table, rdd, [(fit, n) for fit in fits for n in range(n_trees)], rules)
    rdd.unpersist()
    return [TreeModel.of(m, trees[i * n_trees : (i + 1) * n_trees], mean=True) for i, m in enumerate(table.members)]


def boosted(table: Binned, n_trees: int, rules: Rules, columns: float = 1.0) -> list[TreeModel]:
    """Trees one after the other, the first stage being the mean; each sees a share of the columns. A model for every fit.

    Residuals are kept on the executors' disks from tree to tree; every REWRITE_EVERY trees they are written to the
    shared folder (a checkpoint), so that what is lost is made anew from there. Only the last two are kept.
    """
    members, p = table.members, len(table.members[0].features)
    random = np.random.RandomState(rules.seed)
    trees: list[list[Grown]] = [[] for _ in members]
    rdd, before, written = table.rows(), None, []
    for number in range(n_trees):
        allowed = np.ones(p, bool)
        if columns < 1.0:
            allowed[:] = False
            allowed[random.choice(p, max(1, int(round(p * columns))), replace=False)] = True
        made = grow(table, rdd, [(fit, number) for fit in range(len(members))], rules, [allowed] * len(members))
        if before is not None:
            before.unpersist()
        for own, tree in zip(trees, made, strict=True):
            own.append(tree)
        while len(written) > 1 and written[1].isCheckpointed():
            scratch_done(rdd.context, written.pop(0).getCheckpointFile())
        if number + 1 == n_trees:
            break
        before, rdd = rdd, rdd.map(_after(made)).persist(StorageLevel.DISK_ONLY)
        if (number + 1) % REWRITE_EVERY == 0:
            rdd.checkpoint()
            written.append(rdd)
    rdd.unpersist()
    for last in written:
        if last.isCheckpointed():
            scratch_done(last.context, last.getCheckpointFile())
    return [TreeModel.of(member, own, mean=False) for member, own in zip(members, trees, strict=True)]
