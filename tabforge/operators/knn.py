"""Exact nearest-neighbour imputation without comparing every row to every donor.

Distances are Euclidean over the coordinates both rows have, scaled up by the share
of missing ones. The k donors that have the wanted feature and lie closest are
averaged; donors at the same distance are taken in order of the value they give,
which makes the result independent of how the data is laid out.

* Copies are folded first. Donors with the same vector give the same value, so at
  most ``k`` of them count; receivers with the same vector get the same answer.
* For each target feature the donors are put into grid cells of about equal sides
  along the other features. The table of cells has a fixed maximum size and holds
  the box around each cell's donors.
* A cell with more than ``LEAF_ROWS`` donors is the root of a partition tree: level by
  level a crowded node is cut at medians of its widest features into up to 256
  children, until leaves are small. The tree is a table, so it grows with the donors.
* A receiver first searches its home leaves, which gives a bound on its k-th
  distance, and then only those leaves whose box, and the boxes above it, come closer.
* Leaves are searched in units of bounded size, small ones together. A leaf of donors
  that cannot be told apart is cut into chunks, many receivers into blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, fields
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.functions.scalars import number
from tabforge.session import materialise

CELL_LIMIT = 2048
LEAF_ROWS = 2_000
UNIT_ROWS = 20_000
PACK_ROWS = 4_000
_LEVELS, _DEPTH, _SAMPLE = 4, 8, 4_096
_PATH = 1 << 58  # a node's id: its level times this, plus the path from its cell
_MARKS = 256
#: Numbers of a block of distances: some 1 MB, about what a core's cache holds.
_CACHED = 1 << 17
_KEY, _WEIGHT = "__vector", "__weight"


@dataclass
class KnnState:
    """What a fitted imputer remembers.

    ``donors`` is a table of distinct weighted vectors, ``tree`` one of the nodes below crowded
    cells and ``placed`` one of the donors in them. ``compared`` counts pairs compared so far.
    """

    features: list[str]
    k: int
    means: list[float | None]
    grids: list[list[tuple[int, list[float]]]]
    cells: list[dict]
    levels: int = 0
    donors: DataFrame | None = None
    tree: DataFrame | None = None
    placed: DataFrame | None = None
    known: DataFrame | None = None
    compared: int = 0

    def plain(self) -> dict:
        """Everything but the tables, ready for JSON."""
        left_out = ("donors", "tree", "placed", "known", "compared")
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name not in left_out}

    def tables(self) -> dict[str, DataFrame]:
        """The tables to keep next to ``plain``; ``known`` can be found again."""
        kept = ("donors", "tree", "placed")
        return {name: getattr(self, name) for name in kept if getattr(self, name) is not None}


def _vector_key(features: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("~")) for f in features])


def _place(value: Column, cuts: Sequence[float], first: int) -> Column:
    """``first`` and the number of cuts below ``value``, found by halving."""
    if not cuts:
        return F.lit(first)
    mid = len(cuts) // 2
    above = _place(value, cuts[mid + 1 :], first + mid + 1)
    return F.when(value > F.lit(cuts[mid]), above).otherwise(_place(value, cuts[:mid], first))


def _cell_code(features: Sequence[str], grid: Sequence[tuple[int, list[float]]]) -> Column:
    code = F.lit(0)
    for dim, cuts in grid:
        value = F.col(features[dim])
        code = code * F.lit(len(cuts) + 2) + F.when(value.isNull(), 0).otherwise(_place(value, cuts, 1))
    return code.cast("bigint")


def _grid(target: int, marks: list[list[float]], limit: int) -> list[tuple[int, list[float]]]:
    """Cut points along every feature but the target, with sides of about equal length."""
    lengths = {i: m[-13] - m[12] or m[-1] - m[0] for i, m in enumerate(marks) if i != target and m}
    lengths = {i: length for i, length in lengths.items() if length > 0}

    def bins(side: float) -> dict[int, int]:
        counts = {i: min(_MARKS, math.ceil(length / side)) for i, length in lengths.items()}
        return {i: n for i, n in counts.items() if n > 1}

    side = max(lengths.values(), default=1.0)
    for _ in range(100):
        smaller = bins(side * 0.9)
        if math.prod(n + 1 for n in smaller.values()) > limit:
            break
        side *= 0.9
    grid = []
    for i, n in sorted(bins(side).items()):
        picked = {marks[i][min(_MARKS - 2, round(_MARKS * b / n) - 1)] for b in range(1, n)}
        grid.append((i, sorted(picked)))
    return grid


def _targets(features: Sequence[str]) -> Column:
    """Array of (target, cell) for the features a donor can give."""
    entries = [
        F.when(F.col(f).isNotNull(), F.struct(F.lit(i).alias("target"), F.col(f"__cell{i}").alias("cell")))
        for i, f in enumerate(features)
    ]
    return F.array_compact(F.array(*entries))


def _boxes(donors: DataFrame, features: Sequence[str], *by: str) -> DataFrame:
    """Box, donors and weight of each cell."""
    return donors.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(_WEIGHT).alias("weight"),
        *[F.min(f).alias(f"lo{i}") for i, f in enumerate(features)],
        *[F.max(f).alias(f"hi{i}") for i, f in enumerate(features)],
        *[F.count(f).alias(f"have{i}") for i, f in enumerate(features)],
    )


def fit(
    train: DataFrame,
    features: Sequence[str],
    k: int = 5,
    cell_limit: int = CELL_LIMIT,
    leaf_rows: int = LEAF_ROWS,
) -> KnnState:
    """Folds the training rows into weighted donors and describes the cells they fall into.

    ``cell_limit`` bounds the table of cells per feature, ``leaf_rows`` the donors of a leaf below
    them; both change the work, never the answer.
    """
    features = list(features)
    rows = train.select(*[number(f).alias(f) for f in features])
    shares = [i / _MARKS for i in range(1, _MARKS)]
    profile = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f).alias(f"mean{i}") for i, f in enumerate(features)],
        *[F.percentile_approx(f, shares, 2000).alias(f"marks{i}") for i, f in enumerate(features)],
    ).first()
    marks = [profile[f"marks{i}"] or [] for i in range(len(features))]
    limit = min(cell_limit, max(1, profile["n"] // 64))
    grids = [_grid(i, marks, limit) for i in range(len(features))]
    weighted = rows.groupBy(*features).agg(F.least(F.count(F.lit(1)), F.lit(k)).alias(_WEIGHT))
    codes = {f"__cell{i}": _cell_code(features, grid) for i, grid in enumerate(grids)}
    donors = materialise(weighted.withColumns(codes), "donors")
    described = _boxes(donors.select(*features, _WEIGHT, F.inline(_targets(features))), features, "target", "cell")
    inner = described.withColumn("inner", F.col("rows") > leaf_rows)
    cells = [r.asDict() for r in inner.orderBy("target", "cell").collect()]
    means = [profile[f"mean{i}"] for i in range(len(features))]
    state = KnnState(features, k, means, grids, cells, donors=donors)
    _grow(state, leaf_rows)
    return state


def _halves(x: np.ndarray, usable: list[int]) -> tuple[int, float]:
    """Feature and value that halve the sample ``x``; an infinite value where nothing tells rows apart."""
    widest, feature = 0.0, -1
    for i in usable:
        known = x[~np.isnan(x[:, i]), i]
        if len(known) and known.max() - known.min() > widest:
            widest, feature = known.max() - known.min(), i
    if feature >= 0:
        known = x[~np.isnan(x[:, feature]), feature]
        middle = np.partition(known, (len(known) - 1) // 2)[(len(known) - 1) // 2]
        return feature, float(middle if middle < known.max() else known[known < middle].max())
    for i in usable:
        if 0 < np.isnan(x[:, i]).sum() < len(x):
            return i, -math.inf
    return 0, math.inf


def _cutter(names: list[str], leaf_rows: int):
    """applyInPandas function: a sample of one node's donors -> its cuts, in heap order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, target = pdf[names].to_numpy(dtype=float), int(pdf["target"].iloc[0])
        depth = min(_DEPTH, max(1, math.ceil(math.log2(2 * pdf["rows"].iloc[0] / leaf_rows))))
        usable = [i for i in range(len(names)) if i != target]
        dims, cuts, parts = [], [], [x]
        for _ in range(depth):
            below = []
            for part in parts:
                feature, cut = _halves(part, usable)
                right = part[:, feature] > cut
                below += [part[~right], part[right]]
                dims.append(feature)
                cuts.append(cut)
            parts = below
        return pd.DataFrame(
            {"target": [target], "cell": [pdf["cell"].iloc[0]], "depth": [depth], "dims": [dims], "cuts": [cuts]}
        )

    return run


def _deal(rows: DataFrame, names: list[str], leaf_rows: int, level: int) -> DataFrame:
    """Donors of crowded nodes with the child they belong to; ``parent`` is the node itself.

    Where to cut is learned from about ``_SAMPLE`` donors of each node, chosen by hash; every donor
    is dealt. A missing value goes to the left.
    """
    sample = rows.where(F.pmod(F.xxhash64(*names), "rows") < _SAMPLE).select(*names, "target", "cell", "rows")
    schema = "target int, cell bigint, depth int, dims array<int>, cuts array<double>"
    cuts = sample.groupBy("target", "cell").applyInPandas(_cutter(names, leaf_rows), schema)
    values = F.array(*names)
    place = F.aggregate(
        F.sequence(F.lit(1), F.col("depth")),
        F.lit(0),
        lambda at, _: at * 2
        + 1
        + F.coalesce((F.get(values, F.get("dims", at)) > F.get("cuts", at)).cast("int"), F.lit(0)),
    )
    child = F.coalesce(place + 1 - F.size("dims"), F.lit(1))
    return rows.join(cuts, ["target", "cell"], "left").select(
        *names,
        _WEIGHT,
        "target",
        F.col("cell").alias("parent"),
        F.col("rows").alias("parent_rows"),
        (F.pmod("cell", F.lit(_PATH)) * (2 << _DEPTH) + child + F.lit(level * _PATH)).alias("cell"),
    )


def _grow(state: KnnState, leaf_rows: int) -> None:
    """Cuts crowded cells level by level until their leaves are small or their donors cannot be told apart."""
    crowded = [(c["target"], c["cell"], c["rows"]) for c in state.cells if c["inner"]]
    if not crowded:
        return
    names = state.features
    nodes = state.donors.sparkSession.createDataFrame(crowded, "target int, cell bigint, rows bigint")
    # At most one row per cell of the bounded table.
    rows = state.donors.select(*names, _WEIGHT, F.inline(_targets(names))).join(F.broadcast(nodes), ["target", "cell"])
    tree, leaves = [], []
    for level in range(1, _LEVELS + 1):
        dealt = materialise(_deal(rows, names, leaf_rows, level), "dealt")
        boxes = _boxes(dealt, names, "target", "parent", "parent_rows", "cell")
        crowd = (F.col("rows") > leaf_rows) & (F.col("rows") < F.col("parent_rows")) & F.lit(level < _LEVELS)
        described = boxes.withColumns({"inner": crowd, "level": F.lit(level)}).drop("parent_rows")
        described = materialise(described, "nodes")
        marked = dealt.join(described.select("target", "cell", "rows", "inner"), ["target", "cell"])
        tree.append(described)
        leaves.append(marked.where("NOT inner").select(*names, _WEIGHT, "target", "cell"))
        state.levels = level
        if not described.agg(F.max("inner")).first()[0]:
            break
        rows = marked.where("inner").select(*names, _WEIGHT, "target", "cell", "rows")
    state.tree = materialise(reduce(DataFrame.unionByName, tree), "tree")
    state.placed = materialise(reduce(DataFrame.unionByName, leaves), "placed")


class _Boxes:
    """The cells of one target as arrays, for bounding the distances of many receivers."""

    def __init__(self, cells: list[dict], p: int):
        def column(name):
            rows = [[np.nan if c[f"{name}{i}"] is None else c[f"{name}{i}"] for i in range(p)] for c in cells]
            return np.array(rows, dtype=float).reshape(len(cells), p)

        self.ids = np.array([c["cell"] for c in cells])
        self.inner = np.array([c["inner"] for c in cells], dtype=bool)
        self.weight = np.array([c["weight"] for c in cells], dtype=float)
        rows = np.array([[c["rows"]] for c in cells], dtype=float).reshape(-1, 1)
        self.low, self.high, have = column("lo"), column("hi"), column("have")
        self.always, self.maybe = have == rows, have > 0
        self.lacking = [np.flatnonzero(~self.always[:, i]) for i in range(p)]
        self.p = p

    def lower(self, x: np.ndarray) -> np.ndarray:
        """Squared distances no donor of a cell can be nearer than."""
        seen, near = ~np.isnan(x), np.zeros((len(x), len(self.ids)))
        for i in range(self.p):
            if not seen[:, i].any() or not self.always[:, i].any():
                continue
            value = x[:, i : i + 1]
            gap = self.low[:, i] - value
            np.maximum(gap, value - self.high[:, i], out=gap)
            np.maximum(gap, 0.0, out=gap)
            gap *= gap
            gap[:, self.lacking[i]] = 0.0
            gap[~seen[:, i]] = 0.0
            near += gap
        most = seen.astype(float) @ self.maybe.T.astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            near *= self.p
            near /= most
        near[most == 0] = np.inf
        return near

    def upper(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Squared distances no donor of a few cells, a row of them for each row of ``x``, can be farther than."""
        value, seen = x[:, None, :], ~np.isnan(x)[:, None, :]
        reach = np.maximum(np.abs(self.low[cells] - value), np.abs(value - self.high[cells]))
        far = np.where(self.maybe[cells] & seen, reach * reach, 0.0).sum(axis=2)
        sure = (self.always[cells] & seen).sum(axis=2)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(sure > 0, far * self.p / sure, np.inf)

    def homes(self, x: np.ndarray, lower: np.ndarray, k: int) -> np.ndarray:
        """A few of the nearest cells that together hold ``k`` donors, where there are that many."""
        chosen = np.zeros(lower.shape, dtype=bool)
        cells = np.argpartition(lower, min(k, lower.shape[1]) - 1, axis=1)[:, :k]
        near, far = np.take_along_axis(lower, cells, axis=1), self.upper(x, cells)
        cells = np.take_along_axis(cells, np.lexsort((far, near), axis=1), axis=1)
        usable = np.isfinite(np.take_along_axis(lower, cells, axis=1))
        weight = np.where(usable, self.weight[cells], 0.0)
        before = np.cumsum(weight, axis=1) - weight
        np.put_along_axis(chosen, cells, (before < k) & usable, axis=1)
        return chosen

    def visits(self, x: np.ndarray, limit: np.ndarray, home: np.ndarray, k: int, rest: bool) -> Iterator[tuple]:
        """Receivers, cells to go to, whether they are home cells, whether they are inner nodes.

        First the home cells of receivers that are at ``home`` here; with ``rest`` every other leaf, and every
        inner node, that may hold something at least as close as ``limit``.
        """
        step = _block(len(self.ids))
        for start in range(0, len(x) if len(self.ids) else 0, step):
            part = slice(start, start + step)
            lower = self.lower(x[part])
            homes = self.homes(x[part], lower, k) & home[part, None]
            chosen = homes
            if rest:
                reach = limit[part] * (1 + 1e-9) + 1e-12
                chosen = (self.inner | ~homes) & (lower <= reach[:, None]) & np.isfinite(lower)
            who, where = np.nonzero(chosen)
            if len(who):
                yield start + who, self.ids[where], homes[who, where], self.inner[where]


def _visit_schema(names: Sequence[str]) -> str:
    features = ", ".join(f"`{f}` double" for f in names)
    return f"{features}, {_KEY} string, limit double, target int, cell bigint, home boolean, inner boolean"


def _visit_rows(pdf: pd.DataFrame, names: list[str], target: int, found: tuple) -> pd.DataFrame:
    who, cell, home, inner = found
    out = pdf.iloc[who][[*names, _KEY, "limit"]].reset_index(drop=True)
    return out.assign(target=np.int32(target), cell=cell.astype("int64"), home=home, inner=inner)


def _visits(state: KnnState, rest: bool):
    """mapInPandas function: receivers -> visits of cells of the bounded table."""
    cells, names, k = state.cells, state.features, state.k
    p = len(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        boxes = [_Boxes([c for c in cells if c["target"] == i], p) for i in range(p)]
        for pdf in batches:
            x = pdf[names].to_numpy(dtype=float)
            wanted = pdf["target"].to_numpy() if rest else None
            for i, box in enumerate(boxes):
                asking = pdf.iloc[np.flatnonzero(wanted == i if rest else np.isnan(x[:, i]))]
                at_home = np.ones(len(asking), dtype=bool)
                y, limit = asking[names].to_numpy(dtype=float), asking["limit"].to_numpy(dtype=float)
                for found in box.visits(y, limit, at_home, k, rest):
                    yield _visit_rows(asking, names, i, found)

    return run


def _open(names: list[str], k: int, rest: bool):
    """cogroup function: receivers at an inner node and the boxes of its children -> visits of children."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = _visit_rows(left.iloc[:0], names, 0, (np.array([], int), *[np.array([])] * 3))
        if not len(left) or not len(right):
            return empty.astype({"home": bool, "inner": bool})
        children = right.drop(columns="cell").rename(columns={"child": "cell"}).sort_values("cell")
        box = _Boxes(children.to_dict("records"), len(names))
        x, limit = left[names].to_numpy(dtype=float), left["limit"].to_numpy(dtype=float)
        found = box.visits(x, limit, left["home"].to_numpy(dtype=bool), k, rest)
        target = int(left["target"].iloc[0])
        parts = [_visit_rows(left, names, target, part) for part in found]
        return pd.concat(parts) if parts else empty.astype({"home": bool, "inner": bool})

    return run


def _descend(state: KnnState, visits: DataFrame, rest: bool) -> DataFrame:
    """Leaves to visit: at inner nodes the receivers go on to the children, level by level."""
    names = state.features
    visits = materialise(visits, "visits")
    done = [visits.where("NOT inner")]
    for level in range(1, state.levels + 1):
        going = visits.where("inner")
        blocks = F.ceil(F.count(F.lit(1)) / UNIT_ROWS).alias("blocks")
        crowd = materialise(going.groupBy("target", "cell").agg(blocks), "crowd")
        asking = going.join(crowd, ["target", "cell"]).withColumn("block", F.pmod(F.xxhash64(_KEY), "blocks"))
        children = state.tree.where(F.col("level") == level).withColumnsRenamed({"cell": "child", "parent": "cell"})
        boxes = children.join(crowd, ["target", "cell"]).withColumn(
            "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
        )
        by = ["target", "cell", "block"]
        # Both sides took their blocks from one table.
        boxes = boxes.drop("blocks").select(*[F.col(c).alias(c) for c in boxes.columns if c != "blocks"])
        asking = asking.drop("blocks").select(*[F.col(c).alias(c) for c in asking.columns if c != "blocks"])
        opened = asking.groupBy(*by).cogroup(boxes.groupBy(*by)).applyInPandas(
            _open(names, state.k, rest), _visit_schema(names)
        )
        visits = materialise(opened, "visits")
        done.append(visits.where("NOT inner"))
    return reduce(DataFrame.unionByName, done)


def _block(width: int) -> int:
    """Rows of a matrix of ``width`` columns that stays in a core's cache."""
    return min(1024, max(16, _CACHED // max(1, width)))


class _Rough:
    """Squared distances to donors as products of matrices, and how far they may be off.

    (x - d)^2 summed over the features that both have is x^2 * has_d - 2 x * d + has_x * d^2, where what is missing counts
    as zero. Values are taken relative to the donors' middle, as the error grows with their size.
    """

    def __init__(self, donors: np.ndarray, target: int):
        self.own = [i for i in range(donors.shape[1]) if i != target]
        self.p = donors.shape[1]
        known = ~np.isnan(donors[:, self.own])
        values = np.where(known, donors[:, self.own], 0.0)
        self.middle = values.sum(axis=0) / np.maximum(known.sum(axis=0), 1)
        values = np.where(known, values - self.middle, 0.0)
        self.known = known.T.astype(float)
        self.right = np.vstack([self.known, -2 * values.T, (values * values).T])
        self.size = np.abs(values).max(initial=0.0)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rough distances of every donor, infinite without a common feature, and the largest error per row."""
        seen = ~np.isnan(x[:, self.own])
        values = np.where(seen, x[:, self.own] - self.middle, 0.0)
        known = seen.astype(float)
        total = np.hstack([values * values, values, known]) @ self.right
        common = known @ self.known
        with np.errstate(divide="ignore", invalid="ignore"):
            total *= self.p
            total /= common
        total[common == 0] = np.inf
        size = np.maximum(np.abs(values).max(axis=1, initial=0.0), self.size)
        # Rounding errors of sums of 3 p products of up to 2 * size^2 each, with room to spare.
        return total, 64 * self.p**3 * np.finfo(float).eps * size * size


def _above(values: np.ndarray, k: int) -> np.ndarray:
    """Per row a number that at least ``k`` values (all, where there are fewer) do not exceed, and hardly more do."""
    groups = values.shape[1] // 16
    if groups >= 4 * k:
        # The k-th of the least values of groups is one, and found without ordering the rest.
        values = values[:, : groups * 16].reshape(len(values), 16, groups).min(axis=1)
    kth = min(k, values.shape[1]) - 1
    return np.partition(values, kth, axis=1)[:, kth]


def nearest(x, limit, target: int, donors, weights, k: int) -> Iterator[tuple]:
    """Closest donors of receivers ``x`` within ``limit``: arrays of receiver, squared distance, value, weight.

    ``donors`` come sorted by the value they give, which settles equal distances. Pairs that rough distances leave in
    question get exact ones.
    """
    p = donors.shape[1]
    rough, step = _Rough(donors, target), _block(len(donors))
    for start in range(0, len(x), step):
        block, bound = x[start : start + step], limit[start : start + step]
        about, error = rough.distances(block)
        # Not above the bound and the k-th distance, or not known (values too large to be squared).
        reach = bound * (1 + 1e-9) + error
        wide = np.flatnonzero((about <= reach[:, None]).sum(axis=1) > 4 * k)
        if len(wide):
            reach[wide] = np.minimum(reach[wide], _above(about[wide], k) + 2 * error[wide])
        rows, places = np.nonzero(~(about > reach[:, None]))
        total, common = np.zeros(len(rows)), np.zeros(len(rows))
        for i in range(p):
            if i != target:
                gap = block[rows, i] - donors[places, i]
                known = ~np.isnan(gap)
                total += np.where(known, gap * gap, 0.0)
                common += known
        with np.errstate(divide="ignore", invalid="ignore"):
            distance = np.where(common > 0, total * p / common, np.inf)
        near = np.flatnonzero((distance <= bound[rows]) & np.isfinite(distance))
        rows, places, distance = rows[near], places[near], distance[near]
        order = np.lexsort((places, distance, rows))
        rows, places, distance = rows[order], places[order], distance[order]
        weight = weights[places]
        before = np.cumsum(weight) - weight
        taken = before - before[np.searchsorted(rows, rows)] < k if len(rows) else np.zeros(0, dtype=bool)
        rows, places = rows[taken], places[taken]
        yield start + rows, distance[taken], donors[places, target], weight[taken]


_FOUND = f"{_KEY} string, target int, distance double, value double, weight long"


def _search_unit(names: list[str], k: int):
    """cogroup function: receivers and donors of the leaves of one unit."""
    columns = [_KEY, "target", "distance", "value", "weight"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        pools = dict(list(right.groupby(["target", "cell"], sort=False)))
        for (target, cell), askers in left.groupby(["target", "cell"], sort=False):
            pool = pools.get((target, cell))
            if pool is None:
                continue
            pool = pool.sort_values(names[target], kind="stable")
            keys = askers[_KEY].to_numpy()
            hits = nearest(
                askers[names].to_numpy(dtype=float),
                askers["limit"].to_numpy(),
                int(target),
                pool[names].to_numpy(dtype=float),
                pool[_WEIGHT].to_numpy(),
                k,
            )
            for who, distance, value, weight in hits:
                found.append(pd.DataFrame(dict(zip(columns, (keys[who], target, distance, value, weight), strict=True))))
        return pd.concat(found) if found else pd.DataFrame(columns=columns)

    return run


def _units(state: KnnState, visits: DataFrame) -> tuple[DataFrame, int]:
    """(target, cell) of visited leaves -> unit, donor chunks, receiver blocks; and how many units there are.

    Leaves that need several chunks or blocks are units of their own, the others share units by hash.
    """
    spark = visits.sparkSession
    top = [(c["target"], c["cell"], c["rows"]) for c in state.cells if not c["inner"]]
    sizes = spark.createDataFrame(top, "target int, cell bigint, rows bigint")
    if state.tree is not None:
        sizes = sizes.unionByName(state.tree.where("NOT inner").select("target", "cell", "rows"))
    asked = visits.groupBy("target", "cell").agg(F.count(F.lit(1)).alias("askers"))
    crowd = materialise(sizes.join(asked, ["target", "cell"]), "crowd")
    total = crowd.agg(F.sum(F.col("rows") + F.col("askers")), F.sum(F.col("rows") * F.col("askers"))).first()
    count = max(1, (total[0] or 0) // PACK_ROWS)
    state.compared += total[1] or 0
    parts = crowd.select(
        "target",
        "cell",
        F.ceil(F.col("rows") / UNIT_ROWS).alias("chunks"),
        F.ceil(F.col("askers") / UNIT_ROWS).alias("blocks"),
    )
    shared = F.pmod(F.xxhash64("target", "cell"), F.lit(count))
    alone = -1 - F.pmod(F.xxhash64("target", "cell"), F.lit(1 << 62))
    return parts.withColumn("unit", F.when((F.col("chunks") > 1) | (F.col("blocks") > 1), alone).otherwise(shared)), count


def _search(state: KnnState, visits: DataFrame) -> DataFrame:
    """Up to ``k`` closest donors per visited leaf."""
    names = state.features
    visits = visits.drop("home", "inner")
    units, count = _units(state, visits)
    zero = F.lit(0).cast("bigint")
    left = (
        visits.join(units, ["target", "cell"])
        .withColumn("block", F.pmod(F.xxhash64(_KEY), F.col("blocks")))
        .withColumn("chunk", F.explode(F.sequence(zero, F.col("chunks") - 1)))
    )
    donors = state.donors.select(*names, _WEIGHT, F.inline(_targets(names)))
    if state.placed is not None:
        # Crowded cells are no leaves, so the join with the units drops their donors from the first table.
        donors = donors.unionByName(state.placed.select(*donors.columns))
    right = (
        donors.join(units, ["target", "cell"])
        .withColumn("chunk", F.pmod(F.xxhash64(*names), F.col("chunks")))
        .withColumn("block", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    )
    # A fixed number of tasks: small inputs would be merged into few, but the work is in the search.
    tasks = max(visits.sparkSession.sparkContext.defaultParallelism, min(count // 4, 4096))
    by = ["unit", "chunk", "block"]
    renewed = [F.col(c).alias(c) for c in by]  # both sides took ``unit`` from one table
    asking = left.select(*names, _KEY, "limit", "target", "cell", *by).repartition(tasks, *by)
    giving = right.select(*names, _WEIGHT, "target", "cell", *renewed).repartition(tasks, *by)
    return (
        asking.groupBy(*by)
        .cogroup(giving.groupBy(*by))
        .applyInPandas(_search_unit(names, state.k), _FOUND)
    )


def _running_weight() -> Column:
    """Donors counted so far, nearest first, for one receiver and target; a few rows per visited cell."""
    order = Window.partitionBy(_KEY, "target").orderBy("distance", "value")
    return F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def imputed_cells(incomplete: DataFrame, state: KnnState) -> DataFrame:
    """One row per distinct incomplete vector with the value of each missing feature."""
    names, k = state.features, state.k
    vectors = [number(f).alias(f) for f in names]
    receivers = incomplete.select(*vectors).distinct().withColumn(_KEY, _vector_key(names))
    if state.known is not None:
        receivers = receivers.join(state.known, _KEY, "left_anti")
    receivers = materialise(receivers.withColumn("limit", F.lit(float("inf"))), "receivers")
    # Bounding is heavy per row, so tasks are sized by rows, not by bytes.
    tasks = max(receivers.sparkSession.sparkContext.defaultParallelism, receivers.count() // UNIT_ROWS)
    visit = _visit_schema(names)
    asking = receivers.repartition(tasks, _KEY)

    def search(rows: DataFrame, rest: bool) -> DataFrame:
        leaves = _descend(state, rows.mapInPandas(_visits(state, rest), visit), rest)
        return materialise(_search(state, leaves), "rest" if rest else "home")

    home = search(asking, False)
    reached = home.withColumn("reached", _running_weight()).groupBy(_KEY, "target").agg(
        F.coalesce(F.min(F.when(F.col("reached") >= k, F.col("distance"))), F.lit(float("inf"))).alias("limit")
    )
    bounded = asking.drop("limit").join(reached.repartition(tasks, _KEY), _KEY)
    rest = search(bounded, True)
    counted = home.unionByName(rest).withColumn("reached", _running_weight())
    taken = F.least(F.col("weight"), F.lit(k) - (F.col("reached") - F.col("weight")))
    means = (
        counted.withColumn("taken", taken)
        .where("taken > 0")
        .groupBy(_KEY, "target")
        .agg((F.sum(F.col("value") * F.col("taken")) / F.sum("taken")).alias("mean"))
    )
    wide = means.groupBy(_KEY).agg(
        *[F.max(F.when(F.col("target") == i, F.col("mean"))).alias(f"__new{i}") for i in range(len(names))]
    )
    return wide if state.known is None else wide.unionByName(state.known)


def remember(train: DataFrame, state: KnnState) -> None:
    """Keeps the answers for the training rows, so that transforming them searches only new vectors."""
    gaps = " OR ".join(f"`{f}` IS NULL" for f in state.features)
    rows = train.select(*[number(f).alias(f) for f in state.features])
    state.known = materialise(imputed_cells(rows.where(gaps), state), "known")


def impute(df: DataFrame, state: KnnState) -> DataFrame:
    """Fills the features of ``df``; rows without gaps never enter the search or its joins."""
    names = state.features
    typed = df.withColumns({f: number(f) for f in names})
    gaps = " OR ".join(f"`{f}` IS NULL" for f in names)
    incomplete = typed.where(gaps)
    cells = imputed_cells(incomplete, state)
    filled = incomplete.withColumn(_KEY, _vector_key(names)).join(cells, _KEY, "left")
    filled = filled.withColumns(
        {
            f: F.coalesce(F.col(f), F.col(f"__new{i}"), F.lit(state.means[i]).cast("double"))
            for i, f in enumerate(names)
        }
    )
    return typed.where(f"NOT ({gaps})").unionByName(filled.select(*typed.columns))
