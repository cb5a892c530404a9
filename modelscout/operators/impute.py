"""Nearest-neighbour imputation, exact, without comparing all rows with all rows."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from modelscout.functions.columns import as_column
from modelscout.operators.quantiles import number
from modelscout.sources.scratch import materialize

LEAF_ROWS = 512
MAX_LEAVES = 16_384
MAX_PATTERNS = 64
SAMPLE_ROWS = 200_000
# receivers x leaves x known columns that are looked at together in a task
LOOK_CELLS = 8_000_000
BLOCK_COLUMNS = 4
BLOCK_RECEIVERS = 2_048


class KnnImpute:
    """Fill gaps in numeric columns with the mean of the ``k`` nearest rows that have the column.

    Distance uses the given columns only: columns / shared columns * sum of squared differences. Donors come from the
    fitted table. Equal distances go to the smaller donor value. A row that shares no column with any donor takes the
    column mean.
    """

    def __init__(self, cols: Sequence[str], k: int = 2, leaf_rows: int = LEAF_ROWS, max_leaves: int = MAX_LEAVES,
                 max_patterns: int = MAX_PATTERNS):
        self.cols, self.k, self.leaf_rows, self.max_leaves = list(cols), k, leaf_rows, max_leaves
        self.max_patterns = max_patterns

    def fit(self, train: DataFrame) -> "KnnImputeModel":
        axes = [f"_a{i}" for i in range(len(self.cols))]
        x = train.select(*[number(train, c).alias(a) for c, a in zip(self.cols, axes)])
        means = list(x.agg(*[F.avg(a) for a in axes]).first())
        donors = None
        if len(axes) > 1:
            # equal rows are interchangeable: keep one and how many of its copies can matter
            copies = F.least(F.count(F.lit(1)), F.lit(self.k)).cast("int")
            donors = materialize(x.dropna(how="all").groupBy(*axes).agg(copies.alias("_n")), "donors")
        return KnnImputeModel(self, axes, means, donors)


class KnnImputeModel:
    def __init__(self, params: KnnImpute, axes: list[str], means: list[float | None], donors: DataFrame | None):
        self.params, self.axes, self.means, self.donors = params, axes, means, donors

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with its gaps filled; other columns and rows are untouched."""
        cols = self.params.cols
        x = {c: number(df, c) for c in cols}
        means = {c: F.lit(m).cast("double") for c, m in zip(cols, self.means)}
        if self.donors is None:
            # no other column to measure a distance by
            return df.withColumns({c: F.coalesce(x[c], means[c]) for c in cols})
        gap = reduce(Column.__or__, [x[c].isNull() for c in cols])
        whole = df.filter(~gap).withColumns({c: as_column(c).cast("double") for c in cols})
        holes = df.filter(gap).withColumns({a: x[c] for c, a in zip(cols, self.axes)})
        fills = self._fills(self._receivers(df))
        if fills is None:
            return df.withColumns({c: F.coalesce(x[c], means[c]) for c in cols})
        same = reduce(Column.__and__, [holes[a].eqNullSafe(fills[a]) for a in self.axes])
        joined = holes.join(fills, same, "left")
        at = {c: i for i, c in enumerate(cols)}
        filled = joined.select(
            *[
                F.coalesce(holes[self.axes[at[c]]], fills[f"_f{at[c]}"], means[c]).alias(c) if c in at else holes[c]
                for c in df.columns
            ]
        )
        return whole.unionByName(filled)

    def search_effort(self, df: DataFrame) -> DataFrame:
        """One row (computed, pairs): how many distances the search for ``df`` works out, of how many there are between
        receivers and donors."""
        receivers = self._receivers(df)
        found = self._search(receivers)
        if found is None:
            return receivers.sparkSession.range(1).selectExpr("0L AS computed", "0L AS pairs")
        near, sizes, kinds = found
        known = F.array(*[F.col(a).isNotNull() for a in self.axes])
        number = F.lit(0)
        for p, g in kinds.items():
            number = F.when(known == F.array(*map(F.lit, p)), g).otherwise(number)
        some = reduce(Column.__or__, [F.col(a).isNotNull() for a in self.axes])
        donors = F.get(F.array(*[F.lit(n).cast("bigint") for n in sizes]), number)
        every = receivers.filter(some).agg(F.sum(donors).alias("pairs"))
        return near.filter("_c < 0").agg(F.sum("_dist").cast("bigint").alias("computed")).join(every)

    def _receivers(self, df: DataFrame) -> DataFrame:
        """The distinct rows with gaps: equal gaps have equal fills."""
        x = [number(df, c).alias(a) for c, a in zip(self.params.cols, self.axes)]
        gap = reduce(Column.__or__, [F.col(a).isNull() for a in self.axes])
        return materialize(df.select(*x).filter(gap).distinct(), "receivers")

    def _fills(self, receivers: DataFrame) -> DataFrame | None:
        """One row per distinct receiver with the filled value of every missing column."""
        axes = self.axes
        found = self._search(receivers)
        if found is None:
            return None
        return materialize(
            self._best(found[0]).groupBy(*axes).agg(
                *[F.avg(F.when(F.col("_c") == i, F.col("_value"))).alias(f"_f{i}") for i in range(len(axes))]
            ),
            "fills",
        )

    def _best(self, near: DataFrame) -> DataFrame:
        """The ``k`` nearest values per receiver and missing column."""
        order = Window.partitionBy(*self.axes, "_c").orderBy("_dist", "_value")
        return near.filter("_c >= 0").withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= self.params.k)

    def _search(self, receivers: DataFrame) -> tuple[DataFrame, list[int], dict[tuple, int]] | None:
        """Near donor values of every receiver, the donors per pattern, and the numbers of the patterns.

        Receivers are grouped by which columns they have. For each such pattern the donors are projected on those
        columns, equal projections merge into one with its ``k`` smallest values per missing column, and the
        projections are laid out in the leaves of a k-d tree. A receiver first meets the leaf that looks nearest for each
        of its missing columns. The distances found there bound what can be among its nearest, and it then meets
        only the leaves whose box is no further. Within a leaf, distances to two pivots rule out pairs, and the
        distances of the others are added up by blocks of columns and given up once they are beyond the bound.
        The trees are built on bounded samples, which decide the layout and never the result. With more
        than ``max_patterns`` patterns all receivers share one tree over the whole donor rows.
        """
        k, d, axes = self.params.k, len(self.axes), self.axes
        have = F.array(*[F.col(a).isNotNull() for a in axes])
        seen = receivers.select(have.alias("p")).distinct().limit(self.params.max_patterns + 1).collect()
        patterns = [tuple(r["p"]) for r in seen if any(r["p"])]
        if not patterns:
            return None
        one_tree = len(seen) > self.params.max_patterns
        if one_tree:
            patterns = [(True,) * d]
        kinds = {} if one_tree else {p: g for g, p in enumerate(patterns)}
        spots = materialize(self._spots(patterns), "spots")
        trees, boxes, placed = self._layout(spots, patterns)
        packs = self._packs(placed, boxes)
        if len(boxes.rows) > len(patterns):
            packs = materialize(packs, "packs")
        coords = ", ".join(f"{a} double" for a in axes)

        def meet(points: DataFrame, home: bool) -> DataFrame:
            blocks = points.mapInPandas(
                lambda batches: receiver_blocks(batches, kinds, boxes, k, home), "_leaf int, receivers array<double>"
            )
            return blocks.join(packs, "_leaf").select("receivers", "donors").mapInPandas(
                lambda batches: nearest(batches, d, k), f"{coords}, _c int, _dist double, _value double"
            )

        unbounded = F.array_repeat(F.lit(None).cast("double"), d)
        if len(boxes.rows) == len(patterns):
            near = meet(receivers.withColumn("_bounds", unbounded), False)
        else:
            first = materialize(meet(receivers, True), "first meetings")
            worst = self._best(first).groupBy(*axes, "_c").agg(
                F.when(F.count(F.lit(1)) == k, F.max("_dist")).alias("_worst")
            )
            every = worst.unionByName(receivers.select(*axes, F.lit(-1).alias("_c"), F.lit(None).cast("double").alias("_worst")))
            bounded = every.groupBy(*axes).agg(
                F.array(*[F.max(F.when(F.col("_c") == i, F.col("_worst"))) for i in range(d)]).alias("_bounds")
            )
            near = meet(materialize(bounded, "bounds"), False).unionByName(first.filter("_c < 0"))
        sizes = [int(boxes.rows[boxes.group == g].sum()) for g in range(len(patterns))]
        return near, sizes, kinds

    def _spots(self, patterns: list[tuple]) -> DataFrame:
        """Distinct donor projections per pattern: (_g, axes..., _v0.. arrays of the k smallest values)."""
        k, d, axes = self.params.k, len(self.axes), self.axes
        options = []
        for g, p in enumerate(patterns):
            for c in range(d):
                if not p[c] or all(p):
                    kept = [F.col(a) if keep else F.lit(None).cast("double") for a, keep in zip(axes, p)]
                    options.append(
                        F.struct(
                            F.lit(g).alias("_g"),
                            *[v.alias(a) for a, v in zip(axes, kept)],
                            F.lit(c).alias("_c"),
                            F.col(axes[c]).alias("_value"),
                            F.col("_n").alias("_n"),
                        )
                    )
        rows = self.donors.select(F.inline(F.array(*options))).filter(F.col("_value").isNotNull())
        if all(patterns[0]):
            smallest = F.array_repeat(F.col("_value"), F.col("_n"))
            per_value = rows.withColumn("_v", smallest)
        else:
            order = Window.partitionBy("_g", *axes, "_c").orderBy("_value")
            cut = rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)
            per_value = cut.groupBy("_g", *axes, "_c").agg(
                F.slice(
                    F.array_sort(F.flatten(F.collect_list(F.array_repeat(F.col("_value"), F.col("_n"))))), 1, k
                ).alias("_v")
            )
        any_axis = reduce(Column.__or__, [F.col(a).isNotNull() for a in axes])
        wide = per_value.filter(any_axis).groupBy("_g", *axes).agg(
            *[F.first(F.when(F.col("_c") == c, F.col("_v")), ignorenulls=True).alias(f"_v{c}") for c in range(d)]
        )
        return wide

    def _layout(self, spots: DataFrame, patterns: list[tuple]):
        """k-d trees, leaf boxes, and the projections with their leaf."""
        axes, d = self.axes, len(self.axes)
        sizes = {r["_g"]: r["n"] for r in spots.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).collect()}
        budget = max(1, self.params.max_leaves // len(patterns))
        share = min(1.0, SAMPLE_ROWS / max(1, sum(sizes.values())))
        picked = (spots if share == 1.0 else spots.sample(share, seed=7)).select("_g", *axes).toPandas()
        trees, first = [], 0
        for g in range(len(patterns)):
            points = picked.loc[picked["_g"] == g, axes].to_numpy(dtype=float)
            leaves = int(min(budget, max(1, sizes.get(g, 0) // self.params.leaf_rows)))
            nodes, used = build_tree(points, leaves, first)
            trees.append(nodes)
            first += used
        placed = spots.withColumn("_leaf", leaf_udf(trees)(F.col("_g"), F.array(*axes)))
        stats = (
            placed.groupBy("_leaf")
            .agg(
                F.first("_g").alias("g"),
                F.count(F.lit(1)).alias("rows"),
                F.array(*[F.min(a) for a in axes]).alias("lo"),
                F.array(*[F.max(a) for a in axes]).alias("hi"),
                F.array(*[F.count_if(F.col(a).isNull()) for a in axes]).alias("gaps"),
                F.array(*[F.coalesce(F.sum(F.size(f"_v{c}")), F.lit(0)) for c in range(d)]).alias("have"),
            )
            .toPandas()
            .sort_values("_leaf")
        )
        return trees, Boxes(stats, first), placed

    def _packs(self, placed: DataFrame, boxes: "Boxes") -> DataFrame:
        """The projections of a leaf as flat arrays of at most about ``leaf_rows`` entries: coordinates, then the
        values of every column padded with NaN."""
        k, d, axes = self.params.k, len(self.axes), self.axes
        numbers = ", ".join(str(int(-(-n // self.params.leaf_rows))) for n in boxes.rows)
        parts = F.get(F.expr(f"array({numbers})"), F.col("_leaf"))
        nan = F.lit(float("nan"))

        def padded(c: int) -> list[Column]:
            return [F.coalesce(F.get(F.col(f"_v{c}"), F.lit(i)), nan) for i in range(k)]

        flat = F.array(*[F.coalesce(F.col(a), nan) for a in axes], *[v for c in range(d) for v in padded(c)])
        return placed.groupBy("_leaf", F.pmod(F.xxhash64(*axes), parts.cast("bigint")).alias("_part")).agg(
            F.flatten(F.collect_list(flat)).alias("donors")
        )


class Boxes:
    """Bounding boxes of the leaves, as arrays indexed by leaf number."""

    def __init__(self, stats: pd.DataFrame, leaves: int):
        at = stats["_leaf"].to_numpy()

        def spread(values, fill):
            values = np.array([np.asarray(v, dtype=float) for v in values])
            out = np.full((leaves, *values.shape[1:]), fill, dtype=float)
            out[at] = values
            return out

        self.group = spread(stats["g"], -1)
        self.rows = spread(stats["rows"], 1)
        self.lo, self.hi = spread(stats["lo"], np.nan), spread(stats["hi"], np.nan)
        self.have = spread(stats["have"], 0)
        gaps = spread(stats["gaps"], 0)
        self.full = gaps == 0
        self.empty = gaps == self.rows[:, None]


def build_tree(points: np.ndarray, leaves: int, first: int) -> tuple[list[tuple], int]:
    """Nodes (axis, cut, left, right); a leaf is (-1, number, 0, 0). A missing coordinate goes left."""
    nodes: list[tuple] = [()]
    done = 0
    work = [(0, points, leaves)]
    while work:
        at, pts, budget = work.pop()
        cut = _cut(pts) if budget > 1 and len(pts) > 1 else None
        if cut is None:
            nodes[at] = (-1, first + done, 0, 0)
            done += 1
            continue
        axis, value = cut
        right = pts[:, axis] > value
        a = len(nodes)
        nodes += [(), ()]
        nodes[at] = (axis, value, a, a + 1)
        share = min(budget - 1, max(1, round(budget * float(1 - right.mean()))))
        work += [(a, pts[~right], share), (a + 1, pts[right], budget - share)]
    return nodes, done


def _cut(pts: np.ndarray) -> tuple[int, float] | None:
    """Axis and value that split the points: the median of the axis spread most, once the points that lack it are apart
    (they would widen the boxes of one side)."""
    columns = [c[~np.isnan(c)] for c in pts.T]
    spread = np.array([c.std() if len(c) else 0.0 for c in columns])
    gaps = np.isnan(pts).mean(axis=0)
    axis = int(spread.argmax()) if spread.max() > 0 else int(np.minimum(gaps, 1 - gaps).argmax())
    column = columns[axis]
    if not len(column):
        return None
    if gaps[axis]:
        return axis, float(np.nextafter(column.min(), -np.inf))
    if column.min() == column.max():
        return None
    value = float(np.median(column))
    if value >= column.max():
        value = float(column[column < column.max()].max())
    return axis, value


def leaf_udf(trees: list[list[tuple]]):
    starts = np.cumsum([0] + [len(t) for t in trees])
    nodes = [n for t in trees for n in t]
    axis = np.array([n[0] for n in nodes])
    value = np.array([n[1] for n in nodes], dtype=float)
    offset = np.repeat(starts[:-1], [len(t) for t in trees])
    child = np.array([[n[2], n[3]] for n in nodes]) + offset[:, None]

    @F.pandas_udf("int")
    def leaf(group: pd.Series, vectors: pd.Series) -> pd.Series:
        pts = np.array([np.asarray(v, dtype=float) for v in vectors])
        at = starts[group.to_numpy()]
        while True:
            inner = np.flatnonzero(axis[at] >= 0)
            if not len(inner):
                return pd.Series(value[at].astype("int32"))
            here = at[inner]
            right = pts[inner, axis[here]] > value[here]
            at[inner] = child[here, right.astype(int)]

    return leaf


def receiver_blocks(batches, kinds: dict[tuple, int], boxes: Boxes, k: int, home: bool):
    """Send each receiver to the leaves that can hold one of its nearest donors, many receivers per row; with ``home``
    only to the one leaf that looks nearest for each missing column. A receiver is its coordinates and the largest
    distance that still matters. Without ``kinds`` there is one tree for all."""
    for pdf in batches:
        d = len(boxes.full[0])
        points = pdf.iloc[:, :d].to_numpy(dtype=float)
        bounds = np.full(points.shape, np.inf)
        if not home:
            found = np.array([np.asarray(b, dtype=float) for b in pdf["_bounds"]]).reshape(-1, d)
            bounds = np.where(np.isnan(found), np.inf, found)
        known = ~np.isnan(points)
        leaf_rows: dict[int, list] = {}
        patterns, which = np.unique(known, axis=0, return_inverse=True)
        which = which.ravel()
        for i, pattern in enumerate(patterns):
            if not pattern.any():
                continue
            leaves = np.flatnonzero(boxes.group == (kinds[tuple(pattern.tolist())] if kinds else 0))
            rows = np.flatnonzero(which == i)
            step = max(16, LOOK_CELLS // max(1, len(leaves) * int(pattern.sum())))
            for start in range(0, len(rows), step):
                part = rows[start : start + step]
                wanted, limit = candidate_leaves(points[part], bounds[part], pattern, boxes, leaves, k, home)
                sent = np.column_stack([points[part], limit])
                for at in np.flatnonzero(wanted.any(axis=0)):
                    leaf_rows.setdefault(int(leaves[at]), []).append(sent[wanted[:, at]])
        yield pd.DataFrame(
            {
                "_leaf": np.fromiter(leaf_rows, dtype="int32"),
                "receivers": [np.concatenate(parts).ravel() for parts in leaf_rows.values()],
            }
        )


def box_bounds(points: np.ndarray, pattern: np.ndarray, boxes: Boxes, leaves: np.ndarray):
    """The least and the largest distance that a donor of a leaf can have, per receiver and leaf.

    The distance is the mean over the shared columns, times all columns. A donor shares the columns that the whole leaf has
    and any of those that part of it has, so the least mean takes from the latter the smallest gaps as
    long as they lower it; the largest mean likewise. A leaf where a donor may share nothing has no largest distance.
    """
    at = np.flatnonzero(pattern)
    full, empty = boxes.full[np.ix_(leaves, at)], boxes.empty[np.ix_(leaves, at)]
    lo, hi = np.nan_to_num(boxes.lo[np.ix_(leaves, at)]), np.nan_to_num(boxes.hi[np.ix_(leaves, at)])
    p = points[:, None, at]
    certain = full.sum(axis=1)

    def extreme(parts: np.ndarray, sign: int) -> np.ndarray:
        total = np.where(full, parts, 0.0).sum(axis=2)
        best = np.where(certain > 0, total / np.maximum(certain, 1), sign * np.inf)
        pick = np.minimum if sign > 0 else np.maximum
        options = np.sort(np.where(full | empty, np.inf, sign * parts), axis=2)
        for j in range(int((~(full | empty)).sum(axis=1).max(initial=0))):
            total = total + sign * options[:, :, j]
            best = pick(best, total / (certain + j + 1))
        return best

    d = len(pattern)
    near = d * extreme(np.maximum(0.0, np.maximum(lo - p, p - hi)) ** 2, 1)
    far = d * extreme(np.maximum(np.abs(p - lo), np.abs(p - hi)) ** 2, -1)
    return near, np.where(certain > 0, far, np.inf)


def candidate_leaves(points, bounds, pattern: np.ndarray, boxes: Boxes, leaves: np.ndarray, k: int, home: bool):
    """Which leaves each receiver is sent to, and the largest distance that matters to it."""
    near, far = box_bounds(points, pattern, boxes, leaves)
    have = boxes.have[leaves]
    possible = (~boxes.empty[leaves] & pattern).any(axis=1)
    wanted = np.zeros(near.shape, dtype=bool)
    limit = np.zeros(len(points))
    every = np.arange(len(points))
    for c in np.flatnonzero(~pattern):
        enough = np.minimum(np.where(have[:, c] >= k, far, np.inf).min(axis=1), bounds[:, c]) * (1 + 1e-9)
        limit = np.maximum(limit, enough)
        gives = (have[:, c] > 0) & possible
        if home:
            look = np.where(gives & (have[:, c] >= k), near, np.inf)
            least = look.min(axis=1, keepdims=True)
            # boxes overlap: among those equally near the one whose far corner is nearest
            spot = np.where(look == least, far, np.inf).argmin(axis=1)
            some = np.isfinite(least[:, 0])
            wanted[every[some], spot[some]] = True
        else:
            wanted |= (near <= enough[:, None]) & gives
    return wanted, limit


def nearest(batches, d: int, k: int):
    """The k nearest donor values of one pack for every missing column of every receiver of a block, and a row with
    column -1 and the number of distances worked out."""
    names = [*[f"_a{i}" for i in range(d)], "_c", "_dist", "_value"]
    for pdf in batches:
        out, computed = [], 0
        for receivers, donors in zip(pdf["receivers"], pdf["donors"]):
            block = np.asarray(receivers, dtype=float).reshape(-1, d + 1)
            packed = np.asarray(donors, dtype=float).reshape(-1, d + d * k)
            spots, values = packed[:, :d], packed[:, d:].reshape(-1, d, k)
            for start in range(0, len(block), BLOCK_RECEIVERS):
                r, limit = block[start : start + BLOCK_RECEIVERS, :d], block[start : start + BLOCK_RECEIVERS, d]
                dist, n = bounded_distances(r, limit, spots)
                computed += n
                for c in range(d):
                    need = np.flatnonzero(np.isnan(r[:, c]))
                    give = np.flatnonzero(~np.isnan(values[:, c, 0]))
                    if len(need) and len(give):
                        give = give[np.argsort(values[give, c, 0], kind="stable")]
                        out.append(_pick(r[need], dist[np.ix_(need, give)], values[give, c], c, k))
        out.append(np.array([[np.nan] * d + [-1, computed, np.nan]]))
        frame = pd.DataFrame(np.concatenate(out), columns=names)
        frame["_c"] = frame["_c"].astype("int32")
        yield frame


def bounded_distances(r: np.ndarray, limit: np.ndarray, spots: np.ndarray) -> tuple[np.ndarray, int]:
    """Distances of receivers and donors, infinite where beyond the receiver's limit, and how many were begun.

    On the columns that a pair shares, the difference of its distances to a pivot is at most its own distance. Both are
    sums over the shared columns, so one product with the other side's known columns gives them for all pairs.
    """
    d = spots.shape[1]
    known, has = ~np.isnan(r), ~np.isnan(spots)
    shared = known.astype(float) @ has.T.astype(float)
    scale = d / np.maximum(shared, 1)
    open_ = shared > 0
    if np.isfinite(limit).any():
        for pivot in _pivots(spots, has):
            from_r = np.sqrt(np.where(known, r - pivot, 0.0) ** 2 @ has.T.astype(float))
            from_x = np.sqrt(known.astype(float) @ (np.where(has, spots - pivot, 0.0) ** 2).T)
            # less what rounding may have added
            apart = np.maximum(np.abs(from_r - from_x) - 1e-12 * (from_r + from_x), 0.0)
            open_ &= ~(scale * apart**2 > limit[:, None])
    i, j = np.nonzero(open_)
    begun = len(i)
    total = np.zeros(begun)
    for start in range(0, d, BLOCK_COLUMNS):
        for a in range(start, min(d, start + BLOCK_COLUMNS)):
            diff = r[i, a] - spots[j, a]
            total += np.where(np.isnan(diff), 0.0, diff * diff)
        on = np.flatnonzero(scale[i, j] * total <= limit[i])
        i, j, total = i[on], j[on], total[on]
    dist = np.full(shared.shape, np.inf)
    dist[i, j] = scale[i, j] * total
    return dist, begun


def _pivots(spots: np.ndarray, has: np.ndarray) -> list[np.ndarray]:
    """The mean of the donors and the donor furthest from it; what it lacks is taken from the mean."""
    mean = np.where(has, spots, 0.0).sum(axis=0) / np.maximum(has.sum(axis=0), 1)
    off = np.where(has, spots - mean, 0.0)
    return [mean, mean + off[(off**2).sum(axis=1).argmax()]]


def _pick(r: np.ndarray, dist: np.ndarray, values: np.ndarray, c: int, k: int) -> np.ndarray:
    """The k smallest (distance, value) per receiver; donors come sorted by their smallest value."""
    first = np.argsort(dist, axis=1, kind="stable")[:, :k]
    far = np.repeat(np.take_along_axis(dist, first, axis=1), values.shape[1], axis=1)
    got = values[first].reshape(len(r), -1)
    far = np.where(np.isnan(got), np.inf, far)
    best = np.lexsort((got, far), axis=1)[:, :k]
    far, got = np.take_along_axis(far, best, axis=1), np.take_along_axis(got, best, axis=1)
    rows = np.column_stack(
        [np.repeat(r, far.shape[1], axis=0), np.full(far.size, float(c)), far.ravel(), got.ravel()]
    )
    return rows[np.isfinite(far.ravel())]
