"""Exact quantiles with linear interpolation, at any table size."""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from modelscout.functions.columns import present_sql

QUARTILES = (0.25, 0.5, 0.75)
BINS = 1_024


def number_sql(df: DataFrame, name: str) -> str:
    return f"cast({present_sql(name, df.schema[name].dataType)} AS double)"


def number(df: DataFrame, name: str) -> Column:
    """A numeric column as double, NaN shown as NULL."""
    return F.expr(number_sql(df, name))


def quantile_columns(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = QUARTILES) -> dict[str, Column]:
    """An array of exact quantiles per column, as literals for use inside ``df.agg``."""
    return {c: F.expr(literal_sql(v)) for c, v in exact_quantiles(df, cols, probs).items()}


def fractions_sql(probs: Sequence[float]) -> str:
    return f"array({', '.join(f'{float(p)!r}D' for p in probs)})"


def literal_sql(values: list[float | None]) -> str:
    def one(v: float | None) -> str:
        if v is None:
            return "cast(null AS double)"
        return f"{v!r}D" if math.isfinite(v) else f"cast('{v}' AS double)"

    return f"array({', '.join(map(one, values))})"


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float] = QUARTILES, bins: int = BINS
) -> dict[str, list[float | None]]:
    """Quantiles by narrowing: count the values of each column in equal-width bins, look into the bin that holds the
    wanted rank, and so on until the values at the rank are singled out.

    A round is one scan of the columns that are still open, however many, and brings back at most ``bins`` rows per open rank; nothing else is shuffled,
    whatever the table size or the skew. Every round divides the range by ``bins``. A round that hardly divides the
    rows (a long tail) is followed by one with bins on a logarithmic scale. Infinite values stand at the ends of the order
    and are only counted; a quantile between opposite infinities is NaN. The ends of a bracket fall into different bins, so every round has fewer rows to look at.
    """
    cols = list(cols)
    if not cols:
        return {}
    x = {c: number(df, c) for c in cols}
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    finite = {c: F.when(F.abs(x[c]) < math.inf, x[c]) for c in cols}
    ends = df.agg(*[
        f.alias(f"{n}{i}")
        for i, c in enumerate(cols)
        for n, f in (
            ("n", F.count(x[c])), ("lo", F.min(finite[c])), ("hi", F.max(finite[c])), ("held", F.count(finite[c])),
            ("below", F.count_if(x[c] == -math.inf)),
        )
    ]).first()
    sizes = {c: ends[f"n{i}"] for i, c in enumerate(cols)}
    # the value at each rank that is wanted, found or still looked for
    values: dict[str, dict[int, float | None]] = {}
    # a bracket: column, closed value range, rows below it, rows inside, scale of its bins
    todo: dict[tuple, list[int]] = {}
    for i, c in enumerate(cols):
        below, held = ends[f"below{i}"], ends[f"held{i}"]
        values[c] = {}
        for rank in sorted({r for p in probs for r in _ranks(p, sizes[c])}):
            if rank < below:
                values[c][rank] = -math.inf
            elif rank >= below + held:
                values[c][rank] = math.inf
            else:
                todo.setdefault((c, ends[f"lo{i}"], ends[f"hi{i}"], below, held, False), []).append(rank)

    while todo:
        brackets = list(todo)
        found = _bin_counts(df, finite, brackets, bins).collect()
        per_bracket: dict[int, list] = {k: [] for k in range(len(brackets))}
        for row in found:
            per_bracket[row["k"]].append(row)
        following: dict[tuple, list[int]] = {}
        for k, bracket in enumerate(brackets):
            c, lo, hi, below, inside, logarithmic = bracket
            rows = sorted(per_bracket[k], key=lambda r: r["bin"])
            for rank in todo[bracket]:
                value, nested = _look_up(rows, below, rank)
                if nested is None:
                    values[c][rank] = value
                    continue
                r, before = nested
                if r["n"] >= inside and lo < hi:
                    raise RuntimeError(f"no progress on the quantiles of {c!r}")
                scale = (not logarithmic) if r["n"] * 4 > inside else logarithmic
                following.setdefault((c, r["lo"], r["hi"], before, r["n"], scale), []).append(rank)
        todo = following
    for c in cols:
        for j, p in enumerate(probs):
            if sizes[c]:
                low, high = _ranks(p, sizes[c])
                out[c][j] = _between(values[c][low], values[c][high], p * (sizes[c] - 1) - low)
    return out


def _ranks(p: float, n: int) -> tuple[int, ...]:
    """The two ranks that a quantile of ``n`` rows lies between."""
    return (math.floor(p * (n - 1)), math.ceil(p * (n - 1))) if n else ()


def _between(a: float, b: float, share: float) -> float:
    if a == b or not share:
        return a
    d = b - a
    return a + d * share if math.isfinite(d) else a * (1 - share) + b * share


def _bin_counts(df: DataFrame, x: dict[str, Column], brackets: list[tuple], bins: int) -> DataFrame:
    """(k, bin, n, lo, hi) for every bracket, in one scan of all columns that have any.

    Bins are given by their bounds among the values themselves, so that a larger value is never in a lower bin.
    """
    columns = list({b[0]: None for b in brackets})
    ranges = [(b[1], b[2], _bounds(*b[1:3], b[5], bins)) for b in brackets]
    of_column = [[k for k, b in enumerate(brackets) if b[0] == c] for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(ranges), bins + 1), dtype=np.int64)
        low, high = np.full(n.shape, math.inf), np.full(n.shape, -math.inf)
        for batch in batches:
            for values, mine in zip(batch.columns, of_column):
                v = np.sort(values.drop_null().to_numpy())
                for k in mine:
                    lo, hi, bounds = ranges[k]
                    # the largest value never shares a bin with the smallest
                    first, top, last = np.searchsorted(v, lo), np.searchsorted(v, hi), np.searchsorted(v, hi, side="right")
                    if first == last:
                        continue
                    starts = np.concatenate(([first], first + np.searchsorted(v[first:top], bounds), [top]))
                    ends = np.append(starts[1:], last)
                    some = np.flatnonzero(ends > starts)
                    n[k, some] += (ends - starts)[some]
                    low[k, some] = np.minimum(low[k, some], v[starts[some]])
                    high[k, some] = np.maximum(high[k, some], v[ends[some] - 1])
        k, spot = np.nonzero(n)
        columns_ = [pa.array(k, pa.int32()), pa.array(spot, pa.int64()), *(pa.array(a[k, spot]) for a in (n, low, high))]
        yield pa.RecordBatch.from_arrays(columns_, names=["k", "bin", "n", "lo", "hi"])

    values = df.select([x[c].alias(f"v{i}") for i, c in enumerate(columns)])
    parts = values.mapInArrow(run, "k int, bin bigint, n bigint, lo double, hi double")
    return parts.groupBy("k", "bin").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _bounds(lo: float, hi: float, logarithmic: bool, bins: int) -> np.ndarray:
    """The lower bounds of all bins but the first, in ascending order."""
    share = np.arange(1, bins) / bins
    between = lambda a, b: a * (1 - share) + b * share  # noqa: E731 - no difference, which could overflow
    if logarithmic and _log_of(lo) < _log_of(hi):
        t = between(_log_of(lo), _log_of(hi))
        with np.errstate(over="ignore"):
            out = np.sign(t) * np.expm1(np.abs(t))
    else:
        out = between(lo, hi)
    return np.maximum.accumulate(np.clip(out, lo, hi))


def _log_of(v: float) -> float:
    return math.copysign(math.log1p(abs(v)), v)


def _look_up(rows: list, below: int, rank: int):
    """The value at ``rank``, or the bin that holds it and the rows before it."""
    before = below
    for r in rows:
        after = before + r["n"]
        if before <= rank < after:
            if r["lo"] == r["hi"] or rank == before:
                return r["lo"], None
            return (r["hi"], None) if rank == after - 1 else (None, (r, before))
        before = after
    raise RuntimeError("a rank beyond all rows")
