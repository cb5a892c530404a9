"""Iterative two-sided Grubbs test."""
from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from modelscout.functions.columns import as_column
from modelscout.functions.student import grubbs_rejects
from modelscout.operators.quantiles import number
from modelscout.sources.scratch import materialize

SALTS = 256
# Spark prunes ranks before a shuffle up to this limit (spark.sql.optimizer.windowGroupLimitThreshold).
MAX_ENDS = 1_000


def grubbs_statistic(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group: count, mean, sample std, the furthest value (the maximum only if strictly further) and its G."""
    x = number(df, col)
    rows = df.select(*[as_column(b) for b in by], x.alias("_x"))
    s = rows.groupBy(*[as_column(b) for b in by]).agg(
        F.count("_x").alias("n"),
        F.avg("_x").alias("mean"),
        F.stddev_samp("_x").alias("std"),
        F.min("_x").alias("_lo"),
        F.max("_x").alias("_hi"),
    )
    high, low = F.col("_hi") - F.col("mean"), F.col("mean") - F.col("_lo")
    return s.select(
        *[as_column(b) for b in by],
        "n",
        "mean",
        "std",
        F.when(high > low, F.col("_hi")).otherwise(F.col("_lo")).alias("furthest"),
        F.try_divide(F.greatest(high, low), F.col("std")).alias("g"),
    )


def columns_with_outliers(summary: DataFrame, alpha: float = 0.01) -> list[str]:
    """The numeric columns of a column summary from which the test removes something.

    The first step of the test needs only count, mean, deviation and extremes, which the summary has; one row per
    column comes to the driver.
    """
    out = []
    for r in summary.filter("var_type = 1").select("var_name", "ds_count", "ds_mean", "ds_std", "ds_min", "ds_max").collect():
        if r["ds_count"] >= 3 and r["ds_std"]:
            g = max(r["ds_max"] - r["ds_mean"], r["ds_mean"] - r["ds_min"]) / r["ds_std"]
            if grubbs_rejects(g, r["ds_count"], alpha):
                out.append(r["var_name"])
    return out


def grubbs_outliers(
    df: DataFrame, col: str, alpha: float = 0.01, by: Sequence[str] = (), ends: int = MAX_ENDS
) -> DataFrame:
    """Values removed by the repeated test: (by..., step, value, copies, g), steps in order of removal.

    The value removed is always the current minimum or maximum, so a group is described by the distinct values of
    its two ends (at first ``ends`` rows deep) and the moments of everything in between. Equal values fall
    together: taking away a copy moves the mean further off, hence ``copies``. A group that uses up an end goes
    into another round over its remaining rows, with ends about SALTS times deeper. Missing values are ignored;
    the test stops below three values or at zero spread.
    """
    by = list(by)
    keys = [f"_k{i}" for i in range(len(by))]
    rows = df.select(*[as_column(b).alias(k) for b, k in zip(by, keys)], number(df, col).alias("_x"))
    rows = rows.filter(F.col("_x").isNotNull())
    kind = T.StructType(
        [T.StructField(k, rows.schema[k].dataType) for k in keys]
        + T.StructType.fromDDL(
            "step BIGINT, value DOUBLE, copies BIGINT, g DOUBLE, low DOUBLE, high DOUBLE, open BOOLEAN"
        ).fields
    )
    start = {"_step": F.lit(0).cast("bigint"), "_low": F.lit(-math.inf), "_high": F.lit(math.inf)}
    if not 0 < ends <= MAX_ENDS:
        raise ValueError(f"ends is from 1 to {MAX_ENDS}")
    deep = False
    removed, left = [], rows.withColumns(start)
    while True:
        ended = _ends_and_core(left, keys, ends, deep)
        walked = materialize(ended.mapInPandas(_walker(keys, alpha), kind), "grubbs")
        removed.append(walked.filter(F.col("value").isNotNull()))
        open_ = walked.filter(F.col("value").isNull() & F.col("open"))
        if open_.isEmpty():
            break
        deep = True
        if keys:
            state = open_.select(
                *keys, F.col("step").alias("_step"), F.col("low").alias("_low"), F.col("high").alias("_high")
            )
            left = _with(rows, state, keys)
        else:
            state = open_.first()
            left = rows.withColumns(
                {
                    "_step": F.lit(state["step"]).cast("bigint"),
                    "_low": F.lit(state["low"]),
                    "_high": F.lit(state["high"]),
                }
            )
        left = left.filter((F.col("_x") > F.col("_low")) & (F.col("_x") < F.col("_high")))
    found = reduce(DataFrame.unionByName, removed)
    return found.select(*[F.col(k).alias(b) for b, k in zip(by, keys)], "step", "value", "copies", "g")


def _with(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on the group keys, a missing key being a group of its own."""
    b = b.withColumnsRenamed({k: f"{k}_" for k in keys})
    return a.join(b, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys])).drop(
        *[f"{k}_" for k in keys]
    )


def _cut(rows: DataFrame, keys: list[str], ends: int, order: Column, deep: bool, out: str) -> DataFrame:
    """The value at which an end of each group stops: (keys..., out).

    A group is ranked in SALTS parts, each pruned to ``ends`` rows before and after its shuffle, so the rows of a
    group never meet in one task. Then either the survivors are ranked once more, or, for a ``deep`` end, the cut is
    the first place where a part was pruned: up to there every row survived.
    """
    def nth(by: list[str], df: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(order))
        return df.withColumn("_r", rank).filter(F.col("_r") <= ends).drop("_r")

    furthest, nearest = (F.max, F.min) if out == "_a" else (F.min, F.max)
    parts = nth([*keys, "_s"], rows.select(*keys, "_x", F.pmod(F.xxhash64("_x"), F.lit(SALTS)).alias("_s")))
    if deep:
        per_part = parts.groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("_n"), furthest("_x").alias("_x"))
        pruned = nearest(F.when(F.col("_n") == ends, F.col("_x")))
        return per_part.groupBy(*keys).agg(F.coalesce(pruned, furthest("_x")).alias(out))
    survivors = nth(keys, parts) if keys else parts.orderBy(order).limit(ends)
    return survivors.groupBy(*keys).agg(furthest("_x").alias(out))


def _ends_and_core(rows: DataFrame, keys: list[str], ends: int, deep: bool) -> DataFrame:
    """One row per group: arrays of (value, n, mean, m2); value is NULL for the rows between the ends."""
    low = _cut(rows, keys, ends, F.asc("_x"), deep, "_a")
    high = _cut(rows, keys, ends, F.desc("_x"), deep, "_b")
    if keys:
        cut = _with(rows, _with(low, high, keys), keys)
    else:
        cut = rows.withColumns({"_a": low.scalar(), "_b": high.scalar()})
    at_end = F.when((F.col("_x") <= F.col("_a")) | (F.col("_x") >= F.col("_b")), F.col("_x"))
    merged = cut.groupBy(*keys, at_end.alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg("_x").alias("_m"),
        (F.var_pop("_x") * F.count(F.lit(1))).alias("_m2"),
        F.max("_a").alias("_a"),
        *[F.max(c).alias(c) for c in ("_step", "_low", "_high")],
    )
    groups = merged.groupBy(*keys).agg(
        F.collect_list(F.coalesce("_v", F.lit(float("nan")))).alias("v"),
        F.collect_list("_n").alias("n"),
        F.collect_list("_m").alias("m"),
        F.collect_list("_m2").alias("m2"),
        F.max("_a").alias("a"),
        *[F.max(c).alias(c.lstrip("_")) for c in ("_step", "_low", "_high")],
    )
    return groups.filter(F.size("v") > 0)


def _merge(p: tuple, q: tuple) -> tuple:
    """Count, mean and squared deviations of two disjoint sets together."""
    n = p[0] + q[0]
    if n == 0:
        return p
    d = q[1] - p[1]
    return n, p[1] + d * q[0] / n, p[2] + q[2] + d * d * p[0] * q[0] / n


def _walk(v, n, m, m2, a, alpha):
    """Remove ends while the test rejects. Returns the removals and (lowest left, highest left, used up)."""
    core = (0, 0.0, 0.0)
    inner = np.isnan(v)
    if inner.any():
        at = int(np.flatnonzero(inner)[0])
        core = (int(n[at]), float(m[at]), float(m2[at]))
    order = np.argsort(v[~inner])
    v, n = v[~inner][order].tolist(), n[~inner][order].tolist()
    i, j = 0, len(v) - 1
    split = None
    taken = []
    while True:
        if core[0]:
            split_at = bisect_right(v, a)
            if i >= split_at or j < split_at:
                return taken, i, j, v, True
        elif i > j:
            return taken, i, j, v, False
        else:
            split_at = split[0] if split and split[0] > i and split[0] <= j else (i + j + 1) // 2
        if split is None or split[0] != split_at:
            lows, highs = {split_at: (0, 0.0, 0.0)}, {split_at - 1: (0, 0.0, 0.0)}
            for k in range(split_at - 1, i - 1, -1):
                lows[k] = _merge(lows[k + 1], (n[k], v[k], 0.0))
            for k in range(split_at, j + 1):
                highs[k] = _merge(highs[k - 1], (n[k], v[k], 0.0))
            split = (split_at, lows, highs)
        size, mean, dev = _merge(core, _merge(split[1][i], split[2][j]))
        if size < 3 or dev <= 0:
            return taken, i, j, v, False
        std = math.sqrt(dev / (size - 1))
        high = abs(v[j] - mean) > abs(v[i] - mean)
        at = j if high else i
        g = abs(v[at] - mean) / std
        if not grubbs_rejects(g, size, alpha):
            return taken, i, j, v, False
        taken.append((v[at], n[at], g))
        i, j = (i, j - 1) if high else (i + 1, j)


def _walker(keys: list[str], alpha: float):
    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                r = row._asdict() if not keys else dict(zip(pdf.columns, row))
                taken, i, j, v, used_up = _walk(
                    np.asarray(r["v"], dtype=float), np.asarray(r["n"]), np.asarray(r["m"], dtype=float),
                    np.asarray(r["m2"], dtype=float), r["a"], alpha,
                )
                group, step = [r[k] for k in keys], int(r["step"])
                for value, copies, g in taken:
                    step += 1
                    out.append((*group, step, value, copies, g, None, None, False))
                if used_up:
                    low = v[i - 1] if i > 0 else r["low"]
                    high = v[j + 1] if j + 1 < len(v) else r["high"]
                    out.append((*group, step, None, None, None, low, high, True))
            names = [*keys, "step", "value", "copies", "g", "low", "high", "open"]
            frame = pd.DataFrame(out, columns=names)
            for c in ("step", "copies"):
                frame[c] = frame[c].astype("Int64")
            yield frame

    return run
