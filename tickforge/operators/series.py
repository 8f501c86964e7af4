"""Long series over many tasks: places, blocks with copied edges, scans of recurrences, folds with repair.

Rows are numbered within their series (``ordered.numbered``) and cut into blocks of ``BLOCK`` places;
a block is what one task holds, however long its series is. What looks back a bounded number of
rows gets copies of the last rows of the block before. Smoothing, y = a x + (1 - a) y, is an affine
map of what comes in, and such maps compose: blocks are summed up to their maps at once, the maps
of a series (a row a block) are applied one after the other, and each block starts from what comes in.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickforge.operators import ordered
from tickforge.sources.shared import new_path

BLOCK = 1 << 16
HELPERS = ("_at", "_block")


def placed(df: DataFrame, key: str = "ticker", order: str = "Date") -> DataFrame:
    """Adds _at, the place of a row in its series (from 0), and _block, unless they are there."""
    if "_at" in df.columns:
        return df
    return ordered.numbered(df, [key], [order], "_at").withColumn("_block", F.floor(F.col("_at") / BLOCK))


def bare(df: DataFrame, like: DataFrame) -> DataFrame:
    """Without the helpers that ``like`` doesn't have."""
    return df.drop(*[h for h in HELPERS if h not in like.columns])


def with_edges(rows: DataFrame, before: int) -> DataFrame:
    """Placed rows, and copies of each block's last ``before`` rows in the next one; _own tells them apart."""
    if before > BLOCK:
        raise ValueError(f"frames of more than {BLOCK} rows")
    copied = F.col("_at") % BLOCK >= BLOCK - before
    home = F.col("_block")
    out = rows.withColumn("_home", home).withColumn("_block", F.explode(F.when(copied, F.array(home, home + 1)).otherwise(F.array(home))))
    return out.withColumn("_own", F.col("_home") == F.col("_block")).drop("_home")


def own(rows: DataFrame) -> DataFrame:
    return rows.filter("_own").drop("_own")


def in_block(n: int | None = None, key: str = "ticker") -> WindowSpec:
    """Rows of a block in order, or frames of its last ``n`` rows."""
    spec = Window.partitionBy(key, "_block").orderBy("_at")
    return spec.rowsBetween(1 - n, 0) if n else spec


def smooth(x: pd.Series, alpha: float, least: int = 0) -> pd.Series:
    """y = a x + (1 - a) y before it, from the first value on; null before ``least`` values."""
    return x.ewm(alpha=alpha, min_periods=least, adjust=False).mean()


def _map_of(x: np.ndarray, alpha: float) -> tuple[float, float, float, float, float, float]:
    """(values, first place, first value, slope, offset, nulls at the end): the block's last smoothed value is slope * y + offset, y being that of the first."""
    at = np.flatnonzero(~np.isnan(x))
    if not len(at):
        return 0.0, float(len(x)), np.nan, 1.0, 0.0, float(len(x))
    rest = x[at[0] :].copy()
    rest[0] = 0.0
    unit = np.where(np.isnan(rest), np.nan, 0.0)
    unit[0] = 1.0
    last = lambda v: float(smooth(pd.Series(v), alpha).iloc[-1])
    return float(len(at)), float(at[0]), float(x[at[0]]), last(unit), last(rest), float(len(x) - 1 - at[-1])


def _carried(maps: list[list[float]], alpha: float, state: tuple[float, float, float]) -> tuple[float, float, float]:
    """(smoothed value, nulls since, values so far) behind a block."""
    y, gap, seen = state
    count, first, value, slope, offset, after = maps
    if not count:
        return y, gap + first, seen
    if seen:
        weight = (1 - alpha) ** (gap + first + 1)
        value = (weight * y + alpha * value) / (weight + alpha)
    return slope * value + offset, after, seen + count


def smoothed(rows: DataFrame, columns: Mapping[str, tuple[str, float, int]], key: str = "ticker") -> DataFrame:
    """Placed rows with smoothed columns: name -> (column, alpha, least number of values)."""
    names, asked = list(columns), list(columns.values())
    sources = list(dict.fromkeys(c for c, _, _ in asked))
    array = T.ArrayType(T.DoubleType())
    of_key = rows.schema[key]

    def summed_up(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_at")
        maps = [_map_of(part[c].to_numpy(np.float64, na_value=np.nan), a) for c, a, _ in asked]
        return pd.DataFrame({key: [part[key].iloc[0]], "_block": [part["_block"].iloc[0]], "_maps": [[x for m in maps for x in m]]})

    def carried(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_block")
        states, out = [(np.nan, 0.0, 0.0)] * len(asked), []
        for flat in part["_maps"]:
            out.append([x for s in states for x in s])
            states = [_carried(list(flat[6 * i : 6 * i + 6]), a, s) for i, ((_, a, _), s) in enumerate(zip(asked, states, strict=True))]
        return pd.DataFrame({key: part[key], "_block": part["_block"], "_in": out})

    def applied(part: pd.DataFrame, begun: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_at")
        flat = begun["_in"].iloc[0]
        for i, (name, (c, a, least)) in enumerate(zip(names, asked, strict=True)):
            y, gap, seen = flat[3 * i : 3 * i + 3]
            x = part[c].to_numpy(np.float64, na_value=np.nan)
            head = [y, *[np.nan] * int(gap)] if seen else []
            values = smooth(pd.Series(np.concatenate([head, x])), a).to_numpy()[len(head) :]
            part[name] = np.where(seen + np.cumsum(~np.isnan(x)) >= least, values, np.nan)
        return part

    small = T.StructType([of_key, T.StructField("_block", T.LongType())])
    blocks = rows.select(key, "_block", "_at", *sources).groupBy(key, "_block")
    maps = blocks.applyInPandas(summed_up, T.StructType([*small, T.StructField("_maps", array)]))
    begun = maps.groupBy(key).applyInPandas(carried, T.StructType([*small, T.StructField("_in", array)]))  # a row a block
    schema = T.StructType([*[f for f in rows.schema if f.name not in names], *[T.StructField(n, T.DoubleType()) for n in names]])
    return rows.groupBy(key, "_block").cogroup(begun.groupBy(key, "_block")).applyInPandas(applied, schema)


def continuous(prices: np.ndarray, max_gap: float, before: float | None = None, known: np.ndarray | None = None) -> np.ndarray:
    """Each price within ``max_gap`` of the corrected one before it; ``before`` is what comes before the first.

    ``known`` are the results from another start: once both agree, the rest is theirs.
    """
    out = prices.astype(float).tolist()
    there = known.tolist() if known is not None else None
    for i, now in enumerate(out):
        if i:
            before = out[i - 1]
        if before is not None and before != 0 and abs((now - before) / before) > max_gap:
            out[i] = before * (1 + max_gap) if (now - before) / before > 0 else before * (1 - max_gap)
        if there is not None and out[i] == there[i]:
            out[i:] = there[i:]
            break
    return np.array(out, float)


def _latest(versions: list[DataFrame], key: str) -> DataFrame:
    """Each block's rows in the last version that has them."""
    if len(versions) == 1:
        return versions[0]
    every = versions[0]
    for v in versions[1:]:
        every = every.unionByName(v)
    last = every.groupBy(key, "_block").agg(F.max("_version").alias("_version"))
    return every.join(last, [key, "_block", "_version"])


def enforce_continuity(df: DataFrame, max_gap: float, price: str, key: str = "ticker", order: str = "Date") -> DataFrame:
    """The fold ``continuous`` of each series, its blocks folded at once.

    A block starts from a guess, the uncorrected last price before it. Where what the block before it
    ends with turns out to be another, the block's head is folded again until it meets the
    values it had; blocks whose ends change by that pass it on. Most series need no repair.
    """
    spark = df.sparkSession
    rows = placed(df.withColumn(price, F.col(price).cast("double")), key, order)
    rows = rows.withColumns({"_raw": F.col(price), "_version": F.lit(0)})
    last = F.col("_at") % BLOCK == BLOCK - 1

    def starts(of: DataFrame, name: str, column: str = price) -> DataFrame:
        return of.filter(last).select(key, (F.col("_block") + 1).alias("_block"), F.col(column).alias(name))

    def begun(of: DataFrame):
        return of.select(F.col(key).alias("_k"), F.col("_block").alias("_b"), "_start").groupBy("_k", "_b")

    def fold(version: int):
        def run(part: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("_at")
            before = None
            if len(start):
                before = float(start["_start"].iloc[0]) if start["_start"].iloc[0] is not None else np.nan
            part[price] = continuous(part["_raw"].to_numpy(np.float64, na_value=np.nan), max_gap, before, part[price].to_numpy(np.float64, na_value=np.nan) if version else None)
            part["_version"] = version
            return part

        return run

    def written(made: DataFrame) -> DataFrame:
        path = new_path(spark, "continuous")
        made.write.parquet(path)
        return spark.read.schema(made.schema).parquet(path)

    used = starts(rows, "_start", "_raw")
    versions = [written(rows.groupBy(key, "_block").cogroup(begun(used)).applyInPandas(fold(0), rows.schema))]
    while True:
        now = _latest(versions, key)
        wrong = starts(now, "_start").join(used.withColumnRenamed("_start", "_used"), [key, "_block"])
        wrong = written(wrong.filter(~F.col("_start").eqNullSafe(F.col("_used"))).drop("_used"))
        if wrong.isEmpty():
            return bare(now.drop("_raw", "_version"), df).select(*df.columns)
        again = now.join(wrong.select(key, "_block"), [key, "_block"], "left_semi").select(*rows.columns)
        versions.append(written(again.groupBy(key, "_block").cogroup(begun(wrong)).applyInPandas(fold(len(versions)), rows.schema)))
        used = written(used.join(wrong.select(key, "_block"), [key, "_block"], "left_anti").unionByName(wrong))
