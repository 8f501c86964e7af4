"""Kernel distance and nearest neighbours between two vector sets (id, v).

Rows are assigned to the nearest of some pivots. Each set is shuffled once: cells are cut into pieces of some
``BLOCK`` rows, and a piece is an array file in the shared folder. A task takes a piece (or a slice of one, while
there are few) through the other set's pieces, which it reads one after the other; only a sum or the k nearest of its
own rows leave it. What is shuffled and written thus grows with the rows, not with their pairs.

By the triangle inequality rows of two cells are no nearer than their pivots' distance less both radii; cells too far
to hold a neighbour or a kernel value that shows are not read. Which rows are pivots decides how much is skipped, not
what is found.

Pairs of pieces are worked out by matrix products around a pivot. Kernel values come from them as long as rounding
can't show. Of neighbours they only say, in single precision and with a margin for its errors, which pairs may be among
the nearest; these are worked out from differences.

Rows without a vector take no part. Rows that share an id are rows of their own.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.operators import ordered
from tickforge.sources.files import read_bytes, write_bytes
from tickforge.sources.shared import new_path, stored

#: Rows of a piece, and of a cell while there are fewer than ``PIVOTS`` of them.
BLOCK = 2048
#: Cells at most: what is known of cells, and of pairs of cells, is bounded by it.
PIVOTS = 256
#: Slices of a piece at most, while there are fewer pieces than twice the cores; and tasks of a search at most.
SLICES, TASKS = 8, 20_000
#: Kernel values below this are taken for zero; so no mean is off by more.
LEAST = 1e-13
#: Share of itself by which a kernel value from a matrix product is off at most.
ROUNDED = 1e-12
#: Bounds are widened by this share, against rounding.
_SLACK = 1e-9
#: Differences, or products, held at a time: a megabyte of them.
_TILE = 1 << 17
#: Share of a pair of pieces up to which its pairs are looked at one by one.
_FEW = 0.05


@dataclass(frozen=True)
class Cells:
    """A set by cell: its rows, its radius around the pivot and the files of its pieces."""

    spark: SparkSession
    counts: np.ndarray
    radius: np.ndarray
    pivots: np.ndarray
    pieces: list[list[str]]

    @property
    def size(self) -> int:
        return int(self.counts.sum())


def _matrix(part: pd.DataFrame) -> np.ndarray:
    return np.array(part["v"].tolist(), np.float64).reshape(len(part), -1)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances from differences, in tiles that stay in a core's cache: exact zeros for equal vectors."""
    out = np.empty((len(x), len(y)))
    wide = max(16, _TILE // (16 * max(1, x.shape[1])))
    for i in range(0, len(x), 16):
        for j in range(0, len(y), wide):
            d = x[i : i + 16, None, :] - y[None, j : j + wide]
            out[i : i + 16, j : j + wide] = np.einsum("ijk,ijk->ij", d, d)
    return out


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(_squares(x, y))


def _kernel_sum(x: np.ndarray, y: np.ndarray, pivot: np.ndarray, bandwidth: float) -> float:
    """Sum of exp(-d2 / 2h2) over all pairs: -d2 / 2 is a product of rows with two places more, off by a share of the lengths at most."""
    a, b = (x - pivot) / bandwidth, (y - pivot) / bandwidth
    p, q = ((m * m).sum(axis=1) / 2 for m in (a, b))
    off = (a.shape[1] + 8) * np.finfo(float).eps / 2 * (np.sqrt(p.max(initial=0)) + np.sqrt(q.max(initial=0))) ** 2
    if not off <= ROUNDED:
        return float(np.exp(-_squares(x, y) / (2 * bandwidth**2)).sum())
    left, right = np.column_stack([a, -p, np.ones(len(a))]), np.column_stack([b, np.ones(len(b)), -q]).T
    total, tall = 0.0, max(1, _TILE // max(1, len(y)))
    for i in range(0, len(left), tall):
        t = left[i : i + tall] @ right
        total += float(np.exp(t, out=t).sum())
    return total


def _near_pairs(x: np.ndarray, y: np.ndarray, pivot: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, ascending; row of y; squared distance) of some pairs, all those among them that have a row's k least distances up to its bound.

    A bound of NaN is none. Products in single precision tell which pairs may be meant.
    """
    a, b = x - pivot, y - pivot
    p, q = ((m * m).sum(axis=1) for m in (a, b))
    # more than a product is off by; where numbers are too small for single precision, all pairs are meant
    off = (a.shape[1] + 8) * (float(np.finfo(np.float32).eps) * (np.sqrt(p) + np.sqrt(q.max(initial=0))) ** 2 + float(np.finfo(np.float32).tiny))
    if np.isfinite(off).all() and off.max(initial=0) < 1e30:
        left = np.column_stack([a, np.ones(len(a))]).astype(np.float32)
        right = np.column_stack([b, -q / 2]).astype(np.float32).T
        i, j, tall = [], [], max(1, 2 * _TILE // max(1, len(y)))
        for lo in range(0, len(left), tall):
            t = left[lo : lo + tall] @ right  # (|x|2 - d2) / 2
            least = (p[lo : lo + tall] - bound[lo : lo + tall]) / 2
            if np.isnan(least).any():
                kth = np.partition(t, len(y) - k, axis=1)[:, len(y) - k].astype(float) - off[lo : lo + tall] if len(y) > k else np.full(len(t), -np.inf)
                least = np.fmax(least, kth)
            # rounded down once more: a bound is no longer exact in single precision
            least = np.nextafter((least - off[lo : lo + tall]).astype(np.float32), np.float32(-np.inf))
            at = np.flatnonzero(t >= least[:, None])
            i.append(at // len(y) + lo)
            j.append(at % len(y))
        i, j = np.concatenate(i), np.concatenate(j)
        if len(i) <= max(_FEW * len(x) * len(y), k * len(x)):
            d2, wide = np.empty(len(i)), max(1, _TILE // max(1, x.shape[1]))
            for lo in range(0, len(i), wide):
                d = x[i[lo : lo + wide]] - y[j[lo : lo + wide]]
                d2[lo : lo + wide] = np.einsum("ij,ij->i", d, d)
            return i, j, d2
    d2 = _squares(x, y)
    if d2.shape[1] > k:
        j = np.argpartition(d2, k - 1, axis=1)[:, :k]
    else:
        j = np.tile(np.arange(len(y)), (len(x), 1))
    return np.repeat(np.arange(len(x)), j.shape[1]), j.ravel(), np.take_along_axis(d2, j, axis=1).ravel()


def _kept_in(folder: str) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Writes a piece as a file; its name is of the attempt, so that none is written twice."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_row")
        name, out = f"{folder}/{uuid.uuid4().hex}.npz", io.BytesIO()
        np.savez(out, id=part["id"].fillna(0).to_numpy(np.int64), known=part["id"].notna().to_numpy(bool), v=_matrix(part))
        write_bytes(name, out.getvalue())
        return pd.DataFrame({"_set": [key[0]], "_cell": [key[1]], "_piece": [key[2]], "name": [name]})

    return run


def _read(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, which of them are known, vectors) of a piece."""
    with np.load(io.BytesIO(read_bytes(name))) as held:
        return held["id"], held["known"], held["v"]


def in_cells(*sets: DataFrame, block: int = BLOCK) -> list[Cells]:
    """The sets in cells around the same pivots, one pivot to ``block`` rows and at most ``PIVOTS``."""
    spark = sets[0].sparkSession
    tagged = [s.select(F.lit(k).alias("_set"), "id", "v").filter(F.col("v").isNotNull()) for k, s in enumerate(sets)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionAll(t)
    kept = stored(every.withColumn("_row", F.monotonically_increasing_id()), "vectors")
    wanted = max(1, min(PIVOTS, kept.count() // block))
    picked = kept.select("v").orderBy(F.xxhash64("_row", "id"), "_row").limit(wanted).collect()  # at most PIVOTS rows
    if not picked:
        none = np.zeros(0)
        return [Cells(spark, none, none, none.reshape(0, 0), []) for _ in sets]
    pivots = np.unique(np.array([r[0] for r in picked], np.float64), axis=0)

    def assign(batches):
        for part in batches:
            d = _distances(_matrix(part), pivots)
            cell = d.argmin(axis=1)
            yield part.assign(_cell=cell, _from=d[np.arange(len(part)), cell])

    placed = stored(kept.mapInPandas(assign, "_set int, id long, v array<double>, _row long, _cell int, _from double"), "cells")
    known = placed.groupBy("_set", "_cell").agg(F.count("*").alias("n"), F.max("_from").alias("r")).collect()  # a row a cell and set
    table = F.broadcast(spark.createDataFrame([(r["_set"], r["_cell"], -(-r["n"] // block)) for r in known], "_set int, _cell int, _pieces long"))
    piece = F.pmod(F.xxhash64("_row"), F.col("_pieces")).cast("int").alias("_piece")
    dealt = placed.join(table, ["_set", "_cell"]).select("_set", "_cell", piece, "_row", "id", "v")
    kept_in = _kept_in(new_path(spark, "pieces"))
    named = stored(dealt.groupBy("_set", "_cell", "_piece").applyInPandas(kept_in, "_set int, _cell int, _piece int, name string"), "piece-names")
    names = named.orderBy("_set", "_cell", "_piece").collect()  # a row a piece
    out = []
    for k in range(len(sets)):
        counts, radius = np.zeros(len(pivots), int), np.zeros(len(pivots))
        pieces: list[list[str]] = [[] for _ in pivots]
        for r in known:
            if r["_set"] == k:
                counts[r["_cell"]], radius[r["_cell"]] = r["n"], r["r"]
        for r in names:
            if r["_set"] == k:
                pieces[r["_cell"]].append(r["name"])
        out.append(Cells(spark, counts, radius, pivots, pieces))
    return out


#: Of a slice: its cell, the place of its piece there, and its ids, which of them are known, and vectors.
Work = Callable[[int, int, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame]


def _on_pieces(cells: Cells, work: Work, schema: str) -> DataFrame:
    """``work`` on all pieces, each by itself or in slices."""
    names = [(i, k, name) for i, held in enumerate(cells.pieces) for k, name in enumerate(held)]
    cut = max(1, min(SLICES, -(-2 * cells.spark.sparkContext.defaultParallelism // len(names))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in batch["id"].tolist():
                i, k, name = names[at // cut]
                yield work(i, k, *[x[at % cut :: cut] for x in _read(name)])

    n = len(names) * cut
    return cells.spark.range(0, n, 1, min(n, TASKS)).mapInPandas(run, schema)


def _gaps(left: Cells, right: Cells) -> np.ndarray:
    """By pair of cells, what the distance of their rows is at least."""
    d = _distances(left.pivots, right.pivots)
    return np.maximum(0.0, d * (1 - _SLACK) - (left.radius[:, None] + right.radius) * (1 + _SLACK))


def _kernel_mean(left: Cells, right: Cells, bandwidth: float) -> tuple[float | None, float]:
    """(mean, share of pairs skipped). Of a set with itself each pair of pieces is worked out in one order."""
    if not left.size or not right.size:
        return None, 0.0
    same, pivots, others = left is right, left.pivots, right.pieces
    gaps = _gaps(left, right)
    shows = ~(np.exp(-(gaps**2) / (2 * bandwidth**2)) < LEAST)

    def work(i: int, k: int, _ids: np.ndarray, _known: np.ndarray, v: np.ndarray) -> pd.DataFrame:
        total = 0.0
        for j in np.flatnonzero(shows[i]).tolist():
            for q, name in enumerate(others[j]):
                if same and (j, q) < (i, k):
                    continue
                twice = 2 if same and (j, q) != (i, k) else 1
                total += twice * _kernel_sum(v, _read(name)[2], pivots[i], bandwidth)
        return pd.DataFrame({"s": [total]})

    total = _on_pieces(left, work, "s double").agg(F.sum("s")).first()[0]
    done = left.counts @ shows @ right.counts
    return total / (left.size * right.size), 1 - float(done) / (left.size * right.size)


def kernel_mean(left: DataFrame, right: DataFrame, bandwidth: float = 1.0, block: int = BLOCK) -> float | None:
    """Mean of exp(-d2 / 2h2) over all pairs."""
    made = in_cells(left, block=block) * 2 if left is right else in_cells(left, right, block=block)
    return _kernel_mean(*made, bandwidth)[0]


def mmd_rbf(real: DataFrame, synthetic: DataFrame, bandwidth: float = 1.0, block: int = BLOCK) -> dict[str, float | None]:
    """Biased squared MMD with its three kernel means, diagonals included; nulls where a set is empty.

    ``pairs_skipped`` is the share of all pairs of the three means that were not worked out.
    """
    return mmd_of_cells(*in_cells(real, synthetic, block=block), bandwidth)


def mmd_of_cells(x: Cells, y: Cells, bandwidth: float = 1.0) -> dict[str, float | None]:
    """``mmd_rbf`` of sets that are in cells already."""
    (xx, s1), (yy, s2), (xy, s3) = _kernel_mean(x, x, bandwidth), _kernel_mean(y, y, bandwidth), _kernel_mean(x, y, bandwidth)
    sizes = [x.size**2, y.size**2, x.size * y.size]
    skipped = sum(n * s for n, s in zip(sizes, (s1, s2, s3), strict=True)) / max(1, sum(sizes))
    return {"xx": xx, "yy": yy, "xy": xy, "mmd": None if None in (xx, yy, xy) else xx + yy - 2 * xy, "pairs_skipped": skipped}


def neighbours(queries: Cells, base: Cells, k: int) -> tuple[DataFrame, float]:
    """((id, rank, distance), share of pairs of rows that were not worked out).

    A piece goes through the cells from the nearest one on; a row whose kth distance so far doesn't reach a cell
    leaves it out.
    """
    if not queries.size or not base.size:
        return queries.spark.createDataFrame([], "id long, rank int, distance double"), 0.0
    order = np.argsort(_distances(queries.pivots, base.pivots), axis=1, kind="stable")
    radius, centres, pivots, others = base.radius, queries.pivots, base.pivots, base.pieces
    most = min(k, base.size)

    def work(i: int, _k: int, ids: np.ndarray, known: np.ndarray, v: np.ndarray) -> pd.DataFrame:
        best, done = np.full((len(v), k), np.nan), 0  # squared; NaN sorts last and bounds nothing
        away = _distances(v, pivots) * (1 - _SLACK) - radius * (1 + _SLACK)
        for j in order[i].tolist():
            for name in others[j]:
                rows = np.flatnonzero(~(away[:, j] > np.sqrt(best[:, -1]) * (1 + _SLACK)))
                if not len(rows):
                    break
                theirs = _read(name)[2]
                at, _, d2 = _near_pairs(v[rows], theirs, centres[i], best[rows, -1], k)
                done += len(rows) * len(theirs)
                if not len(at):
                    continue
                by = np.lexsort([d2, at])
                at, d2 = at[by], d2[by]
                first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
                met, place, d2 = at[place < k], place[place < k], d2[place < k]
                new = np.full((len(rows), k), np.nan)
                new[met, place] = d2
                some = at[first]
                best[rows[some]] = np.sort(np.concatenate([best[rows[some]], new[some]], axis=1), axis=1)[:, :k]
        out = pd.DataFrame({"id": np.repeat(ids, most), "rank": np.tile(np.arange(1, most + 1, dtype=np.int32), len(v)), "distance": np.sqrt(best[:, :most]).ravel(), "done": 0})
        out.loc[:0, "done"] = done
        return out.assign(id=out["id"].astype("Int64").mask(np.repeat(~known, most)))

    found = stored(_on_pieces(queries, work, "id long, rank int, distance double, done long"), "nearest")
    done = found.agg(F.sum("done")).first()[0]
    return found.drop("done"), 1 - done / (queries.size * base.size)


def nearest(queries: DataFrame, base: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(id, rank, distance): the k nearest of ``base`` to each query, itself included if it is there."""
    return neighbours(*in_cells(queries, base, block=block), k)[0]


def nndr(real: DataFrame, synthetic: DataFrame, n_neighbors: int = 5, drop_first_synthetic: bool = True) -> DataFrame:
    """(synthetic_to_real, real_to_real, nndr, privacy_risk).

    k + 1 neighbours are found and the nearest is left out on both sides; for synthetic rows
    ``drop_first_synthetic=False`` keeps it and leaves out the farthest instead.
    """
    x, y = in_cells(real, synthetic)
    return nndr_of_cells(x, neighbours(y, x, n_neighbors + 1)[0], n_neighbors, drop_first_synthetic)


def nndr_of_cells(x: Cells, found: DataFrame, n_neighbors: int = 5, drop_first_synthetic: bool = True) -> DataFrame:
    """``nndr`` of a real set in cells, ``found`` being the k + 1 nearest real rows of each synthetic one."""
    k = n_neighbors + 1
    kept = F.col("rank") > 1 if drop_first_synthetic else F.col("rank") < k
    s = found.filter(kept).agg(F.avg("distance").alias("synthetic_to_real"))
    r = neighbours(x, x, k)[0].filter("rank > 1").agg(F.avg("distance").alias("real_to_real"))
    ratio = F.col("synthetic_to_real") / (F.col("real_to_real") + 1e-10)
    return s.crossJoin(r).withColumn("nndr", ratio).withColumn("privacy_risk", F.col("nndr") < 0.5)


def closest_record(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """(id, dcr) of every synthetic row."""
    return nearest(synthetic, real, 1).select("id", F.col("distance").alias("dcr"))


def dcr_summary(dcr: DataFrame) -> DataFrame:
    q = ordered.percentiles(dcr, [], "dcr", [0.05, 0.5])
    return dcr.agg(F.avg("dcr").alias("mean_dcr"), F.min("dcr").alias("min_dcr")).crossJoin(q).select("mean_dcr", F.col("q")[1].alias("median_dcr"), "min_dcr", F.col("q")[0].alias("p5_dcr"))


def membership_risk(dcr: DataFrame, percentile: float = 5.0) -> DataFrame:
    """The summary, and the share of rows no farther than the percentile of their own distances."""
    q = ordered.percentiles(dcr, [], "dcr", [0.05, 0.5, percentile / 100])  # one row
    share = F.avg((F.col("dcr") <= F.col("q")[2]).cast("double"))
    found = dcr.crossJoin(F.broadcast(q)).agg(F.avg("dcr").alias("mean_dcr"), F.min("dcr").alias("min_dcr"), F.first("q").alias("q"), share.alias("membership_inference_risk"))
    at = lambda k, name: F.col("q")[k].alias(name)
    return found.select("mean_dcr", at(1, "median_dcr"), "min_dcr", at(0, "p5_dcr"), "membership_inference_risk", at(2, "threshold"))
