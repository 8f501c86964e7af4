"""Exact top-k inner product search: ball-tree branch and bound per shard.

Candidates are dealt to shards of bounded size; a task builds a shard's ball tree (leaves of
``LEAF`` vectors) once and stores it, with the vectors in its order, as arrays in the shared
folder. Queries are stored in blocks likewise. A node's bound is q.center + |q| radius;
nodes are visited in order of it and skipped when it is below the query's current kth score.

That score is shared: within a task, which takes a block through several shards, each shard
starts from the kth scores of the ones before; and between rounds. A block's first round is
one shard, each later one ``GROWTH`` times as many as came before, and the best found so far
give the next round's floors.

Scale: vectors are shuffled once, to be stored, and never copied to query blocks; what a
search sends on are at most k rows a query and run of shards, of which k are kept a round.

Defined results: vectors that are null or hold null, NaN or infinite components, and rows
without vec_id, take no part. Every row whose id is divisible is a query of its own, and
only that row is left out of its candidates: rows of one id are candidates of each other,
and have k results each under the same query_id. Vectors of different lengths aren't
compared. A score that 64 bits can't hold is an error. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickforge.llm import store
from tickforge.llm.common import shared_path, written

LEAF = 128
#: Queries that go their own way through a node's children.
SPLIT = 256
#: Vectors in a shard and queries in a block (about), shards that a task takes a block through, and how rounds grow.
SHARD = 8192
BLOCK = 1024
RUN = 2
GROWTH = 8
FOUND = "dim int, block int, query long, query_id long, vec_id long, score long"
LOWEST = -(2**63) + 1


class BallTree:
    """Nodes as arrays: center, radius, and (first, end, left, right), the root last; ``order`` sorts vectors into leaves."""

    def __init__(self, vectors: np.ndarray):
        self.order = np.arange(len(vectors))
        centers, radii, nodes = [], [], []

        def build(a: int, b: int) -> int:
            """Node over order[a:b]; halves lie on either side of the median along the line of two far points."""
            at = self.order[a:b]
            x = vectors[at]
            center = x.mean(0)
            away = np.linalg.norm(x - center, axis=1)
            left = right = -1
            if b - a > LEAF and away.max() > 0:
                one = x[away.argmax()]
                other = x[np.linalg.norm(x - one, axis=1).argmax()]
                half = (b - a) // 2
                self.order[a:b] = at[np.argsort(x @ (other - one), kind="stable")]
                left, right = build(a, a + half), build(a + half, b)
            centers.append(center)
            radii.append(float(away.max()))
            nodes.append((a, b, left, right))
            return len(nodes) - 1

        if len(vectors):
            build(0, len(vectors))
        self.centers = np.array(centers, np.float64).reshape(len(nodes), vectors.shape[1])
        self.radii = np.array(radii, np.float64)
        self.nodes = np.array(nodes, np.int64).reshape(len(nodes), 4)


class Shard:
    """Candidates in the order of their tree: row numbers, ids, vectors and the tree's arrays."""

    NAMES = (("rows", np.int64), ("ids", np.int64), ("vectors", np.float64), ("centers", np.float64), ("radii", np.float64), ("nodes", np.int64))

    def __init__(self, *arrays: np.ndarray):
        self.rows, self.ids, self.vectors, self.centers, self.radii, self.nodes = arrays

    @classmethod
    def of(cls, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> Shard:
        tree = BallTree(vectors)
        return cls(rows[tree.order], ids[tree.order], vectors[tree.order], tree.centers, tree.radii, tree.nodes)

    def put(self, folder: str, dim: int, cell: int) -> None:
        for name, _ in self.NAMES:
            store.put(folder, f"shard-{dim}-{cell}-{name}", getattr(self, name))

    @classmethod
    def get(cls, folder: str, dim: int, cell: int) -> Shard:
        rows, ids, vectors, centers, radii, nodes = (np.asarray(store.get(folder, f"shard-{dim}-{cell}-{name}", kind)) for name, kind in cls.NAMES)
        return cls(rows, ids, vectors.reshape(len(ids), dim), centers.reshape(len(radii), dim), radii, nodes.reshape(len(radii), 4))


def _dot(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Exact integer products, none beyond ``most``: by doubles where they can hold them, else by integers."""
    if most < 2**53:
        return a @ b.T
    if most < 2**63:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in r] for r in x.tolist()], object).reshape(x.shape)
    return (whole(a) @ whole(b).T).astype(np.int64)


def _largest(x: np.ndarray) -> float:
    return np.abs(x).max(initial=0)


class Search:
    """The k best candidates of each query of a block that reach its floor (ties: smaller id), its own row left out."""

    def __init__(self, rows: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int):
        self.rows, self.queries, self.floor, self.k = rows, queries, floor, k
        self.best = np.full((len(queries), k), np.iinfo(np.int64).min, np.int64)
        self.who = np.full((len(queries), k), np.iinfo(np.int64).max, np.int64)
        self.length = np.linalg.norm(queries, axis=1)
        self.largest = _largest(queries)

    def _bound(self, shard: Shard, node: int, q: np.ndarray) -> np.ndarray:
        center, reach = shard.centers[node], self.length[q] * shard.radii[node]
        return self.queries[q] @ center + reach + 1e-9 * (reach + self.length[q] * np.linalg.norm(center)) + 1e-6

    def through(self, shard: Shard) -> None:
        if len(shard.nodes) and len(self.queries):
            root, everyone = len(shard.nodes) - 1, np.arange(len(self.queries))
            self.most = self.largest * _largest(shard.vectors) * max(1, self.queries.shape[1])
            self._visit(shard, root, everyone, self._bound(shard, root, everyone))

    def _visit(self, shard: Shard, node: int, q: np.ndarray, upper: np.ndarray) -> None:
        q = q[upper >= np.maximum(self.best[q, -1], self.floor[q])]
        if not len(q):
            return
        a, b, left, right = shard.nodes[node].tolist()
        if left < 0:
            for lo in range(a, b, 4 * LEAF):  # a leaf of equal vectors may be long
                self._leaf(shard, q, lo, min(b, lo + 4 * LEAF))
            return
        up_left, up_right = self._bound(shard, left, q), self._bound(shard, right, q)
        ways = ((left, up_left), (right, up_right)), ((right, up_right), (left, up_left))
        first = up_left >= up_right
        many = int(first.sum())
        if min(many, len(q) - many) < SPLIT:  # few go with the others: the order costs them bounds, never results
            groups = [(slice(None), ways[2 * many < len(q)])]
        else:
            groups = [(first, ways[0]), (~first, ways[1])]
        for mine, order in groups:
            for child, up in order:
                self._visit(shard, child, q[mine], up[mine])

    def _leaf(self, shard: Shard, q: np.ndarray, a: int, b: int) -> None:
        worst, last = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        scores = _dot(self.queries[q], shard.vectors[a:b], self.most)
        out = (scores < np.maximum(self.best[q, -1], self.floor[q])[:, None]) | (shard.rows[a:b][None, :] == self.rows[q][:, None])
        some = np.flatnonzero(~out.all(1))
        q, scores, out = q[some], scores[some].astype(np.int64), out[some]
        if not len(q):
            return
        scores[out] = worst
        names = np.where(out, last, shard.ids[a:b][None, :])
        scores, names = np.concatenate([self.best[q], scores], 1), np.concatenate([self.who[q], names], 1)
        order = np.lexsort((names, ~scores), axis=1)[:, : self.k]  # ~ turns the order without overflow
        self.best[q], self.who[q] = np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, id, score) of all that was found."""
        at = np.nonzero(self.best > np.iinfo(np.int64).min)
        return at[0], self.who[at], self.best[at]


def _columns(part: pd.DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, ids and vectors in order of row number, which reruns share."""
    part = part.sort_values("row")
    return part["row"].to_numpy(np.int64), part["vec_id"].to_numpy(np.int64), np.array(part["v"].tolist(), np.float64).reshape(len(part), dim)


def _store_shard(folder: str):
    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        dim, cell = map(int, key)
        Shard.of(*_columns(part, dim)).put(folder, dim, cell)
        return pd.DataFrame({"dim": [dim], "cell": [cell]})

    return run


def _store_block(folder: str):
    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        dim, cell = map(int, key)
        for name, array in zip(("rows", "ids", "vectors"), _columns(part, dim), strict=True):
            store.put(folder, f"block-{dim}-{cell}-{name}", array)
        return pd.DataFrame({"dim": [dim], "cell": [cell]})

    return run


def _cells(rows: DataFrame, store_cell, name: str) -> DataFrame:
    """(dim, cell) of the cells that rows (row, vec_id, v, dim, cell) fill."""
    return written(rows.groupBy("dim", "cell").applyInPandas(store_cell, "dim int, cell int"), name)


def _search(folder: str, k: int):
    """Rows (dim, block, shards, floors) in; the best of those shards for every query of the block out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for dim, block, shards, floors in zip(part["dim"], part["block"], part["shards"], part["floors"], strict=True):
                rows, ids, queries = (np.asarray(store.get(folder, f"block-{dim}-{block}-{name}", kind)) for name, kind in Shard.NAMES[:3])
                floor = np.full(len(rows), LOWEST)
                if floors is not None and len(floors):
                    floor[np.searchsorted(rows, [f["query"] for f in floors])] = [f["score"] for f in floors]
                search = Search(rows, queries.reshape(len(rows), dim), floor, k)
                for shard in shards:
                    search.through(Shard.get(folder, dim, shard))
                at, vec_id, score = search.found()
                yield pd.DataFrame({"dim": dim, "block": block, "query": rows[at], "query_id": ids[at], "vec_id": vec_id, "score": score})

    return run


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): finite vectors with every component as floor(256 x)."""
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    return embeddings.filter(F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score) of every row whose id is divisible by ``every``."""
    spark = embeddings.sparkSession
    folder = shared_path(spark, "vectors")
    vectors = written(integer_vectors(embeddings).withColumns({"dim": F.size("v"), "row": F.monotonically_increasing_id()}), "vectors")
    asked = vectors.filter(F.col("vec_id") % every == 0)
    n, m = vectors.count(), asked.count()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-m // BLOCK))
    cell = lambda count: F.pmod(F.xxhash64("row"), F.lit(count)).cast("int").alias("cell")
    full = _cells(vectors.select("row", "vec_id", "v", "dim", cell(shards)), _store_shard(folder), "shard-cells")
    of = _cells(asked.select("row", "vec_id", "v", "dim", cell(blocks)), _store_block(folder), "block-cells").withColumnRenamed("cell", "block")
    # (dim, block, shard, turn): each block takes its length's shards in turn, from another one on
    place = F.row_number().over(Window.partitionBy("dim").orderBy("cell")) - 1
    placed = full.withColumns({"place": place, "all": F.count("*").over(Window.partitionBy("dim"))})
    turns = of.join(placed, "dim").select("dim", "block", F.col("cell").alias("shard"), F.pmod(F.col("place") - F.col("block"), F.col("all")).alias("turn"))
    best, done, upto = None, 0, 1
    while done < shards:
        mine = turns.filter((F.col("turn") >= done) & (F.col("turn") < upto))
        mine = mine.groupBy("dim", "block", F.floor(F.col("turn") / RUN).alias("run")).agg(F.collect_list("shard").alias("shards"))
        if best is None:
            mine = mine.withColumn("floors", F.lit(None).cast("array<struct<query:bigint,score:bigint>>"))
        else:
            kth = best.filter(F.col("rank") == k).groupBy("dim", "block").agg(F.collect_list(F.struct("query", "score")).alias("floors"))
            mine = mine.join(kth, ["dim", "block"], "left")
        tasks = min(blocks * -(-(min(upto, shards) - done) // RUN), 20_000)
        found = mine.select("dim", "block", "shards", "floors").repartition(tasks).mapInPandas(_search(folder, k), FOUND)
        found = found if best is None else found.unionByName(best.drop("rank"))
        w = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
        best = written(found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k), "best")
        done, upto = upto, upto * (GROWTH + 1)
    return best.select("query_id", "rank", "vec_id", "score")
