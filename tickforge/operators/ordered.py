"""Row numbers, running sums, ranks and exact percentiles of ordered values without a task per key.

Values are counted first, so that ties are one row, and the counted rows are written once. Per key
they fall into at most ``PARTS`` parts at approximate percentiles; running sums go over a part, and what lies
before a part is a running sum over at most ``PARTS`` rows a key. One feature's values thus spread over
many tasks, however few features there are. Percentiles add up the parts and then look only into
those that hold the places wanted: no other values are sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickforge.sources.shared import new_path, stored

PARTS = 256
#: Rows to a part, while there are fewer than ``PARTS`` times as many.
ROWS = 1 << 13
_WITHIN = 33  # bits of monotonically_increasing_id that count within a partition


def numbered(rows: DataFrame, keys: list[str], order: list, name: str = "_at", parts: int | None = None) -> DataFrame:
    """``rows`` with ``name``, the place (from 0) of each among those of its keys by ``order``; written to the shared folder.

    One range partitioning by keys and order, in which a long key spans many tasks. Places are counted within
    partitions; what a key has in partitions before is a running sum over one row a key and partition. Rows that agree
    in keys and order stay in the order read.
    """
    spark = rows.sparkSession
    by = [*keys, *order, "_read"]
    tie = rows.withColumn("_read", F.monotonically_increasing_id())
    ranged = (tie.repartitionByRange(parts, *by) if parts else tie.repartitionByRange(*by)).sortWithinPartitions(*by)
    made = ranged.withColumn("_id", F.monotonically_increasing_id()).drop("_read")
    path = new_path(spark, "numbered")
    made.write.parquet(path)
    held = spark.read.schema(made.schema).parquet(path).withColumn("_part", F.shiftright("_id", _WITHIN))
    inside = F.col("_id").bitwiseAND((1 << _WITHIN) - 1)
    named = [F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]
    runs = held.groupBy(*named, F.col("_part").alias("_p")).agg(F.min(inside).alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*[f"_{i}" for i in range(len(keys))]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_from", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).drop("_first", "_n")
    same = [F.col("_part") == F.col("_p"), *[held[k].eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)]]
    return held.join(runs, same).select(*[held[c] for c in rows.columns], (F.col("_from") + inside).alias(name))


def _in_parts(counted: DataFrame, keys: list[str], order: str, sums: list[str], parts: int | None) -> tuple[DataFrame, DataFrame]:
    """(rows with _part, (keys, _part) with each sum's _{c} before the part, _own_{c} in it and _all_{c} of the key)."""
    kept = stored(counted, "counted")
    parts = parts or max(2, min(PARTS, kept.count() // ROWS))
    edges = kept.groupBy(*keys).agg(F.percentile_approx(order, [k / parts for k in range(1, parts)], 10 * parts).alias("_edges"))
    placed = (kept.join(edges, keys) if keys else kept.crossJoin(F.broadcast(edges))).withColumn("_part", F.size(F.filter("_edges", lambda e: e < F.col(order)))).drop("_edges")
    totals = placed.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_own_{c}") for c in sums])
    every = Window.partitionBy(*keys)
    upto = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = {f"_{c}": F.coalesce(F.sum(f"_own_{c}").over(upto), F.lit(0)) for c in sums}
    return placed, totals.withColumns(before | {f"_all_{c}": F.sum(f"_own_{c}").over(every) for c in sums})


def _summed(placed: DataFrame, offsets: DataFrame, keys: list[str], order: str, sums: list[str]) -> DataFrame:
    """Rows of the parts that ``offsets`` names, with {c}_before and {c}_all."""
    own = [*keys, "_part"]
    inside = Window.partitionBy(*own).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(offsets, own).withColumns({f"{c}_before": F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_{c}") for c in sums})
    out = out.withColumnsRenamed({f"_all_{c}": f"{c}_all" for c in sums})
    return out.drop("_part", *[f"_{c}" for c in sums], *[f"_own_{c}" for c in sums])


def running(counted: DataFrame, keys: list[str], order: str, sums: list[str], parts: int | None = None) -> DataFrame:
    """Adds ``{c}_before``, the sum of c over the key's rows with a lesser ``order``, and ``{c}_all``, over all. Rows have distinct (keys, order)."""
    placed, offsets = _in_parts(counted, keys, order, sums, parts)
    return _summed(placed, offsets, keys, order, sums)


def counted(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """(keys, x, n, n_before, n_all) of distinct values that aren't null."""
    return running(rows.filter(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("n")), keys, x, ["n"])


def percentiles(rows: DataFrame, keys: list[str], x: str, shares: list[float], parts: int | None = None) -> DataFrame:
    """(keys, q): exact percentiles, interpolated between neighbours; no rows for keys without values."""
    counts = rows.filter(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("n"))
    placed, offsets = _in_parts(counts, keys, x, ["n"], parts)
    places = lambda size: [end(F.lit(s) * (size - 1)) for s in shares for end in (F.floor, F.ceil)]
    holds = [(F.col("_n") <= p) & (p < F.col("_n") + F.col("_own_n")) for p in places(F.col("_all_n"))]
    every = _summed(placed, offsets.filter(F.exists(F.array(*holds), lambda h: h)), keys, x, ["n"])

    def value(place):
        return F.max(F.when((F.col("n_before") <= place) & (place < F.col("n_before") + F.col("n")), F.col(x)))

    ends = [value(p).alias(f"_end{i}") for i, p in enumerate(places(F.col("n_all")))]
    found = every.groupBy(*keys).agg(F.max("n_all").alias("_size"), *ends)
    at = [F.lit(s) * (F.col("_size") - 1) for s in shares]
    between = [F.col(f"_end{2 * k}") + (F.col(f"_end{2 * k + 1}") - F.col(f"_end{2 * k}")) * (a - F.floor(a)) for k, a in enumerate(at)]
    out = found.select(*keys, F.array(*between).alias("q"))
    return out if keys else out.filter(F.col("q")[0].isNotNull())
