"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Sources get a share of a word budget by weight, none more than ``cap`` times its size (the
excess is reshared: one water level, found from prefix sums over the sources). A source's
target is met by complete epochs over all its documents first; the rest by sampling: each
document has the key -ln(u) / weight, with u from a digest of its id and its quality as
weight; documents are taken in key order up to the budget. The last one is taken if that
brings the sum nearer.

Scale: a source may hold most rows, so that none is sorted as a whole. Keys fall into
buckets of about a thousand rows; bucket sums are prefix-summed and only the bucket at which
the budget ends is sorted. What is joined to the rows is one row per source. Texts are not
shuffled.

Defined results: null text has size 0. Null source is a source, last in order. A null
doc_id has a key like any other. Ties are ordered by doc_id, size and place in the table;
the place depends on how the input is split, so that rows alike in id, size and key may trade places
between runs that split it otherwise: sizes and totals stay the same.
If all sizes are 0, targets are 0. Extra columns pass through ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.llm.common import WORD, whole_row, written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
SYMBOLS = "#*$%&|<>"
#: Rows aimed at in a bucket of keys.
BUCKET = 1000
BROADCAST_SOURCES = 100_000


def size(text: Column) -> Column:
    """Words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """Default document weight: 1 less the share of symbols, no less than 0.1."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.greatest(F.lit(0.1), 1 - F.coalesce(symbols / F.greatest(F.length(text), F.lit(1)), F.lit(0)))


def uniform(doc_id: Column) -> Column:
    """A number above 0 and below 1 from the id's MD5 digest: 52 bits and a half."""
    bits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def keyed(held: DataFrame, text: Column, doc_id: Column, source: Column, weight: Column | None = None) -> DataFrame:
    """Adds _source, _size, the sampling key _key and _order, which ties are broken by."""
    key = -F.log(uniform(doc_id)) / (quality(text) if weight is None else weight)
    out = held.withColumns({"_source": source.cast("string"), "_size": size(text), "_key": key, "_place": F.monotonically_increasing_id()})
    return out.withColumn("_order", F.struct("_key", doc_id.alias("id"), "_size", "_place"))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds _target to (_source, _total, ...): min(cap, level * weight) at the level that spends the budget."""
    rank = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last()))
    out = sources.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")))
    out = out.withColumn("_most", cap * F.col("_total"))
    ratio = Window.orderBy("_ratio", F.col("_source").asc_nulls_last())
    everything = Window.partitionBy()
    out = out.withColumn("_ratio", F.col("_most") / F.col("_w"))
    before = F.coalesce(F.sum("_most").over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("_w").over(ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    out = out.withColumn("_level", (share * F.sum("_total").over(everything) - before) / onward)
    level = F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "_source", "_level"))).over(everything)["_level"]
    return out.withColumn("_target", F.when(F.col("_ratio") <= F.col("_level"), F.col("_most")).otherwise(F.col("_w") * level)).drop("_w", "_most", "_ratio", "_level")


def _with(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Rows with their source's row; broadcast only when counted to be few."""
    few = per_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    right = per_source.withColumnRenamed("_source", "_same")
    return rows.join(F.broadcast(right) if few else right, F.col("_source").eqNullSafe(F.col("_same")), "left").drop("_same")


def _bucket(n: Column) -> Column:
    """Buckets grow with the key and hold about BUCKET rows each, few times more at most."""
    return F.floor(F.col("_key") / (1 + F.col("_key")) * n)


def plan(rows: DataFrame) -> DataFrame:
    """Per source: _total, _target, _epochs, _n (buckets), _edge (the bucket where sampling ends), _last (order of its last row taken).

    ``rows`` has _source, _size, _key and _order.
    """
    sources = targets(rows.groupBy("_source").agg(F.sum("_size").alias("_total"), F.count("*").alias("_rows")))
    epochs = F.when(F.col("_total") > 0, F.floor(F.col("_target") / F.col("_total"))).otherwise(0).cast("long")
    sources = sources.withColumns({"_epochs": epochs, "_n": F.ceil(F.col("_rows") / BUCKET)}).drop("_rows")
    sources = written(sources.withColumn("_budget", F.col("_target") - F.col("_epochs") * F.col("_total")), "mix-sources")
    spread = _with(rows, sources.select("_source", "_n", "_budget")).withColumn("_bucket", _bucket(F.col("_n")))
    sums = spread.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_sum"), F.max("_budget").alias("_budget"))
    upto = F.sum("_sum").over(Window.partitionBy("_source").orderBy("_bucket"))
    ends = sums.withColumn("_upto", upto).filter(F.col("_upto") >= F.col("_budget"))
    edge = ends.groupBy("_source").agg(F.min(F.struct("_bucket", "_upto", "_sum")).alias("_e"))
    edge = written(edge.select("_source", F.col("_e._bucket").alias("_edge"), (F.col("_e._upto") - F.col("_e._sum")).alias("_before")), "mix-edges")
    at_edge = _with(spread, edge).filter(F.col("_bucket") == F.col("_edge"))
    w = Window.partitionBy("_source").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    prefix = F.col("_before") + F.coalesce(F.sum("_size").over(w), F.lit(0))
    taken = at_edge.withColumn("_prefix", prefix).filter(F.col("_prefix") + F.col("_size") / 2 <= F.col("_budget"))
    last = taken.groupBy("_source").agg(F.max("_order").alias("_last"))
    return written(_with(_with(sources, edge), last).drop("_before", "_budget"), "mix-plan")


def decided(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Adds the source's row and _copies, the times that a row is taken."""
    out = _with(rows, planned)
    bucket = _bucket(F.col("_n"))
    sampled = (bucket < F.col("_edge")) | ((bucket == F.col("_edge")) & F.coalesce(F.col("_order") <= F.col("_last"), F.lit(False)))
    return out.withColumn("_copies", F.col("_epochs") + F.coalesce(sampled, F.lit(False)).cast("long"))


def mixture(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's) and taken, its words in the mix."""
    rows = keyed(docs.select("doc_id", "text", "source"), F.col("text"), F.col("doc_id"), F.col("source"))
    rows = written(rows.drop("text", "source"), "mix-rows")
    return decided(rows, plan(rows)).select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_total").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).alias("taken"),
    )


def mix(docs: DataFrame) -> DataFrame:
    """``docs`` as mixed: each row as often as it is taken. Only the narrow rows that plan it are written."""
    held = docs.select(whole_row(docs))
    rows = keyed(held, F.col("_doc.text"), F.col("_doc.doc_id"), F.col("_doc.source"))
    planned = plan(written(rows.drop("_doc"), "mix-rows"))
    return decided(rows, planned).withColumn("_n", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))).select("_doc.*")
