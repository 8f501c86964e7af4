"""Near-duplicates by 64-bit SimHash with anchor-point covering.

Two fingerprints at most 3 bits apart differ in at most 1 bit of one of their 32-bit
halves. On a half the anchors are the codewords of a covering code: the perfect Hamming
code of length 31 (covering radius 1) and one free bit, 2^27 anchors in all. Every
distinct fingerprint is replicated, for either half, to every anchor within covering
radius plus threshold = 2 (17 anchors, or 2 if the half is itself a codeword). For a
linked pair the nearest anchor of the one lies within 2 of the other, so that both meet
there; within an anchor whole fingerprints are compared.

Groups: exact copies of a fingerprint collapse before anything is replicated. Anchors
with more than ``BLOCK`` members are split into blocks, and each pair of blocks is
compared by itself. Of an anchor's links only a spanning star per local component is
emitted. Components follow by alternating large-star and small-star steps over tables in
the shared folder; nothing of the corpus is gathered on the driver.

Defined results: null and empty texts have fingerprint zero and link like any other; a
null doc_id takes part, and component_id is the least doc_id that is not null (null if
there is none). Repeated rows give repeated result rows. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tickforge.llm.common import whole_row, written

SEED = 42
WIDTH = 3
THRESHOLD = 3
#: Members of an anchor up to which one task compares them all.
BLOCK = 4096
_CHUNK = 1 << 16
_LOW31 = np.int64(0x7FFFFFFF)
_FREE = np.int64(1 << 31)


def fingerprint(text: str | None) -> int:
    """The SimHash of a text's 3-word shingles, as an unsigned integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    hashed, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) < WIDTH:
        return hashed(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    first, last = (end - size)[: 1 - WIDTH].tolist(), end[WIDTH - 1 :].tolist()
    total, n = np.zeros(64, np.int64), len(first)
    for k in range(0, n, _CHUNK):
        part = np.array([hashed(joined[a:b], SEED) for a, b in zip(first[k : k + _CHUNK], last[k : k + _CHUNK], strict=True)], np.uint64)
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64))


def fingerprints(text: Column) -> Column:
    return pandas_udf(_fingerprints, "long")(text)


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def anchors_of(half: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(indices, anchors, nearest?) of all anchors within 2 of each 32-bit half."""
    every = np.arange(len(half))
    low, free = half & _LOW31, half & _FREE
    syndrome = np.zeros(len(half), np.int64)
    for i in range(31):
        syndrome ^= np.where((low >> i) & 1, i + 1, 0)
    nearest = np.where(syndrome > 0, low ^ (np.int64(1) << np.maximum(syndrome - 1, 0)), low)
    yield every, nearest | free, True
    yield every, nearest | (free ^ _FREE), False
    for i in range(1, 32):  # two flips whose positions sum to the syndrome
        j = syndrome ^ i
        at = np.flatnonzero((syndrome > 0) & (j > i) & (j < 32))
        yield at, (low[at] ^ np.int64(1 << (i - 1)) ^ (np.int64(1) << (j[at] - 1))) | free[at], False


def _replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        fp = part["fp"].to_numpy(np.int64)
        for side in (0, 1):
            half = ((fp.view(np.uint64) >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            at, anchor, near = zip(*[(i, a, np.full(len(i), x)) for i, a, x in anchors_of(half)], strict=True)
            yield pd.DataFrame({"anchor": np.concatenate(anchor) * 2 + side, "fp": fp[np.concatenate(at)], "near": np.concatenate(near)})


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star per component of the links a-b: (node, least node) for all but the least."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = index[: len(a)], index[len(a) :], np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[at], nodes[label[at]]


def _links(key: np.ndarray, fp: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal ``key`` (sorted), one star per component of a run and offset.

    At least one of a pair has the anchor as its nearest. Pairs are compared offset by
    offset over whole arrays, so that nothing of a run's square is held.
    """
    a, b = [], []
    value = fp.view(np.uint64)
    at = np.flatnonzero(key[1:] == key[:-1])
    step = 1
    while len(at):
        close = np.bitwise_count(value[at] ^ value[at + step]) <= THRESHOLD
        hit = at[close & (near[at] | near[at + step])]
        a.append(fp[hit])
        b.append(fp[hit + step])
        if sum(map(len, a)) > 1 << 20:
            a, b = map(list, zip(_roots(np.concatenate(a), np.concatenate(b)), strict=True))
        step += 1
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
    return _roots(np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows in, links out; a run that a batch's end cuts is carried over."""
    rest = None
    for part in batches:
        part = part if rest is None else pd.concat([rest, part], ignore_index=True)
        key = part["cell"].to_numpy(np.int64)
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        rest = part.iloc[cut:]
        if cut:
            a, b = _links(key[:cut], part["fp"].to_numpy(np.int64)[:cut], part["near"].to_numpy(bool)[:cut])
            yield pd.DataFrame({"a": a, "b": b})
    if rest is not None and len(rest):
        a, b = _links(rest["cell"].to_numpy(np.int64), rest["fp"].to_numpy(np.int64), rest["near"].to_numpy(bool))
        yield pd.DataFrame({"a": a, "b": b})


def near_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that span the same components as all links."""
    members = written(distinct.select("fp").mapInPandas(_replicate, "anchor long, fp long, near boolean"), "anchors")
    full = members.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)
    full = written(full.select("anchor", F.ceil(F.col("n") / (BLOCK // 2)).cast("int").alias("blocks")), "full-anchors")
    if full.limit(1).count():
        # each member meets every block: cell = (anchor, lower block, higher block)
        joined = members.join(full, "anchor", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        joined = joined.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cell = F.xxhash64("anchor", F.least("own", "other"), F.greatest("own", "other"))
        members = joined.select(F.when(F.col("blocks") == 1, F.xxhash64("anchor")).otherwise(cell).alias("cell"), "fp", "near")
    else:
        members = members.select(F.xxhash64("anchor").alias("cell"), "fp", "near")
    # cells that two anchors share by a collision are merely compared too
    cells = members.repartition("cell").sortWithinPartitions("cell", "fp")
    return cells.mapInPandas(_compare, "a long, b long").filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the component's least node.

    Alternates large-star and small-star steps until nothing changes, however many it takes.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "large-star")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = written(small.select("e.u", "e.v").filter("u <> v").distinct(), "small-star")
        mark = [F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))]
        if edges.agg(*mark).first() == new.agg(*mark).first():
            break
        edges = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def component_of(distinct: DataFrame) -> DataFrame:
    """(fp, root) of every distinct fingerprint."""
    of = components(near_links(distinct))
    return distinct.select("fp").join(of, distinct["fp"] == of["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, fingerprint and component_id, the least doc_id of its component."""
    prints = written(docs.select("doc_id", fingerprints(docs["text"]).alias("fp")), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    of = written(component_of(distinct), "fingerprint-roots")
    named = distinct.join(of, "fp")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    per_print = named.join(ids, "root").select("fp", "component_id")
    return prints.join(per_print, "fp").select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the least doc_id (nulls last), then the first row read."""
    held = docs.select(whole_row(docs))  # one struct: no name of docs can clash with ours
    held = held.withColumns({"_fp": fingerprints(F.col("_doc.text")), "_row": F.monotonically_increasing_id()})
    held = written(held, "fingerprinted")
    order = F.struct(F.col("_doc.doc_id").isNull().alias("n"), F.col("_doc.doc_id").alias("doc_id"), "_row")
    distinct = written(held.groupBy(F.col("_fp").alias("fp")).agg(F.min(order).alias("first")), "distinct-fingerprints")
    of = written(component_of(distinct), "fingerprint-roots")
    kept = distinct.join(of, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first._row").alias("_row"))
    return held.join(kept, "_row", "left_semi").select("_doc.*")
