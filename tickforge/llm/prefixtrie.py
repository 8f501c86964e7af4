"""The trie of conversations' prefixes, by range minima over sorted common-prefix lengths.

A conversation is a sequence of turns; each distinct sequence of its first d turns is a node
of depth d. Equal sequences collapse to their least conv_id with a count. The others are
sorted, neighbours' common-prefix lengths (LCPs) are taken, and a sparse table of their range
minima lets each candidate prefix search its left and its right extent by itself: from its
row, steps of falling powers of two go on while the least LCP they pass reaches the prefix's
depth. The two extents are the prefix's member interval; there is no stack and no order in
which prefixes must be met. Sums over an interval are differences of prefix sums, its least
conv_id is another range minimum.

Turns stand as 120 bits of a digest. A prefix's name is the XOR of 128 bits hashed from each
of its turns and places, so that names of long conversations come from those of their parts.
A conversation is cut into pieces of ``PIECE`` turns; a piece is sorted under the name of the
prefix before it, so that it joins the pieces of all conversations that share this prefix.

Sums over subtrees (leaves, tokens saved) need no walk: every node belongs to its least
member, so that a subtree's sum is the sum over its members of what they own, less what the
node's own least member owns above it. These are sums over member intervals again.

Scale: pieces are range partitioned by the whole sort key, so that a frequent first turn or a
conversation with a third of all turns spreads over tasks; a sorted run of at most ``BLOCK``
pieces and ``BLOCK_TURNS`` turns is searched at a time. A prefix that spans runs has a part
from each, added up in an aggregation. Of texts only digests and word counts are shuffled. A
node's list of ended conversations is hashed by one task, as SHA-256 is serial, which reads it
in sorted pieces of 256 ids and holds one batch of them.

Defined results: null roles and texts are empty; turns with equal numbers (nulls first) go by
their digests. Rows without a conv_id belong to no conversation. Repeated rows are turns
of their own. c % 20 keeps c's sign. Without conversations there are no nodes, the root
included. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.llm.common import WORD, written
from tickforge.operators.ordered import numbered

#: Turns of a conversation that are sorted as one piece.
PIECE = 64
BLOCK = 1 << 15
BLOCK_TURNS = 1 << 19
#: Pieces of one conversation whose running names one window computes.
SPAN = 4096
FAMILY, MOST_SHARED = 20, 4


def digested(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, a, b, words): 60 + 60 bits of each turn's digest."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    bits = lambda at: F.conv(F.substring("_d", at, 15), 16, 10).cast("long")
    held = rows.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), named.alias("_d"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return held.select("conv_id", "turn", bits(1).alias("a"), bits(16).alias("b"), "words")


def turns(rows: DataFrame) -> DataFrame:
    """(conv_id, at, a, b, words): turns by their place (from 0)."""
    return numbered(digested(rows), ["conv_id"], [F.asc_nulls_first("turn"), "a", "b"], "at").select("conv_id", "at", "a", "b", "words")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): each conversation with its first turns taken from its family's first one."""
    own = written(own, "turns")
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = convs.select("conv_id", "n", base.alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED).alias("h"))
    convs = written(convs, "conversations")
    lent = own.filter(F.col("at") < MOST_SHARED - 1).select(F.col("conv_id").alias("base"), "at", "a", "b", "words")
    head = convs.join(lent, "base").filter("at < h").select("conv_id", "at", "a", "b", "words")
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    shift = convs.join(sizes, "base", "left").select("conv_id", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("lent"))
    rest = own.join(shift, "conv_id").filter("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("lent")).alias("at"), "a", "b", "words")
    return head.unionByName(rest), convs.select("conv_id")


def _terms(at: Column) -> list[Column]:
    """128 bits of a turn at its place."""
    return [F.xxhash64("a", "b", at), F.xxhash64(at, "b", "a", F.lit(7))]


def pieces(sequences: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, j, n, p, q, terms, words): piece j of each conversation, under the name (p, q) of what lies before it.

    Each conversation ends in a piece that is not full, which may have no turns.
    """
    x, y = _terms(F.col("at"))
    rows = sequences.select("conv_id", F.floor(F.col("at") / PIECE).alias("j"), "at", x.alias("x"), y.alias("y"), "words")
    # a conversation's last turn also tells of the piece that follows a full one
    row = F.struct("at", "x", "y", "words")
    cut = rows.withColumn("_span", F.floor(F.col("j") / SPAN)).repartition("conv_id", "_span")
    cut = cut.groupBy("conv_id", "_span", "j").agg(F.array_sort(F.collect_list(row)).alias("turns"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    cut = written(cut, "pieces")
    inside = Window.partitionBy("conv_id", "_span").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    placed = cut.withColumns({"p": zero(F.bit_xor("x").over(inside)), "q": zero(F.bit_xor("y").over(inside))})
    spans = cut.groupBy("conv_id", "_span").agg(F.bit_xor("x").alias("sx"), F.bit_xor("y").alias("sy"))
    earlier = Window.partitionBy("conv_id").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("conv_id", "_span", zero(F.bit_xor("sx").over(earlier)).alias("sx"), zero(F.bit_xor("sy").over(earlier)).alias("sy"))
    placed = placed.join(spans, ["conv_id", "_span"]).withColumns({"p": F.col("p").bitwiseXOR(F.col("sx")), "q": F.col("q").bitwiseXOR(F.col("sy"))})
    flat = F.flatten(F.transform("turns", lambda t: F.array(t["x"], t["y"])))
    ready = placed.select("conv_id", "j", "p", "q", "x", "y", flat.alias("terms"), F.transform("turns", lambda t: t["words"]).alias("words"))
    none = F.array().cast("array<bigint>")
    full = ready.filter(F.size("words") == PIECE)
    after = full.select("conv_id", (F.col("j") + 1).alias("j"), F.col("p").bitwiseXOR(F.col("x")).alias("p"), F.col("q").bitwiseXOR(F.col("y")).alias("q"))
    after = after.join(ready.select("conv_id", "j"), ["conv_id", "j"], "left_anti")
    silent = convs.join(sequences.select("conv_id").distinct(), "conv_id", "left_anti").select("conv_id", F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"))
    ends = after.unionByName(silent).withColumns({"terms": none, "words": none, "x": F.lit(0).cast("long"), "y": F.lit(0).cast("long")})
    return written(ready.unionByName(ends), "all-pieces")


ENDS = "depth long, p long, q long, first long, n long, ids string"


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of equal (depth, p, q) in sorted rows as pieces of up to 256 ids."""
    for part in batches:
        key = part[["depth", "p", "q"]].to_numpy(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])) if len(key) else np.empty(0, np.int64)
        ids = part["conv_id"].tolist()
        out = []
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(ids)], strict=True):
            out += [(*key[a].tolist(), ids[k], min(256, b - k), ",".join(map(str, ids[k : min(b, k + 256)]))) for k in range(a, b, 256)]
        yield pd.DataFrame(out, columns=[x.split()[0] for x in ENDS.split(", ")])


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digest of each node's list, over its sorted pieces; the hash is carried from batch to batch."""
    key, digest, out = None, None, []
    names = ["depth", "p", "q", "ends_sha256"]
    for part in batches:
        for *now, ids in part[["depth", "p", "q", "ids"]].itertuples(index=False):
            if now != key:
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = now, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=names)
        out = []
    if key is not None:
        yield pd.DataFrame([(*key, digest.hexdigest())], columns=names)


def ended(cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct sequences with count and least conv_id; digests of the conversations that end at each)."""
    last = F.size("words") < PIECE
    whole = cut.filter(last).select("conv_id", (F.col("j") * PIECE + F.size("words")).alias("depth"), F.col("p").bitwiseXOR(F.col("x")).alias("p"), F.col("q").bitwiseXOR(F.col("y")).alias("q"))
    by = ["depth", "p", "q", "conv_id"]
    listed = written(whole.repartitionByRange(*by).sortWithinPartitions(*by).mapInPandas(_listed, ENDS), "ends")
    distinct = listed.groupBy("depth", "p", "q").agg(F.min("first").alias("conv_id"), F.sum("n").alias("m"))
    digests = listed.repartition("depth", "p", "q").sortWithinPartitions("depth", "p", "q", "first").mapInPandas(_hashed, "depth long, p long, q long, ends_sha256 string")
    return written(distinct, "distinct-sequences"), written(digests, "ends-digests")


def sparse_minima(values: np.ndarray) -> list[np.ndarray]:
    """Level k holds the minima of all runs of 2^k values."""
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        last, half = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.minimum(last[:-half], last[half:]))
    return levels


def extents(levels: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row of the run around each ``row`` whose neighbours share ``depth``; lcp[i] is of rows i - 1 and i."""
    n = len(levels[0])
    left, right = row.copy(), row.copy()
    for k in range(len(levels) - 1, -1, -1):
        step, level = 1 << k, levels[k]
        at = np.flatnonzero(right + step < n)  # rows right + 1 .. right + step
        right[at] += step * (level[right[at] + 1] >= depth[at])
        at = np.flatnonzero(left - step >= 0)  # rows left - step + 1 .. left
        left[at] -= step * (level[left[at] - step + 1] >= depth[at])
    return left, right


def least_in(levels: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    k = np.frexp(last - first + 1)[1] - 1
    out = np.empty(len(first), levels[0].dtype)
    for level in np.unique(k):
        at = np.flatnonzero(k == level)
        out[at] = np.minimum(levels[level][first[at]], levels[level][last[at] - (1 << level) + 1])
    return out


NODES = "depth long, p long, q long, up_p long, up_q long, conv_id long, words long"


def _searched(block: pd.DataFrame, weights: list[str]) -> pd.DataFrame:
    """The prefixes of a sorted run of pieces: name, parent's name, least conv_id, last turn's words, summed weights."""
    n = len(block)
    size = np.fromiter(map(len, block["words"]), np.int64, n)
    start = np.concatenate([[0], np.cumsum(size)])
    flat = lambda c, k: np.concatenate([np.asarray(x, np.int64) for x in block[c]] or [np.empty(0, np.int64)]).reshape(-1, k)
    term, words = flat("terms", 2), flat("words", 1)[:, 0]
    j, p, q, conv = (block[c].to_numpy(np.int64) for c in ("j", "p", "q", "conv_id"))
    together = np.concatenate([[False], (j[1:] == j[:-1]) & (p[1:] == p[:-1]) & (q[1:] == q[:-1])])
    lcp = np.full(n, -1, np.int64)
    at = np.flatnonzero(together)
    lcp[at] = 0
    while len(at):  # one turn further where the ones before agree
        d = lcp[at]
        at = at[(d < size[at]) & (d < size[at - 1])]
        at = at[(term[start[at] + lcp[at]] == term[start[at - 1] + lcp[at]]).all(axis=1)]
        lcp[at] += 1
    # names of all prefixes: XOR along each piece
    owner = np.repeat(np.arange(n), size)
    run = np.zeros((len(term) + 1, 2), np.int64)
    np.bitwise_xor.accumulate(term, axis=0, out=run[1:])
    name = run[1:] ^ run[start[owner]] ^ np.stack([p, q], 1)[owner]
    # candidates: each piece's prefixes that the piece before it doesn't share; the empty one only as the root
    low = np.where(j == 0, lcp + 1, np.maximum(lcp + 1, 1))
    count = np.maximum(size - low + 1, 0)
    row = np.repeat(np.arange(n), count)
    depth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + low[row]
    levels = sparse_minima(lcp)
    first, last = extents(levels, row, depth)
    pq = np.stack([p, q], 1)
    place = start[row] + depth - 1
    own = np.where((depth > 0)[:, None], name[np.where(depth > 0, place, 0)] if len(name) else pq[row], pq[row])
    up = np.where((depth > 1)[:, None], name[np.where(depth > 1, place - 1, 0)] if len(name) else pq[row], pq[row])
    out = {"depth": depth + j[row] * PIECE, "p": own[:, 0], "q": own[:, 1], "up_p": up[:, 0], "up_q": up[:, 1]}
    out["conv_id"] = least_in(sparse_minima(conv), first, last)
    out["words"] = np.where(depth > 0, words[np.where(depth > 0, place, 0)] if len(words) else 0, 0)
    for w in weights:
        total = np.concatenate([[0], np.cumsum(block[w].to_numpy(np.int64))])
        out[w] = total[last + 1] - total[first]
    return pd.DataFrame(out)


def _search(batches: Iterator[pd.DataFrame], weights: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted pieces, run by run."""
    held, count, turns_held = [], 0, 0
    for part in batches:
        sizes = part["words"].map(len).to_numpy(np.int64)
        ends, a = np.cumsum(sizes), 0
        while a < len(part):
            room = (ends[a - 1] if a else 0) + BLOCK_TURNS - turns_held
            b = min(len(part), a + BLOCK - count, max(a + 1, int(np.searchsorted(ends, room, "right"))))
            held.append(part.iloc[a:b])
            count, turns_held = count + b - a, turns_held + int(sizes[a:b].sum())
            a = b
            if count >= BLOCK or turns_held >= BLOCK_TURNS:
                yield _searched(pd.concat(held, ignore_index=True), weights)
                held, count, turns_held = [], 0, 0
    if held:
        yield _searched(pd.concat(held, ignore_index=True), weights)


def intervals(cut: DataFrame, weights: list[str]) -> DataFrame:
    """Every prefix with the sums of its members' weights."""
    by = ["j", "p", "q", "terms"]
    ranged = cut.repartitionByRange(*by, "conv_id").sortWithinPartitions(*by, "conv_id")
    search = _search
    found = ranged.mapInPandas(lambda batches: search(batches, weights), NODES + "".join(f", {w} long" for w in weights))
    same = [F.min(c).alias(c) for c in ("up_p", "up_q", "conv_id", "words")]
    return found.groupBy("depth", "p", "q").agg(*same, *[F.sum(w).alias(w) for w in weights])


def trie(sequences: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the trie of ``sequences`` (conv_id, at, a, b, words) of all ``convs`` (conv_id)."""
    cut = pieces(sequences, convs)
    distinct, digests = ended(cut)
    cut = written(cut.drop("x", "y").join(distinct.select("conv_id", "m"), "conv_id"), "distinct-pieces")
    nodes = written(intervals(cut, ["m"]).withColumn("value", F.when(F.col("depth") > 0, (F.col("m") - 1) * F.col("words")).otherwise(0)), "nodes")
    up = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_p").alias("p"), F.col("up_q").alias("q")).agg(F.count("*").alias("n_children"))
    key = ["depth", "p", "q"]
    nodes = written(nodes.join(up, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes-children")
    # what each conversation owns: leaves and values, whole and above a depth
    owned = nodes.groupBy("conv_id").agg(F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("n_leaves"), F.sum("value").alias("saved"))
    weighed = cut.drop("m").join(owned, "conv_id", "left").fillna(0, ["n_leaves", "saved"])
    sums = intervals(weighed, ["n_leaves", "saved"]).select(*key, "n_leaves", "saved")
    span = nodes.withColumn("_span", F.floor(F.col("depth") / SPAN))
    earlier = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    none = lambda c: F.coalesce(c, F.lit(0))
    spans = span.groupBy("conv_id", "_span").agg(F.sum("value").alias("_value"))
    spans = spans.select("conv_id", "_span", none(F.sum("_value").over(earlier(["conv_id"], "_span"))).alias("_before"))
    above = span.withColumn("_above", none(F.sum("value").over(earlier(["conv_id", "_span"], "depth")))).join(spans, ["conv_id", "_span"])
    above = above.withColumn("_above", F.col("_above") + F.col("_before"))
    full = above.join(sums, key).join(digests, key, "left")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p").alias("up_p"), F.col("q").alias("up_q"), F.col("conv_id").alias("parent_conv_id"))
    full = full.join(parents, ["depth", "up_p", "up_q"], "left")
    return full.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"),
        F.col("m").alias("n_convs"),
        "n_children",
        F.col("n_leaves").cast("long").alias("n_leaves"),
        (F.col("saved") - F.col("_above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(rows: DataFrame) -> DataFrame:
    """The trie of ``rows`` (conv_id, turn, role, text) as they are."""
    own = written(turns(rows), "turns")
    return trie(own, own.select("conv_id").distinct())


def rebuilt_trie(rows: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations."""
    return trie(*rebuilt(turns(rows)))
