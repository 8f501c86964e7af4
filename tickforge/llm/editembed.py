"""Document fingerprints by a randomised embedding of edit distance into Hamming distance.

A walk shared by all texts reads a text character by character: at step j it stays at the
current character c or goes on to the next, as a random bit shared for (j, c) says. The
embedded text has at step j what stands where the walk is. After an edit the walks of two
texts meet again, so that texts at a small edit distance have embeddings at a small Hamming
distance. The number of steps until the walk leaves a character is a lookup in a table that
repeats after ``PERIOD`` steps and knows ``CLASSES`` classes of characters.

A fingerprint samples the embedding: a hexadecimal digit hashed from the ``GRAM`` characters
that begin at a sampled step, or "." where the text has ended, after two digits for the class
of the text's length (a quarter of an octave). Walks that an edit parts meet again soon with
constant probability only, so that there are ``WALKS`` of them. Steps are sampled by a fixed priority below a
threshold that falls with the class, so that the samples of a longer class are among those of a
shorter one, and texts of different lengths can be compared. Likeness is the share of equal
digits, less what chance gives, among the common steps at which not both texts have ended, by the
walk that gives most.

Near-duplicates: two fingerprints link if their likeness is ``ALIKE`` or more, and classes are the components of
all such links. No link is lost. Linked fingerprints have at least some number of digits in common by one of the walks;
places are dealt to so few groups that such digits leave three or four of them to one group. So they agree in all
places of one of the keys, which are all threes (or fours) of places of a group; only pairs that share a key are looked at.
Where that isn't less work (small blocks, keys that most rows share), all pairs are: bits that differ are a lower bound of
the digits that differ and leave few pairs, which all digits decide.

Fingerprints are cut into blocks of one length class and of like lengths, stored as arrays. A task takes pairs of blocks
whose numbers of digits before the end allow a link; it holds two blocks. The work by keys grows with the blocks'
rows and a small share of their pairs.

Scale: texts are compressed and range partitioned by doc_id, once; all that a document needs from its successor
is at hand while a partition is read in order. Where a partition ends, only the last document and
the next partition's first one are joined, a row each a partition. Equal fingerprints collapse
before blocks are made, which are shuffled once and read by the tasks that compare them; a task
sends on a star for each component of its own links, not the pairs.

Defined results: null texts are empty. Documents without a doc_id come last; equal doc_ids go by
a hash of their texts. A single document is its own successor. Two empty texts have likeness 1, an
empty and another one 0. Repeated rows are documents of their own. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Generator, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tickforge.llm import store
from tickforge.llm.common import shared_path, written
from tickforge.llm.simhash import _roots, components

SEED = 42
PERIOD, CLASSES = 4096, 256
#: Walks, sampled steps of each on average, and characters that a digit is hashed from.
WALKS, SAMPLES, GRAM = 2, 160, 4
#: Fingerprints in a block that is compared with others, of both sides in a tile where all pairs are looked at, and tasks at most.
COMPARED, TILE, WIDE, TASKS = 1 << 16, 64, 2048, 20_000
#: Pairs of rows that are worth a task.
WORK = 1 << 26
#: Places of a key, keys by which components are begun, and pairs of one key that are looked at together.
KEYS, CHAINS, EXPANDED = (3, 4), 16, 1 << 16
#: Pairs that are decided at once, by all digits.
DECIDED = 1 << 12
#: What a key, a value it can have, a row and a pair of one key cost; a look at a pair among all is 1.
KEY_COST, BUCKET_COST, ROW_COST, PAIR_COST = 10_000, 1, 3, 4
#: Shares of rows, one of which may be left out as short.
SHORT = (0.0, 0.02, 0.1, 0.25)
#: Walks that are still worth advancing together, and cells of their table.
TOGETHER, CELLS = 48, 1 << 23
#: Documents, and characters but for the last, that are embedded together.
BLOCK, BLOCK_CHARS = 512, 1 << 21
#: Fingerprints with a class that isn't their own document's, of some 400 bytes, up to which they are broadcast.
BROADCAST = 100_000
ALIKE = 0.6
_ENDED = 16
Links = Iterator[tuple[np.ndarray, np.ndarray]]


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(SEED)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@lru_cache(1)
def gaps() -> np.ndarray:
    """By walk, class and step (modulo PERIOD), flat: steps until the walk has left a character it stands at."""
    out = np.ones((WALKS * CLASSES, PERIOD), np.uint8)
    at = np.concatenate([np.arange(CLASSES * PERIOD) + (w << 32) for w in range(WALKS)])
    bits = (mixed(at) >> np.uint64(63)).astype(bool).reshape(-1, PERIOD)
    bits[:, -1] = True  # it always goes on somewhere
    for j in range(PERIOD - 2, -1, -1):
        out[:, j] = np.where(bits[:, j], 1, np.minimum(out[:, j + 1].astype(np.int64) + 1, 255))
    return out.ravel()


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def walks(texts: list[np.ndarray], numbers: list[int], starts: list[int]) -> list[np.ndarray]:
    """The steps at which walks come to each character of their texts, and the one at which they leave the last.

    All walks advance together, a character at a time, as long as ``TOGETHER`` of them go on; the few longest
    texts are finished one by one.
    """
    table, last = gaps(), PERIOD - 1
    row = [(((c.astype(np.uint64) * np.uint64(0x9E3779B1)) >> np.uint64(16)).astype(np.uint8).astype(np.int32) + w * CLASSES) * PERIOD for c, w in zip(texts, numbers, strict=True)]
    size = np.array([*map(len, texts)], np.int64)
    order = np.argsort(-size, kind="stable")
    size = size[order]
    n = len(texts)
    shared = int(min(size[min(n, TOGETHER) - 1] if n >= TOGETHER else 0, CELLS // max(n, 1)))
    lookup = np.zeros((n, shared), np.int32)
    for k, i in enumerate(order.tolist()):
        lookup[k, : min(shared, size[k])] = row[i][:shared]
    lookup = np.ascontiguousarray(lookup.T)
    at = np.empty((shared, n), np.int64)
    now = np.array([starts[i] for i in order.tolist()], np.int64)
    active = n - np.searchsorted(size[::-1], np.arange(shared), "right")
    for t, a in enumerate(active.tolist()):
        here = now[:a]
        at[t, :a] = here
        here += table[lookup[t, :a] + (here & last)]
    at = np.ascontiguousarray(at.T)
    out: list[np.ndarray] = [at[:0]] * n
    plain = None
    for k, i in enumerate(order.tolist()):
        j, rest = int(now[k]), row[i][shared:]
        if not len(rest):
            out[i] = np.append(at[k, : size[k]], j)
            continue
        plain = plain or table.tobytes()
        found = []
        add = found.append
        for c in rest.tolist():
            add(j)
            j += plain[c + (j & last)]
        add(j)
        out[i] = np.concatenate([at[k], np.array(found, np.int64)])
    return out


def length_class(n: int) -> int:
    """The least k with 2^(k/4) >= n."""
    k = 0
    while _reach(k)[0] < n:
        k += 1
    return k


@lru_cache(512)
def _reach(k: int) -> tuple[int, int]:
    """(longest text of class k, steps its walk takes at most but for chance)."""
    n = int(2 ** (k / 4) + 1e-9)
    return n, int(2.2 * n) + 32


@lru_cache(512)
def sampled(k: int) -> np.ndarray:
    """The sampled steps of class k."""
    steps = _reach(k)[1]
    limit = np.uint64(min(1.0, SAMPLES / steps) * float(2**64 - 2048))
    found = [np.arange(a, min(a + (1 << 20), steps)) for a in range(0, steps, 1 << 20)]
    return np.concatenate([x[mixed(x + (1 << 40)) <= limit] for x in found])


@lru_cache(4096)
def common(k: int, other: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the fingerprints of classes k <= other of the steps that both sample; -1 where k has ended for certain."""
    mine, theirs = sampled(k), sampled(other)
    at = np.searchsorted(mine, theirs)
    found = (at < len(mine)) & (mine[np.minimum(at, len(mine) - 1)] == theirs)
    return np.where(found, at, -1), np.arange(len(theirs))


def prints_of(texts: list[np.ndarray], walked: list[np.ndarray]) -> list[str]:
    """The fingerprints of texts; ``walked`` has ``WALKS`` walks of each, one text after the other."""
    classes = [length_class(len(c)) for c in texts]
    steps = [sampled(k) for k in classes for _ in range(WALKS)]
    owner = [c for c in texts for _ in range(WALKS)]
    place = np.concatenate([np.searchsorted(at, s, "right") - 1 for at, s in zip(walked, steps, strict=True)])
    count = np.array([*map(len, steps)])
    length = np.repeat([*map(len, owner)], count)
    first = np.repeat(np.cumsum([0, *map(len, texts)])[:-1].repeat(WALKS), count)
    every = np.concatenate([*texts, np.zeros(1, np.uint32)]).astype(np.uint64)
    value = np.zeros(len(place), np.uint64)
    for g in range(GRAM):
        i = place + g
        value = mixed(value ^ np.where(i < length, every[first + np.minimum(i, np.maximum(length - 1, 0))] + np.uint64(1), np.uint64(0)))
    digit = np.where(place < length, value >> np.uint64(60), np.uint64(_ENDED)).astype(np.int64)
    said = np.frombuffer(b"0123456789abcdef.", np.uint8)[digit].tobytes().decode()
    each = count.reshape(-1, WALKS).sum(axis=1)
    stop = np.cumsum(each).tolist()
    return [f"{k:02x}{said[b - n : b]}" for k, n, b in zip(classes, each.tolist(), stop, strict=True)]


def _digits(print_: str, k: int) -> np.ndarray:
    """A row of digits a walk."""
    return np.frombuffer(print_.encode(), np.uint8)[2:].reshape(WALKS, len(sampled(k)))


def likeness(x: str, y: str) -> float:
    """How alike two fingerprints are, from 0 to 1: by the walk that finds them the most alike."""
    if x == y:
        return 1.0
    k, other = int(x[:2], 16), int(y[:2], 16)
    if k > other:
        x, y, k, other = y, x, other, k
    at, there = common(k, other)
    dot, best = ord("."), 0.0
    for mine, theirs in zip(_digits(x, k), _digits(y, other), strict=True):
        a, b = np.where(at >= 0, mine[at], dot), theirs[there]
        counted = (a != dot) | (b != dot)
        if counted.any():
            best = max(best, ((a == b)[counted].mean() - 1 / 16) * 16 / 15)
    return float(best)


def text_fingerprint(text: str | None) -> str:
    codes = codes_of(text or "")
    return prints_of([codes], walks([codes] * WALKS, [*range(WALKS)], [0] * WALKS))[0]


PRINTS = "part int, edge string, doc_id long, text string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in PRINTS.split(", ")]


def _rows(texts: list[str], following: list[str]) -> list[tuple]:
    """(n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of texts and those that follow them."""
    codes, after = [*map(codes_of, texts)], [*map(codes_of, following)]
    numbers = [*range(WALKS)]
    # a block's successors are its own texts but for the last
    many = codes if all(x is y for x, y in zip(texts[1:], following)) else codes + after[:-1]
    many = [*many, after[-1]]
    walked = walks([c for c in many for _ in numbers], numbers * len(many), [0] * (WALKS * len(many)))
    prints = prints_of(many, walked)
    mine, theirs = prints[: len(texts)], prints[-len(texts) :]
    kept = [len(c) - len(c) // 2 for c in codes]
    tail = [a[: len(c) // 2] for c, a in zip(codes, after, strict=True)]
    start = [int(walked[WALKS * k + w][n]) for k, n in enumerate(kept) for w in numbers]
    more = walks([c for c in tail for _ in numbers], numbers * len(tail), start)  # walks are the same up to the edit
    more = [np.concatenate([walked[i][: kept[i // WALKS]], x]) for i, x in enumerate(more)]
    changed = prints_of([np.concatenate([c[:n], t]) for c, n, t in zip(codes, kept, tail, strict=True)], more)
    out = []
    for text, then, x, y, z in zip(texts, following, mine, changed, theirs, strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + then[:half]
        out.append((len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), x, y, likeness(x, y), likeness(x, z)))
    return out


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts compressed one by one, for the shuffle."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch["doc_id"], "tie": batch["tie"], "packed": [pack(x.encode("utf-8", "surrogatepass")) for x in batch["text"]]})


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents by ascending doc_id with their successors; the texts of a partition's first and last are left for the join."""
    part = TaskContext.get().partitionId()
    ids: list = []
    texts: list[str] = []
    chars, began = 0, False

    def done() -> pd.DataFrame:
        return _frame([(part, None, i, None, *x) for i, x in zip(ids, _rows(texts[:-1], texts[1:]), strict=False)])

    opened = zstandard.ZstdDecompressor()
    for batch in batches:
        for doc_id, packed in zip([None if pd.isna(x) else int(x) for x in batch["doc_id"].array], batch["packed"], strict=True):
            text = opened.decompress(packed).decode("utf-8", "surrogatepass")
            if not began:
                began = True
                yield _frame([(part, "first", doc_id, text, *[None] * 6)])
            ids.append(doc_id)
            texts.append(text)
            chars += len(text)
            if len(texts) > 1 and (len(texts) > BLOCK or chars > BLOCK_CHARS):
                yield done()
                ids, texts = ids[-1:], texts[-1:]
                chars = len(texts[0])
    if len(texts) > 1:
        yield done()
    if began:
        yield _frame([(part, "last", ids[-1], texts[-1], *[None] * 6)])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_NAMES)
    return out.astype({"doc_id": "Int64", "n_chars": "Int64"})


def _at_edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for doc_id, text, then in zip(batch["doc_id"].array, batch["text"], batch["next_text"], strict=True):
            yield _frame([(0, None, None if pd.isna(doc_id) else int(doc_id), None, *_rows([text], [then])[0])])


def prints(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, its and its edited text's fingerprints, the edited text's digest, two likenesses."""
    spark = docs.sparkSession
    by = [F.asc_nulls_last("doc_id"), "tie"]
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    packed = plain.withColumn("tie", F.xxhash64("text")).mapInPandas(_packed, "doc_id long, tie long, packed binary")
    made = written(packed.repartitionByRange(*by).sortWithinPartitions(*by).mapInPandas(_in_order, PRINTS), "edit-prints", "zstd")
    parts = [r[0] for r in made.filter("edge = 'first'").select("part").orderBy("part").collect()]  # a number a partition
    following = spark.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]], strict=True)), "part int, next int")
    first = made.filter("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("next_text"))
    edges = made.filter("edge = 'last'").join(following, "part").join(first, "next").select("doc_id", "text", "next_text").mapInPandas(_at_edges, PRINTS)
    return made.filter("edge IS NULL").unionByName(written(edges, "edit-prints-at-edges")).select(*[n for n in _NAMES if n not in ("part", "edge", "text")])


class _Block:
    """Fingerprints of a class as digits at the steps of another one: a row a fingerprint, and bits of the digits by walk and word of 64 places."""

    def __init__(self, ids: np.ndarray, digits: np.ndarray, at: np.ndarray):
        self.ids, self.places = ids, len(at)
        self.said = np.full((len(ids), WALKS, len(at)), _ENDED, np.uint8)
        self.said[:, :, at >= 0] = digits[:, :, at[at >= 0]]
        self.length = (self.said != _ENDED).sum(axis=2)
        words = -(-len(at) // 64)
        bits = np.packbits(self.said & 1, axis=2, bitorder="little")
        bits = np.pad(bits, ((0, 0), (0, 0), (0, 8 * words - bits.shape[2])))
        self.bits = np.ascontiguousarray(np.ascontiguousarray(bits).view(np.uint64).transpose(1, 2, 0))


def _decided(x: _Block, y: _Block, w: int, i: np.ndarray, j: np.ndarray, alike: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs whose likeness by walk ``w`` is ``alike`` or more."""
    near = np.zeros(len(i), bool)
    for lo in range(0, len(i), DECIDED):
        at = slice(lo, lo + DECIDED)
        a, b = x.said[i[at], w], y.said[j[at], w]
        equal = a == b
        ended = (equal & (a == _ENDED)).sum(axis=1)
        counted = x.places - ended
        near[at] = ((equal.sum(axis=1) - ended) / np.maximum(counted, 1) - 1 / 16) * 16 / 15 >= alike
        near[at] &= counted > 0
    return i[near], j[near]


def _most(x: _Block, w: int, alike: float) -> np.ndarray:
    """Digits that may differ, by row, if it has the longer text."""
    return np.floor(x.length[:, w] * (1 - alike) * 15 / 16 + 1e-6).astype(np.uint8 if x.places < 256 else np.uint16)


def _met_all(x: _Block, y: _Block, w: int, alike: float, some: list[np.ndarray] | None = None) -> Links:
    """Links by walk ``w``, found by a look at all pairs, or at those of some rows of both."""
    rows = some or [np.arange(len(b.ids)) for b in (x, y)]
    most = [_most(b, w, alike)[r] for b, r in zip((x, y), rows, strict=True)]
    mine, theirs = x.bits[w][:, rows[0]], y.bits[w][:, rows[1]]
    for lo in range(0, len(rows[0]), TILE):
        up = slice(lo, lo + TILE)
        for start in range(lo // WIDE * WIDE if x is y else 0, len(rows[1]), WIDE):
            across = slice(start, start + WIDE)
            differ = np.zeros((len(rows[0][up]), len(rows[1][across])), most[0].dtype)
            for a, b in zip(mine, theirs, strict=True):
                differ += np.bitwise_count(a[up, None] ^ b[across])
            i, j = np.nonzero(differ <= np.maximum(most[0][up, None], most[1][across]))
            yield _decided(x, y, w, rows[0][i + lo], rows[1][j + start], alike)


def _keys(places: int, need: int, size: int) -> list[tuple[int, ...]]:
    """Sets of ``size`` places, one of which any ``need`` of the places hold: as many groups of places as leave ``size`` of them to one."""
    groups = (need - 1) // (size - 1)
    return [c for g in range(groups) for c in combinations(range(g, places, groups), size)]


def _number_of_keys(places: int, need: int, size: int) -> int:
    groups = (need - 1) // (size - 1)
    return places % groups * math.comb(places // groups + 1, size) + (groups - places % groups) * math.comb(places // groups, size)


def _best_keys(x: _Block, y: _Block, w: int, alike: float, pairs: int) -> tuple[int, int, int] | None:
    """(length, digits, size): of rows one of which is that long, linked ones have so many digits in common, and keys of that size are the least work.

    None if a look at all pairs is. Pairs of two shorter rows need such a look.
    """
    lengths = [np.sort(b.length[:, w]) for b in (x, y)]
    places = min(int(n[-1]) for n in lengths)
    best, least = None, float(pairs)
    for q in SHORT:
        long = max(int(n[int(q * len(n))]) for n in lengths)
        need = math.ceil(long * (1 / 16 + alike * 15 / 16) - 1e-6)
        short = math.prod(int(np.searchsorted(n, long)) for n in lengths)
        for size in KEYS:
            if need < size:
                continue
            work = _number_of_keys(places, need, size) * (KEY_COST + BUCKET_COST * 16**size + ROW_COST * (len(x.ids) + len(y.ids)) + PAIR_COST * pairs / 16**size) + short
            if work < least:
                best, least = (long, need, size), work
    return best


class _Side:
    """Rows of a block by a walk: their lengths, how many digits may differ, bits and digits by place."""

    def __init__(self, block: _Block, w: int, rows: np.ndarray, alike: float):
        self.rows, self.length = rows, block.length[rows, w]
        self.most, self.bits = _most(block, w, alike)[rows], block.bits[w][:, rows]
        self.said = np.ascontiguousarray(block.said[rows, w].T).astype(np.uint16)
        self.least = int(self.length.min(initial=block.places))

    def keyed(self, at: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(rows that haven't ended there, keys of 4 bits a place)."""
        key = self.said[at[0]]
        for p in at[1:]:
            key = key << 4 | self.said[p]
        if at[-1] < self.least:
            return np.arange(len(key)), key
        rows = np.flatnonzero(self.length > at[-1])
        return rows, key[rows]


def _met_by_keys(x: _Block, y: _Block, w: int, alike: float) -> Generator[tuple[np.ndarray, np.ndarray], None, bool]:
    """Links by walk ``w`` that span the same components as all; whether it went to the end, which it does if that is less work than a look at all pairs.

    Linked rows have some number of digits in common, so that they agree in all places of one of the ``_keys``.
    First each row is compared with one other of its key only: rows of a component that this finds needn't be compared again.
    """
    same, pairs = x is y, len(x.ids) * len(y.ids) // (1 + (x is y))
    best = _best_keys(x, y, w, alike, pairs)
    if best is None:
        return False
    long, need, size = best
    keys = _keys(min(int(b.length[:, w].max()) for b in (x, y)), need, size)
    yield from _met_all(x, y, w, alike, [np.flatnonzero(b.length[:, w] < long) for b in (x, y)])
    if not keys:
        return True  # no others can be alike
    chosen = [np.flatnonzero(b.length[:, w] >= need) for b in (x, y)]
    left = _Side(x, w, chosen[0], alike)
    right = left if same else _Side(y, w, chosen[1], alike)
    n = len(left.rows)

    def alike_of(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        differ = np.zeros(len(i), left.most.dtype)
        for p, q in zip(left.bits, right.bits, strict=True):
            differ += np.bitwise_count(p[i] ^ q[j])
        at = np.flatnonzero(differ <= np.maximum(left.most[i], right.most[j]))
        return _decided(x, y, w, left.rows[i[at]], right.rows[j[at]], alike)

    # one other of its key: the next one, or back and forth between the sides
    label = np.arange(n if same else n + len(right.rows))
    for at in keys[:: -(-len(keys) // CHAINS)]:
        rows, key = left.keyed(at)
        by = np.argsort(key, kind="stable")
        rows, key = rows[by], key[by]
        if same:
            t = np.flatnonzero(key[1:] == key[:-1])
            i, j = rows[t], rows[t + 1]
        else:
            others, other = right.keyed(at)
            by = np.argsort(other, kind="stable")
            others, other = others[by], other[by]
            start, stop = (np.searchsorted(other, key, s) for s in ("left", "right"))
            place = np.arange(len(key)) - np.searchsorted(key, key)
            t = np.flatnonzero(stop > start)
            i = np.concatenate([rows[t], rows[t]])
            j = np.concatenate([np.minimum(start + place, stop - 1)[t], np.minimum(start + np.maximum(place - 1, 0), stop - 1)[t]])
            j = others[j]
        apart = label[i] != label[j + (0 if same else n)]
        a, b = alike_of(i[apart], j[apart])
        yield a, b
        at_left, at_right = np.searchsorted(left.rows, a), np.searchsorted(right.rows, b) + (0 if same else n)
        label = _labels(label, at_left, at_right)

    # rows of a component side by side, so that the others of a key are one or two stretches
    by = np.argsort(label[:n], kind="stable")
    left = _Side(x, w, left.rows[by], alike)
    mine = theirs = label[:n][by]
    if not same:
        by = np.argsort(label[n:], kind="stable")
        theirs = label[n:][by]
    right = left if same else _Side(y, w, right.rows[by], alike)
    low, high = (np.searchsorted(theirs, mine, s) for s in ("left", "right"))
    known = high - low > same
    seen = 0
    for at in keys:
        rows, key = right.keyed(at)
        by = np.argsort(key, kind="stable")
        held = np.bincount(key, minlength=16**size)
        stop = np.cumsum(held)
        start = stop - held
        others = rows[by]
        if not same:
            rows, key = left.keyed(at)
        first, last = start[key], stop[key]
        if same:  # only rows after the own component
            first[by] = np.arange(1, len(by) + 1)
        t = np.flatnonzero(known[rows])
        if len(t):
            place = (key[by].astype(np.int64) if same else np.repeat(np.arange(len(held)), held)) << 32 | others
            base = key[t].astype(np.int64) << 32
            before, after = np.searchsorted(place, base | low[rows[t]]), np.searchsorted(place, base | high[rows[t]])
            if same:
                first[t] = after
            else:
                rows = np.concatenate([rows, rows[t]])
                first, last = np.concatenate([first, after]), np.concatenate([last, last[t]])
                last[t] = before
        many = last - first
        seen += PAIR_COST * int(many.sum())
        if seen > pairs:
            return False
        t = np.flatnonzero(many)
        rows, first, upto = rows[t], first[t], np.cumsum(many[t])
        lo = 0
        while lo < len(t):
            done = upto[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(upto, done + EXPANDED, "right")))
            each = np.diff(upto[lo:hi], prepend=done)
            j = np.arange(upto[hi - 1] - done) + np.repeat(first[lo:hi] - upto[lo:hi] + done + each, each)
            yield alike_of(np.repeat(rows[lo:hi], each), others[j])
            lo = hi
    return True


def _labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Components after more links: each row's label is the least row of its component."""
    node, root = _roots(label[a], label[b])
    new = np.arange(len(label))
    new[node] = root
    return new[label]


def _near(x: _Block, y: _Block, alike: float) -> Links:
    """Places (in x, in y) of pairs whose ``likeness`` is ``alike`` or more, by the walks that say so; they span the same components as all such pairs."""
    for w in range(WALKS):
        if not (yield from _met_by_keys(x, y, w, alike)):
            yield from _met_all(x, y, w, alike)


BLOCKS = "k int, name string, low array<int>, high array<int>, n int"


def _block_in(folder: str) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Stores a block; its name is of the attempt. Per walk, the fewest and the most digits before the end."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        k, name = int(key[0], 16), uuid.uuid4().hex
        said = np.frombuffer("".join([x[2:] for x in part["fingerprint"]]).encode(), np.uint8)
        digits = np.where(said == ord("."), _ENDED, np.where(said >= ord("a"), said - 87, said - 48)).astype(np.uint8)
        store.put_all(folder, name, part["id"].to_numpy(np.int64), digits)
        length = (digits.reshape(len(part), WALKS, -1) != _ENDED).sum(axis=2)
        return pd.DataFrame({"k": [k], "name": [name], "low": [length.min(axis=0).tolist()], "high": [length.max(axis=0).tolist()], "n": [len(part)]})

    return run


def _read_block(folder: str, k: int, name: str, at: np.ndarray) -> _Block:
    ids, digits = store.get_all(folder, name)
    return _Block(np.asarray(ids), np.asarray(digits).reshape(len(ids), WALKS, len(sampled(k))), at)


def _may_link(mine: tuple, theirs: tuple, at: np.ndarray, alike: float) -> bool:
    """Whether blocks' lengths leave a pair of them alike: all digits of the shorter one equal."""
    upto = np.append(0, np.cumsum(np.bincount(at[at >= 0], minlength=1)))
    for low, high, low2, high2 in zip(mine[2], mine[3], theirs[2], theirs[3], strict=True):
        low, high = (int(upto[min(n, len(upto) - 1)]) for n in (low, high))
        least, most = max(low, low2), min(high, high2)  # the nearest that a longer and a shorter one can be
        if most >= least or most >= least * (1 / 16 + alike * 15 / 16) - 1e-6:
            return True
    return False


def likeness_of(x: str, y: str) -> Column:
    """``likeness`` of two columns."""

    @pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([likeness(a, b) for a, b in zip(x, y, strict=True)], dtype=float)

    return run(x, y)


def _dealt(blocks: list[tuple], alike: float) -> list[list[tuple[int, int]]]:
    """Pairs of blocks that may link, by task: as many as have ``WORK`` pairs of rows, or one."""
    tasks, work = [], WORK
    for n, mine in enumerate(blocks):
        for m, theirs in enumerate(blocks[n:], n):
            if not _may_link(mine, theirs, common(mine[0], theirs[0])[0], alike):
                continue
            if work >= WORK:
                tasks.append([])
                work = 0
            tasks[-1].append((n, m))
            work += mine[4] * theirs[4]
    return tasks


def near_links(distinct: DataFrame, alike: float = ALIKE) -> DataFrame:
    """Links (a, b) between distinct fingerprints (id, fingerprint) that span the same components as all pairs whose likeness is ``alike``."""
    spark = distinct.sparkSession
    folder = shared_path(spark, "edit-blocks")
    held = distinct.select("id", "fingerprint", F.substring("fingerprint", 1, 2).alias("_k"), F.length(F.translate("fingerprint", ".", "")).alias("_l"))
    # blocks of like lengths: digits before the end, of which a row a class and number is held
    shorter = Window.partitionBy("_k").orderBy("_l").rowsBetween(Window.unboundedPreceding, -1)
    sizes = held.groupBy("_k", "_l").agg(F.count("*").alias("_n")).withColumn("_from", F.coalesce(F.sum("_n").over(shorter), F.lit(0)))
    block = F.floor((F.col("_from") + F.pmod(F.xxhash64("id"), F.col("_n"))) / COMPARED).alias("_b")
    dealt = held.join(F.broadcast(sizes), ["_k", "_l"]).select("id", "fingerprint", "_k", block)
    made = written(dealt.groupBy("_k", "_b").applyInPandas(_block_in(folder), BLOCKS), "edit-block-names")
    blocks = [tuple(r) for r in made.orderBy("k", "low", "name").collect()]  # a row a block
    tasks = _dealt(blocks, alike)
    if not tasks:
        return spark.createDataFrame([], "a long, b long")

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine, of = None, None
        for batch in batches:
            a, b, many = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
            for n, m in [pair for k in batch["id"].tolist() for pair in tasks[k]]:
                (k, name), (other, theirs_name) = blocks[n][:2], blocks[m][:2]
                at, there = common(k, other)
                if of != (n, other):
                    mine, of = _read_block(folder, k, name, at), (n, other)
                theirs = mine if m == n else _read_block(folder, other, theirs_name, there)
                for i, j in _near(mine, theirs, alike):
                    apart = mine.ids[i] != theirs.ids[j]
                    a.append(mine.ids[i[apart]])
                    b.append(theirs.ids[j[apart]])
                    many += len(i)
                    if many > 1 << 20:
                        x, y = _roots(np.concatenate(a), np.concatenate(b))
                        a, b, many = [x], [y], 0
            x, y = _roots(np.concatenate(a), np.concatenate(b))
            yield pd.DataFrame({"a": x, "b": y})

    return spark.range(0, len(tasks), 1, min(len(tasks), TASKS)).mapInPandas(compared, "a long, b long")


def near_duplicates(printed: DataFrame, alike: float = ALIKE) -> DataFrame:
    """``printed`` (doc_id, fingerprint...) with class_id: the least doc_id of the documents that verified links connect."""
    distinct = printed.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id())
    distinct = written(distinct, "distinct-edit-prints", "zstd")
    roots = components(near_links(distinct.select("id", "fingerprint"), alike))
    named = distinct.join(roots, distinct["id"] == roots["node"], "left").withColumn("root", F.coalesce("root", "id"))
    ids = distinct.select("id", "least").join(roots.withColumnRenamed("node", "id"), "id").unionByName(distinct.select("id", "least", F.col("id").alias("root")))
    ids = ids.groupBy("root").agg(F.min("least").alias("class_id"))
    # a document that is like no other is a class of its own: only the others need a look-up
    shared = named.join(ids, "root").filter("n > 1 OR least IS DISTINCT FROM class_id")
    shared = written(shared.select(F.xxhash64("fingerprint").alias("_h"), F.col("fingerprint").alias("_print"), "class_id", "least"), "edit-classes", "zstd")
    small = shared.count() <= BROADCAST
    both = (F.xxhash64("fingerprint") == F.col("_h")) & (F.col("fingerprint") == F.col("_print"))
    found = printed.join(F.broadcast(shared) if small else shared, both, "left")
    return found.withColumn("class_id", F.when(F.col("_print").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))).drop("_h", "_print", "least")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``prints`` with class_id."""
    return near_duplicates(prints(docs)).select("doc_id", *_NAMES[4:], "class_id")
