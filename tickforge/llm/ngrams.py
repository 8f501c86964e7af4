"""Interpolated modified Kneser-Ney n-gram model of any order (three by default), counted in Spark.

A text is preceded by ``order`` - 1 end tokens and followed by one. For a word w after the
context c (k - 1 words) the model's levels are, from the top down,

    P_k(w | c) = max(a(cw) - D(a(cw)), 0) / sum_x a(cx) + gamma(c) P_{k-1}(w | c without its first word)

where a is the number of occurrences at the top level and the number of distinct words
before cw at the levels below; D1, D2, D3+ are estimated at each level from its counts of
counts, and gamma(c) is what they take. A context that never occurred passes on to the
level below. The lowest level is interpolated with 1 / (V + 1).

Words are numbered: word hashes (64 bits) are kept in shards, ranges of hashes, and a word's
number joins its rank by count within its shard with the shard, so that frequent words have
small numbers. N-grams of two and more words are kept in shards by a hash of their first two
words, as sorted arrays of hashes (a bucket index and 32 bits each) beside their counts and
what they amount to as contexts. All arrays lie in the shared folder and are memory-mapped by
the workers that score texts. Counting compares whole n-grams; when scoring, an n-gram that
isn't there passes for one that is with probability 2^-28 at most.

Scale: tasks sort the n-grams of some megabytes of text and send them, packed and counted, to
their shards. A shard's task has every n-gram of its contexts: it stores the top level and
sends distinct n-grams less the first word, and sums by context, to the level below. Shards
grow in number with the tokens, so that each one's arrays stay of bounded size; no context has
more n-grams than there are words, even if a third of all text follows it. Sums by single word
come from all shards: ``fan`` rows at a time are added up. What reaches the driver is a few
numbers per shard. All counts are kept: nothing is pruned. Numbers are 32 bits wide: more than
4e9 distinct words raise an error. One job counts all levels; a lost executor's part of it is
run again and stores the same arrays.

Defined results: null text is empty (one end token); rows are scored one by one, so that
repeated rows repeat; a null doc_id counts as the empty string for the split. With no
training row every count is 0 and the model is uniform. Extra columns are not looked at.
Very long texts are worked through in parts of ``long`` characters, whole in effect.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.llm import store
from tickforge.llm.common import shared_path

ORDER = 3
END = b"\n"
FOLDS, HELD_OUT = 7, 2
LEAST_SHARDS = 8
LEAST_WORD_SHARDS = 16
_STEP = 1 << 40
UNKNOWN = 0xFFFFFFFF
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Sizes:
    """What tasks hold; scores don't depend on it."""

    piece: int = 8 << 20  # bytes of text worked on at once
    long: int = 8 << 20  # characters beyond which a text is cut into parts
    words: int = 1_000_000  # distinct words before they are sent
    shard: int = 2_000_000  # training tokens per shard of n-grams
    range: int = 1 << 16  # word numbers whose sums one task adds up
    fan: int = 64  # shards whose sums one task adds up
    bucket: int = 16  # keys in a bucket of a shard's index, about


SIZES = Sizes()


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _power(n: int, least: int) -> int:
    """The exponent of the least power of two that is n or more, and ``least`` or more."""
    return max(n - 1, least - 1, 0).bit_length()


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of runs of equal values, none of which is below 0."""
    starts = np.flatnonzero(np.diff(values.astype(np.int64), prepend=-1))
    yield from zip(values[starts].tolist(), starts.tolist(), np.append(starts[1:], len(values))[: len(starts)].tolist(), strict=True)


# --- texts as token streams


@dataclass
class Stream:
    """Tokens of some texts, each after its context: the first order - 1 places of a row are context only.

    ``words`` are the distinct ones, the end first; ``ids`` places in that list; ``scored``
    where tokens stand, and ``row`` the text of each of these.
    """

    words: list[bytes]
    ids: np.ndarray
    scored: np.ndarray
    row: np.ndarray


def _cut(text: str, order: int, long: int) -> Iterator[tuple[str, bool, bool]]:
    """Parts of a long text: (part, continued?, ends?); continued ones begin with the order - 1 words before."""
    begin = cut = 0
    recent: deque[int] = deque(maxlen=order - 1)
    for m in _WORD.finditer(text):
        if m.start() - cut >= long and len(recent) == order - 1:
            yield text[begin : m.start()], cut > 0, False
            cut = m.start()
            begin = recent[0] if recent else cut
        recent.append(m.start())
    yield text[begin:], cut > 0, True


def _parts(texts: pa.Array, order: int, sizes: Sizes) -> Iterator[tuple[list[int], pa.Array, np.ndarray, np.ndarray]]:
    """Pieces of a column: (rows, texts, continued?, ends?). Texts of more than ``sizes.long`` bytes come in parts,
    each begun by the order - 1 words before it."""
    texts = pc.fill_null(texts, "")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    rows: list[int] = []
    held = 0

    def piece() -> tuple:
        return rows, texts.take(pa.array(rows)), np.zeros(len(rows), bool), np.ones(len(rows), bool)

    for i, n in enumerate(size.tolist()):
        if n > sizes.long:
            for text, continued, ends in _cut(texts[i].as_py(), order, sizes.long):
                yield [i], pa.array([text]), np.array([continued]), np.array([ends])
            continue
        if held + n > sizes.piece and rows:
            yield piece()
            rows, held = [], 0
        rows.append(i)
        held += n
    if rows:
        yield piece()


def streams(texts: pa.Array, order: int, sizes: Sizes = SIZES) -> Iterator[Stream]:
    for rows, part, continued, ends in _parts(texts, order, sizes):
        split = pc.ascii_split_whitespace(pc.ascii_lower(part))
        encoded = split.flatten().dictionary_encode()
        words = encoded.dictionary.cast(pa.binary()).to_pylist()
        of = np.repeat(np.arange(len(part)), np.diff(split.offsets.to_numpy()))
        ids = encoded.indices.to_numpy().astype(np.int64) + 1
        if b"" in words:  # at the ends of texts
            there = ids != words.index(b"") + 1
            ids, of = ids[there], of[there]
        before = np.where(continued, 0, order - 1)
        own = np.bincount(of, minlength=len(part))
        length = before + own + ends
        start = np.cumsum(length) - length
        out = np.zeros(int(length.sum()), np.int64)
        out[np.arange(len(ids)) + (start + before - (np.cumsum(own) - own))[of]] = ids
        scored = np.ones(len(out), bool)
        for k in range(order - 1):
            scored[start + k] = False
        yield Stream([END, *words], out, scored, np.repeat(np.array(rows), length)[scored])


# --- packed rows


def packed(columns: list[np.ndarray], values: list[np.ndarray]) -> bytes:
    """Numbers of n-grams, in order, and counts: byte planes, the first column as differences, compressed."""
    n = len(columns[0])
    parts = [np.array([n], np.uint32).view(np.uint8)]
    for k, c in enumerate(columns):
        c = c.astype(np.uint32)
        c = np.diff(c, prepend=np.uint32(0)) if k == 0 else c
        parts.append(c.view(np.uint8).reshape(-1, 4).T.ravel())
    large = []
    for v in values:
        parts.append(np.minimum(v, 255).astype(np.uint8))
        large.append(v[v >= 255].astype(np.uint64))
    plain = np.concatenate([*parts, *[x.view(np.uint8) for x in large]]).tobytes()
    return len(plain).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(plain, asbytes=True)


def unpacked(data: bytes, columns: int, values: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    plain = np.frombuffer(pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True), np.uint8)
    n, at = int(plain[:4].view(np.uint32)[0]), 4
    out, counts = [], []
    for k in range(columns):
        c = np.ascontiguousarray(plain[at : at + 4 * n].reshape(4, n).T).view(np.uint32).ravel()
        out.append(np.cumsum(c, dtype=np.uint32) if k == 0 else c)
        at += 4 * n
    for _ in range(values):
        counts.append(plain[at : at + n].astype(np.uint64))
        at += n
    rest = np.frombuffer(plain[at:].tobytes(), np.uint64)
    for c in counts:
        there = np.flatnonzero(c == 255)
        c[there], rest = rest[: len(there)], rest[len(there) :]
    return out, counts


def joined(blobs: list[bytes], columns: int, values: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    every = [unpacked(b, columns, values) for b in blobs]
    if not every:
        return [np.empty(0, np.uint32)] * columns, [np.empty(0, np.uint64)] * values
    return [np.concatenate(x) for x in zip(*[c for c, _ in every], strict=True)], [np.concatenate(x) for x in zip(*[v for _, v in every], strict=True)]


def _sorted(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts of distinct rows) of rows of 32-bit numbers."""
    if len(columns) == 1:
        keys = [columns[0]]
    else:
        keys = [(columns[0].astype(np.uint64) << np.uint64(32)) | columns[1], *columns[2:]]
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(new)


def summed(columns: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct rows, in order, with the sums of their values."""
    if not len(columns[0]):
        return columns, values
    order, first = _sorted(columns)
    return [c[order[first]] for c in columns], [np.add.reduceat(v[order], first) for v in values]


def _mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash of two numbers, one to one."""
    with np.errstate(over="ignore"):
        return ((first.astype(np.uint64) << np.uint64(32)) | second) * _ODD[0]


def keys_of(columns: list[np.ndarray], bits: int) -> np.ndarray:
    """Hashes of n-grams; the first ``bits`` bits, which name the shard, are those of the first two words."""
    pair = _mixed(columns[0], columns[1])
    if len(columns) == 2:
        return pair
    with np.errstate(over="ignore"):
        h = pair
        for c in columns[2:]:
            h = (h ^ (c.astype(np.uint64) * _ODD[1])) * _ODD[2]
            h ^= h >> np.uint64(32)
        h = h * _ODD[0]
    low = np.uint64(64 - bits)
    return ((pair >> low) << low) | (h >> np.uint64(bits)) if bits else h


def shards_of(columns: list[np.ndarray], bits: int) -> np.ndarray:
    return (_mixed(columns[0], columns[1]) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(columns[0]), np.int64)


def _by_shard(columns: list[np.ndarray], values: list[np.ndarray], bits: int) -> Iterator[tuple[int, bytes]]:
    """(shard, packed rows) of sorted rows."""
    shard = shards_of(columns, bits)
    order = np.argsort(shard.astype(np.uint16) if bits <= 16 else shard, kind="stable")
    columns, values = [c[order] for c in columns], [v[order] for v in values]
    for k, a, b in _runs(shard[order]):
        yield k, packed([c[a:b] for c in columns], [v[a:b] for v in values])


# --- words


def _send_words(held: list[tuple[np.ndarray, np.ndarray]], bits: int) -> Iterator[pa.RecordBatch]:
    keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    keys, counts = keys[first], np.add.reduceat(counts, first)
    high, low = (keys >> np.uint64(32)).astype(np.uint32), keys.astype(np.uint32)
    rows = [(k, packed([high[a:b], low[a:b]], [counts[a:b]])) for k, a, b in _runs(keys >> np.uint64(64 - bits))]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "data"])


def _count_words(bits: int, sizes: Sizes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for stream in streams(batch.column("text"), 1, sizes):
                counts = np.bincount(stream.ids, minlength=len(stream.words))
                there = np.flatnonzero(counts)
                held.append((word_hashes(stream.words)[there], counts[there].astype(np.uint64)))
                size += len(there)
                if size > sizes.words:
                    yield from _send_words(held, bits)
                    held, size = [], 0
        if held:
            yield from _send_words(held, bits)

    return run


def _store_words(folder: str):
    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        (high, low), (counts,) = summed(*joined(list(part["data"]), 2, 1))
        keys = (high.astype(np.uint64) << np.uint64(32)) | low
        rank = np.empty(len(keys), np.uint32)
        rank[np.argsort(-counts.astype(np.int64), kind="stable")] = np.arange(len(keys), dtype=np.uint32)
        store.put_all(folder, f"words-{key[0]}", keys, rank, counts)
        return pd.DataFrame({"shard": [key[0]], "n": [len(keys)], "tokens": [int(counts.sum())]})

    return run


@dataclass
class Words:
    """Numbers of words: rank within the shard of their hash, and the shard."""

    folder: str
    bits: int
    present: frozenset[int]
    total: int  # V
    span: int  # numbers are below it

    def numbers(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of distinct words the numbers, ``UNKNOWN`` for those not in training, and training counts."""
        hashes = word_hashes(words)
        found, counts = np.full(len(words), UNKNOWN, np.uint64), np.zeros(len(words), np.uint64)
        order = np.argsort(hashes)
        hashes = hashes[order]
        for k, a, b in _runs(hashes >> np.uint64(64 - self.bits)):
            if k in self.present:
                keys, rank, count = store.get_all(self.folder, f"words-{k}")
                at = np.minimum(np.searchsorted(keys, hashes[a:b]), len(keys) - 1)
                same = np.flatnonzero(keys[at] == hashes[a:b])
                found[order[a + same]] = (rank[at[same]].astype(np.uint64) << np.uint64(self.bits)) | np.uint64(k)
                counts[order[a + same]] = count[at[same]]
        return found.astype(np.uint32), counts


# --- n-grams


def _count_grams(words: Words, order: int, bits: int, sizes: Sizes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream in streams(batch.column("text"), order, sizes):
                numbers, _ = words.numbers(stream.words)
                by_number = np.argsort(numbers)
                place = np.empty(len(numbers), np.uint64)
                place[by_number] = np.arange(len(numbers), dtype=np.uint64)
                numbers, ids = numbers[by_number], place[stream.ids]
                at = np.flatnonzero(stream.scored)
                columns = [ids[at - k] for k in range(order - 1, -1, -1)]
                width = np.uint64(len(numbers).bit_length())
                if order * int(width) <= 64:  # as one number each
                    one = columns[0]
                    for c in columns[1:]:
                        one = (one << width) | c
                    one.sort()
                    first = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]])) if len(one) else np.empty(0, np.int64)
                    counts = np.diff(np.append(first, len(one))).astype(np.uint64)
                    one, mask = one[first], np.uint64((1 << int(width)) - 1)
                    columns = [(one >> (width * np.uint64(k))) & mask for k in range(order - 1, -1, -1)]
                else:
                    columns, (counts,) = summed([c.astype(np.uint32) for c in columns], [np.ones(len(at), np.uint64)])
                rows = list(_by_shard([numbers[c.astype(np.int64)] for c in columns], [counts], bits))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "data"])

    return run


def _kinds(counts: np.ndarray) -> list[np.ndarray]:
    """What contexts add up: counts, and whether they are 1, 2, more."""
    return [counts, *[x.astype(np.uint64) for x in (counts == 1, counts == 2, counts > 2)]]


def _statistics(counts: np.ndarray, stored: list[int]) -> bytes:
    """How many counts are 1, 2, 3, 4, how many there are, and their sum; then the shards that are stored."""
    return np.array([*[(counts == k).sum() for k in (1, 2, 3, 4)], (counts > 0).sum(), counts.sum(), *stored], np.int64).tobytes()


def _both(rows: list[bytes]) -> np.ndarray:
    every = [np.frombuffer(x, np.int64) for x in rows]
    return np.concatenate([sum(x[:6] for x in every), *[x[6:] for x in every]])


#: Codes of contexts by (sum, ones, twos); other contexts that occur have the code ``WIDE`` and a row of their own.
_CODES = {(1, 1, 0): 1, (2, 2, 0): 2, (2, 0, 1): 3}
WIDE = 255


def _store_grams(folder: str, level: int, shard: int, bits: int, columns: list[np.ndarray], counts: np.ndarray, contexts: list[np.ndarray] | None, bucket_size: int) -> None:
    keys = keys_of(columns, bits)
    order = np.argsort(keys)
    keys, counts = keys[order] << np.uint64(bits), counts[order]
    deep = max(0, (len(keys) // bucket_size).bit_length())
    bucket = (keys >> np.uint64(64 - deep)).astype(np.int64) if deep else np.zeros(len(keys), np.int64)
    index = np.searchsorted(bucket, np.arange((1 << deep) + 1)).astype(np.uint32)
    rest = ((keys << np.uint64(deep)) >> np.uint64(32)).astype(np.uint32)
    large = np.flatnonzero(counts >= 255)
    arrays = [index, rest, np.minimum(counts, 255).astype(np.uint8), large.astype(np.uint32), counts[large].astype(np.uint64)]
    if contexts is not None:
        total, ones, twos, more = (c[order] for c in contexts)
        code = np.where(total > 0, WIDE, 0).astype(np.uint8)
        for (s, a, b), x in _CODES.items():
            code[(total == s) & (ones == a) & (twos == b)] = x
        wide = np.flatnonzero(code == WIDE)
        arrays += [code, wide.astype(np.uint32), *[c[wide].astype(np.uint64 if c is total else np.uint32) for c in (total, ones, twos, more)]]
    store.put_all(folder, f"grams-{level}-{shard}", *arrays)


#: kind 0: n-grams of a level with counts; kind 1: contexts with their sums; kind -k: statistics of level k
ROWS = "kind int, shard long, data binary"


def _level(folder: str, level: int, top: bool, bits: int, sizes: Sizes):
    """Stores a shard of a level and sends what the level below needs."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        kind = part["kind"].to_numpy() if not top else np.zeros(len(part), np.int64)
        data = part["data"].to_numpy()
        out = [(int(k), -1, x) for k, x in zip(kind, data, strict=True) if k < 0]
        columns, (counts,) = summed(*joined(list(data[kind == 0]), level, 1))
        every, values = columns, [counts]
        if not top:
            # contexts of the level above, which may not be n-grams of this one: each is whole in one shard
            above, sums = joined(list(data[kind == 1]), level, 4)
            every, values = summed(
                [np.concatenate(x) for x in zip(columns, above, strict=True)],
                [np.concatenate([counts, np.zeros(len(above[0]), np.uint64)]), *[np.concatenate([np.zeros(len(counts), np.uint64), s]) for s in sums]],
            )
        if len(values[0]):
            _store_grams(folder, level, shard, bits, every, values[0], None if top else values[1:], sizes.bucket)
        out.append((-level, -1, _statistics(counts, [shard] if len(values[0]) else [])))
        if len(counts):
            ones = np.ones(len(counts), np.uint64)
            shorter = summed(columns[1:], [ones])
            context = summed(columns[:-1], _kinds(counts))
            if level > 2:
                out += [(0, k, x) for k, x in _by_shard(*shorter, bits)]
                out += [(1, k, x) for k, x in _by_shard(*context, bits)]
            else:
                for k, (c, v) in enumerate((shorter, context)):
                    out += [(k, int(cut) * _STEP + shard, packed([c[0][a:b]], [x[a:b] for x in v])) for cut, a, b in _runs(c[0] // np.uint32(sizes.range))]
        return pd.DataFrame(out, columns=["kind", "shard", "data"])

    return run


def discounts(n: np.ndarray) -> tuple[float, float, float]:
    """D1, D2, D3+ of modified Kneser-Ney from the numbers of n-grams seen 1, 2, 3, 4 times."""
    n1, n2, n3, n4 = map(float, n[:4])
    if not (n1 and n2):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d3 = 3 - 4 * y * n4 / n3 if n3 else 2.0
    d2 = 2 - 3 * y * n3 / n2
    return min(max(1 - 2 * y * n2 / n1, 0.05), 1.0), min(max(d2, 0.05), 2.0), min(max(d3, 0.05), 3.0)


SUMS = "kind int, cut long, grp long, data binary"


def _add_up(folder: str, last: bool, sizes: Sizes):
    """Adds up rows of one range of numbers; ``last``: stores them."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        cut, group = map(int, key)
        if cut < 0:  # statistics
            rows = [(k, -1, group // sizes.fan, _both(list(x)).tobytes()) for k, x in part.groupby("kind")["data"]]
            return pd.DataFrame(rows, columns=["kind", "cut", "grp", "data"])
        before, context = np.zeros(sizes.range, np.uint64), np.zeros((4, sizes.range), np.uint64)
        for kind, data in zip(part["kind"], part["data"], strict=True):
            (at,), values = unpacked(data, 1, 1 if kind == 0 else 4)
            at = at.astype(np.int64) - cut * sizes.range  # distinct within a row
            if kind == 0:
                before[at] += values[0]
            else:
                context[:, at] += np.stack(values)
        if last:
            store.put_all(folder, f"single-{cut}", before, *context)
            rows = [(-1, cut, 0, _statistics(before, []))]
        else:
            number = np.arange(cut * sizes.range, (cut + 1) * sizes.range).astype(np.uint32)
            a, b = np.flatnonzero(before), np.flatnonzero(context[0])
            rows = [(0, cut, group // sizes.fan, packed([number[a]], [before[a]])), (1, cut, group // sizes.fan, packed([number[b]], list(context[:, b])))]
        return pd.DataFrame(rows, columns=["kind", "cut", "grp", "data"])

    return run


@dataclass
class Model:
    words: Words
    order: int
    tokens: int  # N
    bits: int  # of the number of shards
    present: dict[int, frozenset[int]]  # by level
    d: dict[int, tuple[float, float, float]]  # by level
    kinds: int  # distinct bigrams
    rest: float  # weight of the uniform distribution in the lowest level
    sizes: Sizes = SIZES

    def _less(self, counts: np.ndarray, level: int) -> np.ndarray:
        d = self.d[level]
        taken = np.where(counts > 2, d[2], np.where(counts > 1, d[1], np.where(counts > 0, d[0], 0.0)))
        return np.maximum(counts - taken, 0)

    def singles(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct numbers: distinct words before, and sum and gamma as a context."""
        before, total, gamma = (np.zeros(len(numbers)) for _ in range(3))
        order = np.argsort(numbers)
        order = order[: np.searchsorted(numbers[order], UNKNOWN)]
        for cut, a, b in _runs(numbers[order] // np.uint32(self.sizes.range)):
            some = order[a:b]
            at = (numbers[some] - np.uint32(cut * self.sizes.range)).astype(np.int64)
            arrays = store.get_all(self.words.folder, f"single-{cut}")
            before[some], total[some] = arrays[0][at], arrays[1][at]
            taken = sum(d * x[at] for d, x in zip(self.d[2], arrays[2:], strict=True))
            gamma[some] = np.divide(taken, total[some], out=np.ones(len(some)), where=total[some] > 0)
        return before, total, gamma

    def grams(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of n-grams: counts, and sum and gamma as a context (0 and 1 where they are none)."""
        level, n = len(columns), len(columns[0])
        counts, total, gamma = np.zeros(n), np.zeros(n), np.ones(n)
        keys = keys_of(columns, self.bits)
        order = np.argsort(keys)
        keys = keys[order]
        shard = keys >> np.uint64(64 - self.bits) if self.bits else np.zeros(n, np.uint64)
        for k, a, b in _runs(shard):
            if k not in self.present[level]:
                continue
            arrays = store.get_all(self.words.folder, f"grams-{level}-{k}")
            index, rest, count, large, values = arrays[:5]
            own = keys[a:b] << np.uint64(self.bits)
            deep = (len(index) - 1).bit_length() - 1
            bucket = (own >> np.uint64(64 - deep)).astype(np.int64) if deep else np.zeros(b - a, np.int64)
            own = ((own << np.uint64(deep)) >> np.uint64(32)).astype(np.uint32)
            low, end = index[bucket].astype(np.int64), index[bucket + 1].astype(np.int64)
            high = end.copy()
            for _ in range(int((end - low).max(initial=0)).bit_length()):
                middle = (low + high) >> 1
                less = (rest[np.minimum(middle, len(rest) - 1)] < own) & (middle < high)
                low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
            there = np.flatnonzero((low < end) & (rest[np.minimum(low, len(rest) - 1)] == own))
            at, to = low[there], order[a + there]
            found = count[at].astype(np.float64)
            if (many := np.flatnonzero(found == 255)).size:
                found[many] = values[np.searchsorted(large, at[many])]
            counts[to] = found
            if level < self.order:
                code, wide, *sums = arrays[5:]
                d, c = self.d[level + 1], code[at]
                for (s, ones, twos), x in _CODES.items():
                    some = to[c == x]
                    total[some], gamma[some] = s, (d[0] * ones + d[1] * twos) / s
                if (many := np.flatnonzero(c == WIDE)).size:
                    place = np.searchsorted(wide, at[many])
                    s = sums[0][place].astype(np.float64)
                    total[to[many]] = s
                    gamma[to[many]] = sum(x * y[place] for x, y in zip(d, sums[1:], strict=True)) / s
        return counts, total, gamma

    def scores(self, stream: Stream, rows: int) -> np.ndarray:
        """Per row: n_tokens, n_known, base score, score."""
        at, ids = np.flatnonzero(stream.scored), stream.ids
        numbers, seen = self.words.numbers(stream.words)
        before, total, gamma = self.singles(numbers)
        size = self.words.total + 1
        base = np.log10((seen + 1.0) / (self.tokens + size))
        p = (self.rest / size + self._less(before, 1) / max(self.kinds, 1))[ids]
        total, gamma = total[ids], gamma[ids]
        known = numbers != UNKNOWN
        for level in range(2, self.order + 1):
            own = [numbers[ids[level - 1 - k : len(ids) - k]] for k in range(level - 1, -1, -1)]
            whole = known[ids]
            there = np.flatnonzero(np.logical_and.reduce([whole[level - 1 - k : len(ids) - k] for k in range(level)]))
            found = self.grams([c[there] for c in own])
            counts, sums, rests = np.zeros(len(ids)), np.zeros(len(ids)), np.ones(len(ids))
            for x, y in zip((counts, sums, rests), found, strict=True):
                x[there + level - 1] = y
            # the context of a place ends at the place before
            s, g = np.append(0.0, total[:-1]), np.append(1.0, gamma[:-1])
            p = np.where(s > 0, np.divide(self._less(counts, level), s, out=np.zeros(len(ids)), where=s > 0) + g * p, p)
            total, gamma = sums, rests
        sum_of = lambda x: np.bincount(stream.row, x, rows)
        return np.stack([sum_of(np.ones(len(at))), sum_of(known[ids[at]]), sum_of(base[ids[at]]), sum_of(np.log10(p[at]))], 1)


def train(texts: DataFrame, order: int = ORDER, sizes: Sizes = SIZES) -> Model:
    """A model of the rows' column ``text``; its arrays stay in the shared folder."""
    if order < 2:
        raise ValueError("the order must be 2 or more")
    texts = texts.select("text")
    folder = shared_path(texts.sparkSession, "ngrams")
    bits = _power(-(-texts.rdd.getNumPartitions() // 4), LEAST_WORD_SHARDS)
    sent = texts.mapInArrow(_count_words(bits, sizes), "shard long, data binary")
    made = sent.groupBy("shard").applyInPandas(_store_words(folder), "shard long, n long, tokens long").collect()
    total, tokens = sum(r["n"] for r in made), sum(r["tokens"] for r in made)
    span = max((r["n"] for r in made), default=0) << bits
    if span >= UNKNOWN:
        raise ValueError("more distinct words than 32-bit numbers")
    words = Words(folder, bits, frozenset(r["shard"] for r in made), total, span)
    if not total:
        none = {k: frozenset() for k in range(1, order + 1)}
        return Model(words, order, 0, 0, none, {k: (0.5, 0.75, 0.9) for k in none}, 0, 1.0, sizes)
    bits = _power(-(-tokens // sizes.shard), LEAST_SHARDS)
    sent = texts.mapInArrow(_count_grams(words, order, bits, sizes), "shard long, data binary")
    for level in range(order, 1, -1):
        sent = sent.groupBy("shard").applyInPandas(_level(folder, level, level == order, bits, sizes), ROWS)
    step = F.lit(_STEP)
    single = F.col("shard") >= 0
    sums = sent.select("kind", F.when(single, F.floor(F.col("shard") / step)).otherwise(-1).alias("cut"), F.when(single, F.floor(F.pmod("shard", step) / sizes.fan)).otherwise(0).alias("grp"), "data")
    groups = -(-(1 << bits) // sizes.fan)
    while groups > 1:
        sums = sums.groupBy("cut", "grp").applyInPandas(_add_up(folder, False, sizes), SUMS)
        groups = -(-groups // sizes.fan)
    done = sums.groupBy("cut", "grp").applyInPandas(_add_up(folder, True, sizes), SUMS).select("kind", "data").collect()
    seen = {k: _both([r["data"] for r in done if r["kind"] == -k]) for k in range(1, order + 1)}
    present = {k: frozenset(n[6:].tolist()) for k, n in seen.items()}
    d = {k: discounts(n) for k, n in seen.items()}
    low = seen[1]
    rest = (d[1][0] * low[0] + d[1][1] * low[1] + d[1][2] * (low[4] - low[0] - low[1])) / low[5]
    return Model(words, order, tokens, bits, present, d, int(low[5]), float(rest), sizes)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((batch.num_rows, 4))
            for stream in streams(batch.column("text"), model.order, model.sizes):
                found += model.scores(stream, batch.num_rows)
            whole = [pa.array(x.astype(np.int64)) for x in (found[:, 0], found[:, 1], np.full(batch.num_rows, model.tokens))]
            columns = [batch.column("doc_id"), batch.column("held_out"), *whole, pa.array(found[:, 2]), pa.array(found[:, 3])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = docs.select("doc_id", held_out(docs["doc_id"]).alias("held_out"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def train_and_score(docs: DataFrame, order: int = ORDER, sizes: Sizes = SIZES) -> DataFrame:
    """The model learns from the rows that aren't held out; all are scored."""
    return score(docs, train(docs.filter(~held_out(docs["doc_id"])), order, sizes))
