"""The probabilistic suffix tree of ``pst`` without shares: every level is a table.

A context (the last d words) is a candidate when it occurs ``Params.least`` times and its
suffix is kept; it is kept when its next-word distribution diverges from its suffix's.
Next words that follow it ``least`` times are explicit.  Both counts are fixed numbers:
no threshold rises with the input, and no table has a most number of rows.

A token's log10 probability is a sum over its contexts: of each kept one its factor on
other words, and of each explicit pair of context and next word what that pair differs by.
So the model is one table of keys and values, and a text's score is the sum of the values
its keys find.  Keys are 64-bit hashes of words, contexts and pairs.  The most frequent
keys are broadcast, all others are joined; where a key is doesn't change the result.
Bloom filters only spare rows that would find nothing.

Tables hold arrays: a row is a bucket, by the highest bits of a key, and the bytes of the
columns of some of its entries.  Spark deals the buckets to tasks, whose number rises with
the tokens, and each task sums or joins those it is dealt.  The texts are split into words
once for the counts of all levels and once for the scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, coded, materialize, mixed, release, scratch, steps, words_of

MOST_BITS = 1 << 28  # of a filter (32 MB)
HELD = 2_000_000  # entries a task holds before it sums them
SLICE = 400_000  # tokens of some texts that are worked on at once
HOT = 1e-4  # share of the tokens from which the pairs of a word are dealt to several buckets
WORD, CONTEXT, PAIR, UNTOLD = range(4)  # UNTOLD: pairs that are left to the suffix
U64, I64, F64, U32 = np.uint64, np.int64, np.float64, np.uint32


@dataclass(frozen=True)
class Params:
    depth: int = 5
    least: int = 2  # fewest occurrences of a context and of an explicit next word
    discount: float = 0.5
    nats: float = 0.005  # least divergence of a kept context
    evidence: float = 20.0  # least divergence times count, in nats
    head: float = 2e-7  # share of the tokens from which a key's value is broadcast, not joined
    rounds: int = 3  # least parts of the texts that are scored one after another
    turn: float = 0.5  # most records a token that a level shuffles at once: more are counted in turns, which bounds the disk
    joined: float = 0.2  # most joined keys a token of a part of the texts, likewise
    part: int = 4_000_000  # tokens for each task that sums or joins


@dataclass
class Model:
    tokens: int
    distinct: int
    params: Params
    lookup: DataFrame  # bucket, kind and the arrays key, value (of words log10(n + 1)), parent, n
    parts: int


def _pair(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """A pair's key by that of the pair of the suffix with the same next word (of one word: by the next word's key)."""
    return context ^ (suffix << np.uint64(17) | suffix >> np.uint64(47))


def _single(word: np.ndarray) -> np.ndarray:
    """A context of one word by the word, and the other way about."""
    return word ^ np.uint64(0xD1B54A32D192ED03)


def _longer(context: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mixed(context * np.uint64(0x2545F4914F6CDD1D) + before)


def _hashed(distinct: pa.Array) -> np.ndarray:
    """64-bit hashes of the distinct words: what each byte at its place stands for, summed and mixed; none is 0."""
    if not len(distinct):
        return np.zeros(0, np.uint64)
    bounds = np.frombuffer(distinct.buffers()[1], np.int64, len(distinct) + 1, distinct.offset * 8)
    data = np.frombuffer(distinct.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    place = np.arange(len(data)) - np.repeat(bounds[:-1], np.diff(bounds))
    near = place < len(PLACES)
    told = PLACES.ravel()[np.where(near, place << 8, 0) + data]
    if not near.all():
        told[~near] = mixed((place[~near].astype(np.uint64) << np.uint64(8) | data[~near]) + np.uint64(1))
    total = np.append(np.uint64(0), np.cumsum(told, dtype=np.uint64))  # modulo 2^64
    out = mixed(total[bounds[1:]] - total[bounds[:-1]] + np.uint64(0x9E3779B97F4A7C15))
    return np.where(out == 0, np.uint64(1), out)  # 0 stands for pairs that are counted for their context alone


PLACES = mixed(np.arange(1, 256 * 256 + 1, dtype=np.uint64)).reshape(256, 256)  # what a byte (second) at one of the first places (first) stands for


class Text:
    """Keys of all tokens of some texts: words and ends in order, and where each text begins."""

    def __init__(self, distinct: np.ndarray, codes: np.ndarray, lengths: np.ndarray):
        self.distinct, self.codes = distinct, codes  # distinct words with the end last, and each token's number among them
        self.offsets = np.append(0, np.cumsum(lengths, dtype=np.int64))
        self.words = distinct[codes]
        self.place = np.arange(len(codes)) - np.repeat(self.offsets[:-1], lengths)

    @classmethod
    def of(cls, texts: pa.Array) -> Text:
        words, ends = words_of(texts)
        codes, distinct = coded(words)
        last = ends[1:] + np.arange(len(ends) - 1)
        is_end = np.zeros(len(codes) + len(last), bool)
        is_end[last] = True
        out = np.full(len(is_end), len(distinct), np.int64)
        out[~is_end] = codes
        return cls(np.append(_hashed(distinct), END), out, np.diff(ends) + 1)


END = _hashed(pa.array([b""], pa.large_binary()))[0]


@contextmanager
def _short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files are deleted with the query that wrote them, not once the driver's garbage is collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _bucket(keys: np.ndarray, parts: int) -> np.ndarray:
    """By the 24 highest bits; four buckets for each task, which evens out what tasks are dealt."""
    return ((keys >> np.uint64(40)) * np.uint64(min(4 * parts, 1 << 24)) >> np.uint64(24)).astype(np.int64)


def _rows(bucket: np.ndarray, columns: list[np.ndarray], *more: int) -> pa.RecordBatch:
    """A row for each bucket: its number, ``more`` numbers, and its entries of each column as bytes."""
    if len(bucket) and (bucket[1:] < bucket[:-1]).any():
        order = np.argsort(bucket.astype(np.uint16) if bucket.max() < 1 << 16 else bucket, kind="stable")
        bucket, columns = bucket[order], [c[order] for c in columns]
    return _cut([(bucket, columns)], *more)


def _cut(tables: list[tuple[np.ndarray, list[np.ndarray]]], *more: int) -> pa.RecordBatch:
    """The same of several tables of one row a bucket, their buckets in order; the first has entries of every bucket."""
    bucket = tables[0][0]
    rows = bucket[np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))] if len(bucket) else bucket
    arrays = [pa.array(rows, pa.int64()), *(pa.array(np.full(len(rows), m), pa.int64()) for m in more)]
    for bucket, columns in tables:
        bounds = np.append(np.searchsorted(bucket, rows), len(bucket))
        for c in columns:
            data = pa.py_buffer(np.ascontiguousarray(c))
            arrays.append(pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((bounds * c.dtype.itemsize).astype(np.int32)), data]))
    return pa.RecordBatch.from_arrays(arrays, names=[f"c{i}" for i in range(len(arrays))])


def _bytes(column: pa.Array, kind: type) -> np.ndarray:
    """All entries of a column of arrays, one row after another."""
    bounds = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]].view(kind) if data is not None and bounds[-1] > bounds[0] else np.zeros(0, kind)


def _joined(arrays: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, kind)


def _entries(batches: Iterator[pa.RecordBatch], columns: dict[str, type]) -> list[np.ndarray]:
    """Everything that a task is dealt, by column."""
    held: list[list[np.ndarray]] = [[] for _ in columns]
    for batch in batches:
        for into, (name, kind) in zip(held, columns.items(), strict=True):
            into.append(_bytes(batch.column(name), kind).copy())
    return [_joined(x, kind) for x, kind in zip(held, columns.values(), strict=True)]


def _by_side(batches: Iterator[pa.RecordBatch]) -> dict[int, list[pa.RecordBatch]]:
    out: dict[int, list[pa.RecordBatch]] = {0: [], 1: []}
    for batch in batches:
        for side, into in out.items():
            into.append(batch.filter(pc.equal(batch.column("side"), side)))
    return out


def _filter(table: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray], count: int, parts: int) -> np.ndarray:
    """A Bloom filter of the keys: 16 bits for each, ``MOST_BITS`` at most; its places are a key's lowest and highest bits.

    Tasks send places by blocks of 2^16 bits; the blocks' bits come to the driver.
    """
    size = 16
    while 1 << size < min(16 * count, MOST_BITS):
        size += 1

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = keys(batch)
            for i in range(0, len(k), HELD):
                p = np.concatenate([k[i : i + HELD] & np.uint64((1 << size) - 1), k[i : i + HELD] >> np.uint64(64 - size)])
                yield _rows((p >> np.uint64(16)).astype(np.int64), [(p & np.uint64(0xFFFF)).astype(np.uint16)])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, block in enumerate(batch.column(0).to_pylist()):
                blocks.setdefault(block, np.zeros(1 << 16, bool))[_bytes(batch.column(1).slice(i, 1), np.uint16)] = True
        for block, x in blocks.items():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([np.packbits(x, bitorder="little").tobytes()])], names=["c0", "c1"])

    rows = arrow_map(table, places, "c0 long, c1 binary").repartition(min(parts, 12), "c0")
    found = arrow_map(rows, bits, "c0 long, c1 binary").toArrow()
    out = np.zeros((1 << size - 16, 1 << 10), np.uint64)
    for block, data in zip(found["c0"].to_pylist(), found["c1"].to_pylist(), strict=True):
        out[block] = np.frombuffer(data, np.uint64)
    return out.ravel()


def _held(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    size, bits = 6 + (len(bits) - 1).bit_length(), bits.view(np.uint8)

    def bit(p: np.ndarray) -> np.ndarray:
        return (bits.take((p >> np.uint64(3)).view(np.int64)) >> (p & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)

    out = bit(keys & np.uint64((1 << size) - 1))
    some = np.flatnonzero(out)
    out[some] = bit(keys[some] >> np.uint64(64 - size))
    return out


def _turned(keys: np.ndarray) -> np.ndarray:
    """Keys whose highest bits don't tell the bucket, which those of a task have in common."""
    return keys << np.uint64(24) | keys >> np.uint64(40)


def _order(keys: np.ndarray) -> np.ndarray:
    """A stable order of 64-bit keys: their highest bits are sorted with the places in the lowest, faster than places alone."""
    low = np.uint64((1 << max(1, len(keys) - 1).bit_length()) - 1)
    order = (np.sort(keys & ~low | np.arange(len(keys), dtype=np.uint64)) & low).view(np.int64)
    found = keys[order]
    if (found[1:] < found[:-1]).any():  # some differ in the lowest bits alone
        order = order[np.argsort(found, kind="stable")]
    return order


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)


def _side_by_side(buckets: np.ndarray, keys: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """An order by bucket that brings equal keys together, and equal pairs of a key, but for a few that have many bits in common with others."""
    own = np.uint64(max(1, int(buckets.max(initial=0)).bit_length()))
    low = np.uint64((1 << max(1, len(keys) - 1).bit_length()) - 1)
    high = np.uint64((1 << 26) - 1 << 38)
    top = buckets.astype(np.uint64) << np.uint64(64) - own | _turned(keys) >> own
    return (np.sort(top & high | pairs >> np.uint64(26) & ~(high | low) | np.arange(len(keys), dtype=np.uint64)) & low).view(np.int64)


def _counts(parts: Iterator[tuple[np.ndarray, np.ndarray]], deal: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Partial counts of pairs (c, s) by bucket, summed whenever many are held.

    A row has each context c once, with the number ``m`` of its pairs and the count ``z`` of
    those whose s is 0, and the other pairs' s and counts n.
    """
    held: list[tuple[np.ndarray, ...]] = []

    def summed() -> pa.RecordBatch:
        c, s = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        k, b = _pair(c, s), deal(c, s)
        order = _side_by_side(b, c, k)
        first = _firsts(k[order])
        n = np.diff(np.append(first, len(order))).astype(np.uint32)
        order = order[first]
        c, s, b = c[order], s[order], b[order]
        start = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (b[1:] != b[:-1]))) if len(c) else np.zeros(0, np.int64)
        told = s != 0
        m, z = (np.add.reduceat(x, start) if len(c) else np.zeros(0, np.uint32) for x in (told.astype(np.uint32), np.where(told, np.uint32(0), n)))
        return _cut([(b[start], [c[start], m.astype(np.uint32), z.astype(np.uint32)]), (b[told], [s[told], n[told]])])

    for t in parts:
        held.append(t)
        if sum(len(x[0]) for x in held) > HELD:
            yield summed()
    if held:
        yield summed()


COUNTS = "bucket long, c binary, m binary, z binary, s binary, n binary"
LOOKUP = "bucket long, kind long, key binary, value binary, parent binary, n binary"


def _tokens(train: DataFrame) -> DataFrame:
    """Texts as numbers of words, the most frequent ones first; a row for many steps, with the hashes of its distinct words.

    The numbers' lowest bytes come first, then the next ones: so they compress best.
    """

    def row(texts: list[Text]) -> pa.RecordBatch:
        own = np.concatenate([x.distinct for x in texts])
        before = np.cumsum([0, *(len(x.distinct) for x in texts)])
        order = _order(own)
        new = np.append(True, own[order][1:] != own[order][:-1])
        number = np.empty(len(own), np.int64)
        number[order] = np.cumsum(new) - 1
        codes = np.concatenate([number[x.codes + b] for x, b in zip(texts, before[:-1], strict=True)])
        commonest = np.argsort(-np.bincount(codes, minlength=int(new.sum())))
        rank = np.empty(len(commonest), np.uint32)
        rank[commonest] = np.arange(len(commonest), dtype=np.uint32)
        planes = np.ascontiguousarray(rank[codes].view(np.uint8).reshape(-1, 4).T)
        lengths = np.concatenate([np.diff(x.offsets) for x in texts]).astype(np.uint32)
        arrays = [pa.array([x.tobytes()], pa.binary()) for x in (own[order][new][commonest], planes, lengths)]
        return pa.RecordBatch.from_arrays(arrays, names=["own", "codes", "lengths"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Text] = []
        for batch in batches:
            for part in steps(batch, "text"):
                held.append(Text.of(part.column("text")))
                if sum(len(x.codes) for x in held) > HELD:
                    yield row(held)
                    held.clear()
        if held:
            yield row(held)

    return arrow_map(train.select("text"), run, "own binary, codes binary, lengths binary")


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each row's distinct words, the words' numbers and the texts' lengths."""
    for batch in batches:
        for i in range(batch.num_rows):
            own, planes, lengths = (_bytes(batch.column(c).slice(i, 1), kind) for c, kind in (("own", U64), ("codes", np.uint8), ("lengths", U32)))
            yield own, np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel(), lengths.astype(np.int64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[Text]:
    for own, codes, lengths in _numbers(batches):
        ends = np.cumsum(lengths)
        start = 0
        while start < len(lengths):  # whole texts, one at least
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + SLICE, side="right")))
            yield Text(own, codes[base : ends[stop - 1]].astype(np.int64), lengths[start:stop])
            start = stop


def _words(tokens: DataFrame, parts: int) -> DataFrame:
    """The words' counts as a table of the model's form; ``parent`` is the count until the tokens are known."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for own, codes, _ in _numbers(batches):
            held.append((own, np.bincount(codes, minlength=len(own))))
            if sum(len(w) for w, _ in held) > HELD:
                w, n = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held.clear()
                yield _rows(_bucket(w, parts), [w, n])
        if held:
            w, n = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield _rows(_bucket(w, parts), [w, n])

    def summed(w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = _order(w)
        first = _firsts(w[order])
        return w[order[first]], np.add.reduceat(n[order], first)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, n = _entries(batches, {"w": U64, "n": I64})
        if not len(w):
            return
        w, n = summed(w, n)
        value = np.log10(n + 1)
        yield _rows(_bucket(w, parts), [w, value, value, n], WORD)

    rows = arrow_map(tokens, counts, "bucket long, w binary, n binary")
    return arrow_map(rows.repartition(parts, "bucket"), sums, LOOKUP)


def _frequent(lookup: DataFrame, least: float) -> list[np.ndarray]:
    """key, value, whether it is a word, and n of the entries counted ``least`` times, in the order that ``Index`` takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, value, n = (_bytes(batch.column(c), kind) for c, kind in (("key", U64), ("value", F64), ("n", I64)))
            word = np.repeat(batch.column("kind").to_numpy() == WORD, pc.binary_length(batch.column("key")).to_numpy() // 8)
            on = n >= least
            yield pa.RecordBatch.from_arrays([pa.array(key[on].view(np.int64)), pa.array(value[on]), pa.array(word[on].astype(np.int64)), pa.array(n[on])], names=["key", "value", "word", "n"])

    found = arrow_map(lookup, run, "key long, value double, word long, n long").toArrow()
    key = found["key"].to_numpy().view(np.uint64)
    order = _order(_turned(key))
    return [key[order], *(found[c].to_numpy()[order] for c in ("value", "word", "n"))]


class Index:
    """Where keys are in an array by the order of ``_turned``: by where each number of their highest bits begins."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.shift = _turned(keys), np.uint64(63 - max(1, len(keys).bit_length()))
        top = (self.keys >> self.shift).view(np.int64)
        self.start = np.append(0, np.cumsum(np.bincount(top, minlength=1 << 64 - int(self.shift)))).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        keys = _turned(keys)
        out, top = np.full(len(keys), -1, np.int64), (keys >> self.shift).view(np.int64)
        at, end = self.start[top], self.start[top + 1]
        live = np.flatnonzero(at < end)
        at, end = at[live], end[live]
        while len(live):
            hit = self.keys[at] == keys[live]
            out[live[hit]] = at[hit]
            at += 1
            on = ~hit & (at < end)
            live, at, end = live[on], at[on], end[on]
        return out


def _level(tokens: DataFrame, depth: int, shared: Broadcast, least: int, parts: int, turn: int = 0, turns: int = 1) -> DataFrame:
    """Pairs of context and next word by the bucket of the suffix's pair: that pair s, the context c, the counts of the pair and the context.

    Of the first level s is the next word's key.
    ``shared``: the most frequent contexts of one word with their counts, a filter of all pairs of words, and one of the
    level below, of kept contexts and their pairs.  Of ``turns`` parts of the contexts, by their last
    word, the one numbered ``turn`` is counted.
    """

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        _, twice, below = shared.value
        for text in _texts(batches):
            at = np.flatnonzero(text.place >= depth)
            if turns > 1:
                at = at[(text.words[at - 1] & np.uint64(0xFFFF)) * np.uint64(turns) >> np.uint64(16) == turn]
            c, s = _single(text.words[at - 1]), text.words[at]
            for d in range(2, depth + 1):
                s = _pair(c, s)
                if d == depth:
                    on = np.flatnonzero(_held(below, c))
                    # no context occurs more often than its first two words; that the others do, below tells
                    on = on[_held(twice, _pair(_single(text.words[at[on] - d]), text.words[at[on] - d + 1]))]
                    at, c, s = at[on], c[on], s[on]
                    s = np.where(_held(below, s), s, np.uint64(0))  # 0: counted for the context alone
                c = _longer(c, text.words[at - d])
            yield c, s

    def deal(c: np.ndarray, s: np.ndarray) -> np.ndarray:
        if depth > 1:
            return _bucket(c, parts)
        several = shared.value[0][0].find(c) >= 0
        return _bucket(np.where(several, mixed(c ^ s >> np.uint64(54)), c), parts)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, m, z, s, n = _entries(batches, {"c": U64, "m": U32, "z": U32, "s": U64, "n": U32})
        own = np.repeat(np.arange(len(c)), m)
        counted = z + np.bincount(own, n, len(c)).astype(np.int64)
        k = _turned(_pair(c[own], s))
        order = _order(k)
        first = _firsts(k[order])
        if not len(first):
            return
        n = np.add.reduceat(n[order].astype(np.int64), first)
        on = n >= least
        at = order[first[on]]
        s, of, n = s[at], c[own[at]], n[on]
        # the counts of their contexts
        contexts = np.unique(_turned(of))
        contexts = Index(contexts >> np.uint64(24) | contexts << np.uint64(40))
        place = contexts.find(c)
        total = np.bincount(place[place >= 0], counted[place >= 0], len(contexts.keys)).astype(np.int64)[contexts.find(of)]
        if depth == 1:
            keys, counts = shared.value[0]
            place = keys.find(of)
            total[place >= 0] = counts[place[place >= 0]]
        on = np.flatnonzero(total >= least)
        on = on[_order(_turned(of[on]))]  # equal contexts compress
        yield _rows(_bucket(s[on], parts), [s[on], of[on], n[on], total[on]], 0)

    rows = arrow_map(tokens, lambda b: _counts(tables(b), deal), COUNTS)
    return arrow_map(rows.repartition(parts, "bucket"), sums, "bucket long, side long, s binary, c binary, n binary, total binary")


def _with_parents(level: DataFrame, parents: DataFrame, shift: float, params: Params, parts: int) -> DataFrame:
    """Pairs by the bucket of their context, with the log10 probability that the suffix gives their next word."""
    empty = F.lit(b"").alias
    sides = level.union(parents.select("bucket", F.lit(1).cast("long").alias("side"), "key", "parent", empty("n"), empty("total")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _by_side(batches)
        key, parent = _entries(iter(sides[1]), {"s": U64, "c": F64})
        s, c, n, total = _entries(iter(sides[0]), {"s": U64, "c": U64, "n": I64, "total": I64})
        order = _order(_turned(key))
        place = Index(key[order]).find(s)
        on = place >= 0
        s, c = s[on], c[on]
        yield _rows(_bucket(c, parts), [c, _pair(c, s), n[on], total[on], parent[order[place[on]]] - shift])

    return arrow_map(sides.repartition(parts, "bucket"), run, "bucket long, c binary, k binary, n binary, total binary, parent binary")


def _kept(pairs: DataFrame, params: Params, parts: int) -> DataFrame:
    """The contexts whose next words diverge from their suffix's, with their factor on other words, and their pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, k, n, total, parent = _entries(batches, {"c": U64, "k": U64, "n": I64, "total": I64, "parent": F64})
        if not len(c):
            return
        order = _order(_turned(c))
        c, k, n, total, parent = (x[order] for x in (c, k, n, total, parent))
        new = np.append(True, c[1:] != c[:-1])
        first, own = np.flatnonzero(new), np.cumsum(new) - 1
        p = np.log10((n - params.discount) / total)
        told = np.abs(p - parent) > np.log10(1.2)  # others are left to the suffix
        sums = lambda x: np.bincount(own, np.where(told, x, 0.0))
        mass, left, gain = sums(10**p), sums(10**parent), sums(10**p * (p - parent))
        spread = np.log10(np.maximum(1 - mass, 1e-12) / np.maximum(1 - left, 1e-12))
        nats = np.log(10) * (gain + (1 - mass) * spread)
        kept = (sums(1.0) > 0) & (nats >= params.nats) & (nats * total[first] >= params.evidence)
        contexts = first[kept]
        yield _rows(_bucket(c[contexts], parts), [c[contexts], spread[kept], spread[kept], total[contexts]], CONTEXT)
        on = kept[own]
        k, n, p, told, other = k[on], n[on], p[on], told[on], (parent + spread[own])[on]
        for kind, own, parent in ((PAIR, told, p), (UNTOLD, ~told, other)):
            yield _rows(_bucket(k[own], parts), [k[own], (p - other)[own], parent[own], n[own]], kind)

    return arrow_map(pairs.repartition(parts, "bucket"), run, LOOKUP)


def _sums(table: DataFrame, least: float = 0.0) -> tuple[int, int, int]:
    """The number of entries, the sum of the contexts' counts, and that of entries counted fewer than ``least`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = _bytes(batch.column("n"), I64)
            context = np.repeat(batch.column("kind").to_numpy() == CONTEXT, pc.binary_length(batch.column("n")).to_numpy() // 8)
            yield pa.RecordBatch.from_pydict({"a": [len(n)], "b": [int(n[context].sum())], "c": [int(n[n < least].sum())]})

    return tuple(x or 0 for x in arrow_map(table.select("kind", "n"), run, "a long, b long, c long").agg(F.sum("a"), F.sum("b"), F.sum("c")).first())


def _size(table: DataFrame, column: str) -> int:
    return (table.agg(F.sum(F.length(column))).first()[0] or 0) // 8


def fit(train: DataFrame, *, text_col: str = "text", params: Params = Params()) -> Model:
    """The model of the training texts (null: empty).  Repeated rows count as often as they are there.

    Without rows nothing is known, and every token has the probability 1.
    """
    train = train.select(train[text_col].alias("text"))
    with scratch() as keep, _short_shuffles(train.sparkSession):
        texts = materialize(_tokens(train), "op3-tokens")
        tokens = (texts.agg(F.sum(F.length("codes"))).first()[0] or 0) // 4
        parts = max(1, -(-tokens // params.part))
        words = keep(materialize(_words(texts, parts), "op3-words"))
        distinct = _size(words, "key")
        word, _, _, n = _frequent(words, max(1.0, HOT * tokens))  # at most 1 / HOT
        hot = _single(word)
        order = _order(_turned(hot))
        hot = Index(hot[order]), n[order]
        tables, parents, shift, twice, below, records = [words], words, float(np.log10(tokens + distinct + 1)), None, None, tokens
        for d in range(1, params.depth + 1):
            shared = train.sparkSession.sparkContext.broadcast((hot, twice, below))
            turns = max(1, int(np.ceil(records / max(1.0, params.turn * tokens))))
            levels = [materialize(_level(texts, d, shared, params.least, parts, i, turns), f"op3-level{d}") for i in range(turns)]
            level = reduce(DataFrame.union, levels)
            shared.destroy()
            if d == 1 < params.depth:
                twice = _filter(level.select("s", "c"), lambda b: _pair(_bytes(b.column("c"), U64), _bytes(b.column("s"), U64)), _size(level, "s"), parts)
            kept = keep(materialize(_kept(_with_parents(level, parents, shift, params, parts), params, parts), f"op3-kept{d}"))
            for x in levels:
                release(x)
            tables.append(kept)
            parents, shift = kept.filter(F.col("kind") >= PAIR), 0.0
            count, records, _ = _sums(kept)  # the next level has a record at most for each token that follows a kept context
            if not count:
                break
            if d < params.depth:
                below = _filter(kept.select("key"), lambda b: _bytes(b.column("key"), U64), count, parts)
    return Model(tokens, distinct, params, reduce(DataFrame.unionByName, tables).filter(F.col("kind") != UNTOLD), parts)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text: ``id_col``, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts are the end alone.  With no training tokens every token has the
    probability 1.  Very long texts are scored whole; repeated rows are scored each; an
    empty table gives no rows.  Other columns, whatever their names, are not read.
    """
    with _short_shuffles(docs.sparkSession):
        return _scored(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), model, id_col)


def _scored(docs: DataFrame, model: Model, id_col: str) -> DataFrame:
    params, lookup = model.params, model.lookup
    least = max(1.0, params.head * model.tokens)
    key, value, word, _ = _frequent(lookup, least)  # at most 1 / head rows a level and kind
    count, _, rare = _sums(lookup, least)  # texts like the training ones join a key for each time that one is counted
    rounds = max(params.rounds, int(np.ceil(rare / max(1.0, params.joined * model.tokens))))
    bits = _filter(lookup.select("key"), lambda b: _bytes(b.column("key"), U64), count, model.parts)
    shared = docs.sparkSession.sparkContext.broadcast((Index(key), value, word, bits))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(rounds))
    out = []
    for i in range(rounds):
        rows = materialize(_lookups(docs.filter(part == i) if rounds > 1 else docs, shared, model), "op3-rows")
        sums = _summed(rows, _found(rows, lookup, model), model)
        names = F.col("id").alias(id_col), "n_tokens", F.col("known").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score"
        out.append(materialize(sums.select(*names), "op3-scored"))
        release(rows)
    shared.destroy()
    return reduce(DataFrame.unionByName, out)


def _lookups(docs: DataFrame, shared, model: Model) -> DataFrame:
    """Of each step of texts a row for each text with what the broadcast values give, and for each bucket the keys that are to be joined, with their texts and counts."""
    params, parts = model.params, model.parts
    id_type = docs.schema["id"].dataType.simpleString()
    unseen = -float(np.log10(model.tokens + model.distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, values, words, bits = shared.value

        def local(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Which keys the model may have, and where in ``head`` (-1: not there)."""
            may = _held(bits, keys)
            at = np.full(len(keys), -1, np.int64)
            at[may] = head.find(keys[may])
            return may, at

        for batch in batches:
            for part in steps(batch, "text"):
                text, n, row = Text.of(part.column("text")), part.num_rows, part.column("row")[0].as_py()
                of = np.repeat(np.arange(n), np.diff(text.offsets))
                base, score, known = np.full(len(text.words), unseen), np.full(len(text.words), unseen), np.zeros(len(text.words), np.int64)
                docs, keys = [], []

                def add(at: np.ndarray, key: np.ndarray, may: np.ndarray, place: np.ndarray) -> None:
                    mine = place >= 0
                    score[at[mine]] += values[place[mine]]
                    rest = may & ~mine
                    docs.append(of[at[rest]])  # noqa: B023
                    keys.append(key[rest])  # noqa: B023

                everywhere = np.arange(len(text.words))
                may, place = (x[text.codes] for x in local(text.distinct))
                add(everywhere, text.words, may, place)
                base[place >= 0] += values[place[place >= 0]]
                known[place >= 0] = words[place[place >= 0]]
                may, place = local(_single(text.distinct))
                at = np.flatnonzero(text.place >= 1)
                before = text.codes[at - 1]
                at, before = at[may[before]], before[may[before]]
                context, may, place = _single(text.distinct)[before], may[before], place[before]
                pair = text.words[at]
                for d in range(1, params.depth + 1):
                    add(at, context, may, place)
                    pair = _pair(context, pair)
                    add(at, pair, *local(pair))
                    on = text.place[at] > d
                    at, pair = at[on], pair[on]
                    context = _longer(context[on], text.words[at - d - 1])
                    may, place = local(context)
                    at, context, pair, place = at[may], context[may], pair[may], place[may]
                    may = may[may]

                sums = lambda x: pa.array(np.add.reduceat(x, text.offsets[:-1]))  # noqa: B023, E731  every text has its end, so no range is empty
                none = pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(np.full(n, row)), part.column("id"), pa.array(np.arange(n)), pa.array(np.diff(text.offsets)), sums(known), sums(base), sums(score), none, none, none], names=names)
                k, d = np.concatenate(keys), np.concatenate(docs).astype(np.uint64)
                both = _pair(k, mixed(d))
                bucket = _bucket(k, parts)
                order = _side_by_side(bucket, k, both)
                first = _firsts(both[order])
                count = np.diff(np.append(first, len(order))).astype(np.uint32)
                order = order[first]
                t = _rows(bucket[order], [k[order], d[order].astype(np.uint32), count])
                m = t.num_rows
                none = [pa.nulls(m, x) for x in (part.column("id").type, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([t.column(0), pa.array(np.full(m, row)), *none, *t.columns[1:]], names=names)

    names = ["bucket", "step", "id", "place", "n_tokens", "known", "base", "score", "key", "doc", "count"]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    return arrow_map(rows, run, f"bucket long, step long, id {id_type}, place long, n_tokens long, known long, base double, score double, key binary, doc binary, count binary")


FOUND = "step long, doc binary, known binary, base binary, score binary"


def _found(rows: DataFrame, lookup: DataFrame, model: Model) -> DataFrame:
    """What the joined keys add to the texts of each step."""
    none = F.lit(b"").alias
    asked = rows.filter("bucket is not null").select("bucket", F.lit(0).cast("long").alias("side"), F.col("step").alias("x"), "key", "doc", "count")
    there = lookup.select("bucket", F.lit(1).cast("long").alias("side"), F.col("kind").alias("x"), "key", F.col("value").alias("doc"), none("count"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _by_side(batches)
        # each row's number (the kind, the step) for all its entries
        numbers = lambda side: _joined([np.repeat(b.column("x").to_numpy(), pc.binary_length(b.column("key")).to_numpy() // 8) for b in sides[side]], I64)
        key, value = _entries(iter(sides[1]), {"key": U64, "doc": F64})
        known = numbers(1) == WORD
        order = _order(_turned(key))
        key, value, known = key[order], value[order], known[order]
        k, doc, n = _entries(iter(sides[0]), {"key": U64, "doc": U32, "count": U32})
        place, step = Index(key).find(k), numbers(0)
        on = place >= 0
        doc, n, place, step = doc[on], n[on], place[on], step[on]
        if not len(doc):
            return
        there = np.unique(step)
        order = _order(np.searchsorted(there, step).astype(np.uint64) << np.uint64(32) | doc)
        doc, n, place, step = doc[order], n[order], place[order], step[order]
        first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (step[1:] != step[:-1])))
        score, known = n * value[place], n * known[place]
        yield _rows(step[first], [doc[first], *(np.add.reduceat(x, first) for x in (known, known * value[place], score))])

    return arrow_map(asked.union(there).repartition(model.parts, "bucket"), run, FOUND)


def _summed(rows: DataFrame, found: DataFrame, model: Model) -> DataFrame:
    """The texts' rows with what was found for them: steps are dealt to tasks."""
    whole = rows.filter("bucket is null").select("step", "id", "place", "n_tokens", "known", "base", "score")
    given = [F.lit(None).cast(whole.schema[c].dataType).alias(c) for c in whole.columns[1:]]
    names = ["docs", "knowns", "bases", "scores"]
    whole = whole.select("*", *(F.lit(None).cast("binary").alias(c) for c in names))
    found = found.select("step", *given, *(F.col(c).alias(x) for c, x in zip(("doc", "known", "base", "score"), names, strict=True)))
    id_type = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, steps_of, docs, parts = [], [], [], [[], [], []]
        for batch in batches:
            own = pc.is_null(batch.column("docs"))
            texts.append(pa.Table.from_batches([batch.filter(own).select(["step", "id", "place", "n_tokens", "known", "base", "score"])]))
            more = batch.filter(pc.invert(own))
            docs.append(_bytes(more.column("docs"), U32).astype(np.int64))
            steps_of.append(np.repeat(more.column("step").to_numpy(), pc.binary_length(more.column("docs")).to_numpy() // 4))
            for into, (c, kind) in zip(parts, (("knowns", I64), ("bases", F64), ("scores", F64)), strict=True):
                into.append(_bytes(more.column(c), kind).copy())
        if not texts:
            return
        t = pa.concat_tables(texts).sort_by([("step", "ascending"), ("place", "ascending")])
        if not t.num_rows:
            return
        step = t["step"].to_numpy()
        new = np.flatnonzero(np.append(True, step[1:] != step[:-1]))
        at = new[np.searchsorted(step[new], np.concatenate(steps_of))] + np.concatenate(docs)
        known, base, score = (t[c].to_numpy() + np.bincount(at, np.concatenate(x), t.num_rows).astype(t[c].to_numpy().dtype) for c, x in zip(("known", "base", "score"), parts, strict=True))
        out = pa.table({"id": t["id"], "n_tokens": t["n_tokens"], "known": known, "base": base, "score": score})
        yield from out.to_batches(max_chunksize=100_000)

    return arrow_map(whole.union(found).repartition(model.parts, "step"), run, f"id {id_type.simpleString()}, n_tokens long, known long, base double, score double")
