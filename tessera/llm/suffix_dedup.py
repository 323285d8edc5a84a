"""Repeated strings across a corpus, by common-prefix intervals of a sparse suffix array.

A text is a row of symbols: its UTF-8 bytes, or its words (hashed to 64 bits).  Every
string of ``length`` symbols that occurs twice holds the same anchor: the least hash of
its k-grams (k = length // 2 + 1), rightmost on ties.  So only suffixes that start at
anchors are looked at, about one in a hundred bytes, and only those whose gram occurs
again.  They are sorted by gram and by what follows, with the common-prefix lengths of
neighbours: an enhanced suffix array.  A stack scan builds its interval tree; each
interval is a string with all its occurrences.  The symbols before the occurrences are
scanned likewise: where occurrences share a stretch to the left, don't all go on alike
before it, and don't all go on alike to the right either, they are a maximal repeat, and
it is given with all its occurrences.  What is removed is the union of these groups.

The array is cut at grams, so gram groups are spread over tasks.  Alike occurrences are
settled before the shuffle, and a gram with more than ``Params.most`` occurrences is not
brought into one task but counted by the hashes of its whole strings.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, coded, hashed, materialize, mixed, release, steps, text_bytes, words_of
from tessera.llm.jaccard_join import _filter_bits, filter_places

STEP = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Params:
    length: int = 400  # symbols
    most: int = 20_000
    words: bool = False  # symbols are words, not bytes

    @property
    def k(self) -> int:
        return self.length // 2 + 1

    @property
    def side(self) -> int:  # symbols of a string outside its anchor's gram
        return self.length - self.k

    @property
    def width(self) -> int:  # bytes of a symbol
        return 8 if self.words else 1


#: Passages of over 50 words.
PASSAGES = Params(51, words=True)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def symbols_of(texts: pa.Array, params: Params) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts in one row, and the n+1 offsets of the texts."""
    if not params.words:
        return text_bytes(texts)
    words, ends = words_of(texts)
    codes, distinct = coded(words)
    return (hashed(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)), ends


_powers_held = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse up to n, for the longest text so far."""
    if len(_powers_held[0]) <= n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, base in enumerate((_BASE, inverse)):
            powers = np.full(1 << max(16, n.bit_length()), base)
            powers[0] = 1
            _powers_held[k] = np.cumprod(powers)
    return _powers_held


def gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams of the symbols ``raw``."""
    if len(raw) < k:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    return mixed((total[k:] - total[:-k]) * down[: len(raw) - k + 1])


def anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of each ``window`` grams, the rightmost on ties."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    place = np.uint64((1 << 34) - 1) - np.arange(len(hashes), dtype=np.uint64)
    key = (hashes >> np.uint64(34) << np.uint64(34)) | place
    padded = np.full(-(-len(key) // window) * window, np.uint64(2**64 - 1))
    padded[: len(key)] = key
    blocks = padded.reshape(-1, window)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[:n], left[window - 1 : window - 1 + n])
    where = (1 << 34) - 1 - (least & np.uint64((1 << 34) - 1)).astype(np.int64)
    return where[np.append(True, where[1:] != where[:-1])]


def anchored(hashes: np.ndarray, at: int, most: int) -> tuple[int, int]:
    """How many grams to the left and to the right of an anchor it stays the least, up to ``most``."""
    top = hashes >> np.uint64(34)
    left, right = top[max(0, at - most) : at][::-1] < top[at], top[at + 1 : at + 1 + most] <= top[at]
    return tuple(int(x.argmax()) if x.any() else len(x) for x in (left, right))


def fingerprint(data: bytes) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_digest(data)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    return n - 1 - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() - 1) // 8


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """Common-prefix intervals (first, last, length) by a stack scan; lcp[i]: of i - 1 and i."""
    stack: list[tuple[int, int]] = []  # length, first
    for i in range(1, len(lcp) + 1):
        here, first = lcp[i] if i < len(lcp) else -1, i - 1
        while stack and stack[-1][0] > here:
            size, first = stack.pop()
            yield first, i - 1, size
        if here >= 0 and (not stack or stack[-1][0] < here):
            stack.append((here, first))


def maximal_groups(rights: list[bytes], lefts: list[bytes], side: int, width: int = 1) -> Iterator[tuple[list[int], int, int]]:
    """(members, symbols before, symbols after their common gram) of each maximal repeat.

    ``rights`` follow the gram, ``lefts`` precede it (nearest symbol first).  A repeat
    counts when the symbols before and after are ``side`` or more together.  Its members
    are all its occurrences; they go on differently both before and after it.
    """
    m = len(rights)
    order = sorted(range(m), key=rights.__getitem__)
    lcp = [0] + [common(rights[order[i - 1]], rights[order[i]]) // width for i in range(1, m)]
    by_left = sorted(range(m), key=lefts.__getitem__)
    rank = [0] * m
    for i, x in enumerate(by_left):
        rank[x] = i
    left = [0] + [common(lefts[by_left[i - 1]], lefts[by_left[i]]) // width for i in range(1, m)]
    left_lcp, lcp_at = np.array(left), np.array(lcp)
    for first, last, after in intervals(lcp):
        need = max(0, side - after)
        if last - first == 1:  # no interval lies within
            x, y = order[first], order[last]
            a, b = sorted((rank[x], rank[y]))
            before = left[b] if b - a == 1 else int(left_lcp[a + 1 : b + 1].min())
            if before >= need:
                yield [x, y], before, after
            continue
        ranks = np.array([rank[x] for x in order[first : last + 1]])
        in_left = np.argsort(ranks)
        at = ranks[in_left]
        # of neighbours in left order: the least common prefix between their ranks
        shared = np.minimum.reduceat(left_lcp, np.ravel(np.column_stack([at[:-1] + 1, at[1:] + 1])).clip(0, m - 1))[::2]
        shared[-1] = left_lcp[at[-2] + 1 : at[-1] + 1].min()
        if shared.max() < need:
            continue
        # members of one child interval go on alike to the right: the child has them
        child = np.append(0, np.cumsum(lcp_at[first + 1 : last + 1] == after))[in_left].tolist()
        members, near = [by_left[r] for r in at.tolist()], [0, *shared.tolist()]
        for lo, hi, before in intervals(near):
            if before >= need and len(set(child[lo : hi + 1])) > 1:
                yield members[lo : hi + 1], before, after


def _scan(docs: DataFrame, params: Params) -> DataFrame:
    """row, id, n_bytes, t1, t2, sha (of the text; null with words), n, f1, f2, grams (of its symbols): what the first reading keeps."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text", STEP):
                raw, ends = text_bytes(part.column("text"))
                data = raw.tobytes()
                texts = [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                own = [fingerprint(t) for t in texts]
                symbols, cuts = symbols_of(part.column("text"), params)
                prints, grams = own if not params.words else [], []
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    if params.words:
                        prints.append(fingerprint(symbols[a:b].tobytes()))
                    h = gram_hashes(symbols[a:b], params.k) if b - a >= params.length else np.zeros(0, np.uint64)
                    grams.append(h[anchors(h, params.side + 1)].view(np.int64))
                bounds = pa.array(np.append(0, np.cumsum([len(g) for g in grams])).astype(np.int32))
                pairs = lambda p: [pa.array([x[k] for x in p], pa.int64()) for k in (0, 1)]
                cols = [part.column("row"), part.column("id"), pa.array(np.diff(ends)), *pairs(own), pa.array([None if params.words else hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(np.diff(cuts)), *pairs(prints), pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(grams)))]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "id", "n_bytes", "t1", "t2", "sha", "n", "f1", "f2", "grams"])

    return arrow_map(docs, run, f"row long, id {id_type}, n_bytes long, t1 long, t2 long, sha string, n long, f1 long, f2 long, grams array<long>")


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return np.all([bits[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1) for p in filter_places(keys, len(bits) * 64)], axis=0).astype(bool)


def _occurrences(docs: DataFrame, params: Params, doc_bits: np.ndarray, gram_bits: np.ndarray, hot_bits: np.ndarray, keep_first: bool = False, settle: bool = True) -> DataFrame:
    """The second reading: f1, f2, and either a settled stretch (start, stop) or an
    occurrence (h, at, before, after) of a gram that occurs again, and whether the gram is hot.
    ``hot_bits`` may call a gram hot that isn't: both ways to treat it give the same.

    With ``settle``, occurrences of one step with equal surroundings settle each other;
    one stands for them in the shuffle (and, with ``keep_first``, isn't settled itself).
    Without it, also lo, hi: how far the gram is the anchor of what surrounds it.
    """
    shared = docs.sparkSession.sparkContext.broadcast((doc_bits, gram_bits, hot_bits))
    k, side, w = params.k, params.side, params.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_bits, gram_bits, hot_bits = shared.value
        for batch in batches:
            for part in steps(batch, "text", STEP):
                texts, cuts = text_bytes(part.column("text"))
                texts = texts.tobytes()
                own = np.fromiter((fingerprint(texts[a:b])[0] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)), np.int64, part.num_rows)
                part = part.filter(pa.array(_has(doc_bits, part.column("key").to_numpy(zero_copy_only=False) ^ own)))
                raw, ends = symbols_of(part.column("text"), params)
                data = raw.tobytes()
                alike: dict[tuple, list[tuple[int, int, int]]] = defaultdict(list)
                done = set()
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    if b - a < params.length:
                        continue
                    f1, f2 = fingerprint(data[a * w : b * w])
                    if (f1, f2) in done:
                        continue
                    done.add((f1, f2))
                    h = gram_hashes(raw[a:b], k)
                    at = anchors(h, side + 1)
                    at = at[_has(gram_bits, h[at].view(np.int64))]
                    for p, x in zip(at.tolist(), h[at].view(np.int64).tolist(), strict=True):
                        p += a
                        around = data[max(a, p - side) * w : p * w], data[(p + k) * w : min(b, p + k + side) * w]
                        alike[(x, *around) if settle else (x, *around, *anchored(h, p - a, side), f1, f2, p)].append((f1, f2, p - a))
                rows = []
                for (x, left, right, *more), found in alike.items():
                    f1, f2, p = found[0]
                    rows.append((f1, f2, None, None, x, p, left, right, *more[:2]))
                    before, after = len(left) // w, len(right) // w
                    if len(found) > 1 and before + after >= side:
                        rows += [(g1, g2, q - before, q + k + after, None, None, None, None) for g1, g2, q in found[keep_first:]]
                if rows:
                    cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                    hot = _has(hot_bits, pc.fill_null(cols[4], 0).to_numpy())
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(hot)], names=[*names, "hot"])

    types = [pa.int64()] * 6 + [pa.binary()] * 2 + [pa.int64()] * 2 * (not settle)
    names = ["f1", "f2", "start", "stop", "h", "at", "before", "after", *["lo", "hi"] * (not settle)]
    schema = ", ".join(f"{n} {'binary' if t == pa.binary() else 'long'}" for n, t in zip(names, types, strict=True))
    return arrow_map(docs, run, f"{schema}, hot boolean")


def _in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each gram, from rows sorted by gram."""
    held, name = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != name:
                if held:
                    yield held
                held, name = [], row[0]
            held.append(row)
    if held:
        yield held


def _grouped(rows: DataFrame, params: Params, keep_first: bool = False, full: bool = False) -> DataFrame:
    """From occurrences h, f1, f2, at, before, after: f1, f2, start, stop of what the
    maximal groups cover around each occurrence; with ``full``, every occurrence of every
    group instead, and the group.  There a group counts only where its string holds all
    that makes the gram an anchor: so the gram is one in all the string's occurrences.  With ``keep_first`` the least occurrence of a group isn't covered by it."""
    k, side = params.k, params.side

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for group in _in_groups(batches):
            group = list({g[1:4]: g for g in group}.values())  # a copy may have been read twice
            if len(group) < 2:
                continue
            # all stretches of a member hold its gram, so together they are one stretch
            reach: dict[int, tuple[int, int]] = {}
            for members, before, after in maximal_groups([g[5] for g in group], [g[4][::-1] for g in group], side, params.width):
                if full:
                    h, _, _, _, left, right, lo, hi = group[members[0]]
                    if min(before, lo) + min(after, hi) < side:
                        continue
                    name = fingerprint(b"%d %s %s" % (h, left[len(left) - before * params.width :], right[: after * params.width]))[0]
                    out += [(*group[x][1:3], group[x][3] - before, group[x][3] + k + after, name) for x in members]
                    continue
                stays = min(members, key=lambda x: group[x][1:4]) if keep_first else -1
                for member in members:
                    if member != stays:
                        b, a = reach.get(member, (0, 0))
                        reach[member] = max(b, before), max(a, after)
            for member, (before, after) in reach.items():
                _, f1, f2, at, *_ = group[member]
                out.append((f1, f2, at - before, at + k + after))
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    names = ["f1", "f2", "start", "stop", *["group"] * full]
    dealt = rows.select("h", "f1", "f2", "at", "before", "after", *["lo", "hi"] * full).repartition("h").sortWithinPartitions("h")
    return arrow_map(dealt, run, ", ".join(f"`{n}` long" for n in names))


def _hot(rows: DataFrame, params: Params, keep_first: bool = False, full: bool = False) -> DataFrame:
    """The same for grams with very many occurrences: strings are counted by their hashes
    (with ``full``, the groups are the strings of ``length`` symbols).  A string's rows are
    the large side of an inner join, which Spark divides where they are many."""
    side, w = params.side, params.width
    before, after = F.expr(f"length(before) div {w}"), F.expr(f"length(after) div {w}")
    texts = rows.withColumn("b", F.greatest(F.lit(0).cast("long"), F.lit(side) - after))
    texts = texts.filter(F.col("b") <= before).withColumn("b", F.explode(F.sequence("b", before)))
    if full:
        texts = texts.filter(f"b <= lo and {side} - b <= hi")
    string = F.concat(F.expr(f"substring(before, length(before) - cast(b as int) * {w} + 1, cast(b as int) * {w})"), F.expr(f"substring(after, 1, ({side} - cast(b as int)) * {w})"))
    texts = texts.select("h", "b", "f1", "f2", "at", F.xxhash64(string).alias("s1"), F.crc32(string).alias("s2"))
    who = F.struct("f1", "f2", "at")
    string_of = ["h", "b", "s1", "s2"]
    twice = texts.groupBy(*string_of).agg(F.min(who).alias("x"), F.max(who).alias("y")).filter("x <> y").select(*string_of, "x")
    found = texts.join(twice, string_of).withColumn("start", F.col("at") - F.col("b"))
    if keep_first:
        found = found.filter(who != F.col("x"))
    if full:
        return found.select("f1", "f2", "start", (F.col("start") + params.length).alias("stop"), F.xxhash64(*string_of).alias("group"))
    # strings around one gram overlap in it
    return found.groupBy("f1", "f2", "at").agg(F.min("start").alias("start"), (F.max("start") + params.length).alias("stop")).select("f1", "f2", "start", "stop")


def _indexed(docs: DataFrame, id_col: str, text_col: str, params: Params, **reading) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """The first reading, its classes of equal texts, the second reading, and whether it has hot grams."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    rows = rows.select("id", "text", F.monotonically_increasing_id().alias("row"), F.xxhash64("id").alias("key"))
    scanned = materialize(_scan(rows.select("row", "id", "text"), params), "op10-scan")
    classes = scanned.filter(F.col("n") >= params.length).groupBy("f1", "f2").agg(F.min("row").alias("row"), F.count("*").alias("copies"))
    classes = materialize(classes, "op10-classes")
    firsts = scanned.select("row", "id", "t1", "grams").join(classes.select("row"), "row", "left_semi")
    found = materialize(firsts.select("row", F.explode("grams").alias("h")), "op10-grams")
    again = materialize(found.groupBy("h").agg(F.count("*").alias("times")).filter("times > 1"), "op10-again")
    holders = found.join(again, "h", "left_semi").select("row").distinct()
    keys = materialize(firsts.join(holders, "row", "left_semi").select(F.expr("t1 ^ xxhash64(id)").alias("key")), "op10-keys")
    release(found)
    doc_bits = _filter_bits(keys, keys.count())
    release(keys)
    gram_bits = _filter_bits(again.select(F.col("h").alias("key")), again.count())
    hot = again.filter(F.col("times") > params.most).select(F.col("h").alias("key"))
    hot_grams = hot.count()
    hot_bits = _filter_bits(hot, hot_grams)
    release(again)
    seen = materialize(_occurrences(rows.select("key", "text"), params, doc_bits, gram_bits, hot_bits, **reading), "op10-seen")
    return scanned, classes, seen, hot_grams > 0


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", params: Params = Params(), keep_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """What to remove: a row for each document (row, id, n_bytes, t1, t2, sha, n, f1, f2,
    copied), and the repeated stretches (f1, f2, spans: array of start, stop in no order,
    may overlap) of texts that aren't copied whole, in symbols.

    t1, t2: 128-bit hash of the text; f1, f2: of its symbols.  copied: another document
    has the same symbols, ``length`` or more of them, so all of it is repeated.  With
    ``keep_first`` nothing is copied, and of each repeated string one occurrence stays.
    """
    scanned, classes, seen, any_hot = _indexed(docs, id_col, text_col, params, keep_first=keep_first)
    open_ = seen.filter("h is not null").select("h", "f1", "f2", "at", "before", "after", "hot")
    stretches = seen.filter("h is null").select("f1", "f2", "start", "stop").union(_grouped(open_.filter("not hot"), params, keep_first))
    if any_hot:
        stretches = stretches.union(_hot(open_.filter("hot"), params, keep_first))
    whole = classes.select("f1", "f2", ((F.col("copies") > 1) & F.lit(not keep_first)).alias("copied"))
    spans = stretches.join(whole.filter("not copied"), ["f1", "f2"], "left_semi").groupBy("f1", "f2").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    marked = scanned.drop("grams").join(whole, ["f1", "f2"], "left").withColumn("copied", F.coalesce("copied", F.lit(False)) & (F.col("n") >= params.length))
    return marked, spans


def repeat_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", params: Params = Params()) -> DataFrame:
    """Every maximal repeat with all its occurrences: group, ``id_col``, start, stop (in symbols), n_occurrences.

    Seen from an anchor, strings reach ``length - k`` symbols to either side, so a longer
    repeat comes as one group for each of its anchors.  Of a gram with over
    ``params.most`` occurrences, the groups are its strings of ``length`` symbols.  All
    copies of a text have its occurrences; texts without repeats, null and empty ones have
    none.  A text that only occurs in copies has the group of the whole text.
    """
    scanned, classes, seen, any_hot = _indexed(docs, id_col, text_col, params, settle=False)
    found = _grouped(seen.filter("not hot").drop("hot"), params, full=True)
    if any_hot:
        found = found.unionByName(_hot(seen.filter("hot"), params, full=True))
    found = found.distinct()
    n = scanned.filter(F.col("n") >= params.length).select("f1", "f2", "n").distinct()
    alone = classes.filter("copies > 1").join(n, ["f1", "f2"]).select("f1", "f2", F.lit(0).cast("long").alias("start"), F.col("n").alias("stop"), F.xxhash64("f1", "f2").alias("group"))
    found = found.unionByName(alone)
    members = scanned.select("row", F.col("id").alias(id_col), "f1", "f2")
    here = materialize(found.join(members, ["f1", "f2"]), "op10-groups")
    return here.join(here.groupBy("group").agg(F.count("*").alias("n_occurrences")), "group").select("group", id_col, "start", "stop", "n_occurrences")


def text_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", params: Params = Params(), keep_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """The marked documents of ``repeats``, and t1, t2, spans (in symbols) of every distinct text with something to remove."""
    marked, spans = repeats(docs, id_col=id_col, text_col=text_col, params=params, keep_first=keep_first)
    if params.words:  # texts of the same words may differ in case and white space
        texts = marked.filter("not copied and n >= %d" % params.length).select("t1", "t2", "f1", "f2").distinct()
        spans = texts.join(spans, ["f1", "f2"]).select("t1", "t2", "spans")
    else:
        spans = spans.withColumnsRenamed({"f1": "t1", "f2": "t2"})
    copied = marked.filter("copied").select("t1", "t2", "n").distinct()
    return marked, spans.unionByName(copied.select("t1", "t2", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("stop"))).alias("spans")))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint, ordered stretches that cover the same bytes (touching ones joined)."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut_out(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def word_bytes(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte stretches of spans of words: each with the white space behind it."""
    at = [m.start() for m in _WORD.finditer(data)] + [len(data)]
    return [(at[a], at[b]) for a, b in spans]


def _affected(docs: DataFrame, spans: DataFrame, text_col: str) -> DataFrame:
    """Columns c0, c1 ... of the documents with t1, t2, and ``maybe``: whether a filter of the spans' keys lets them through."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter_bits(spans.select(F.col("t1").alias("key")), spans.count()))
    names = [f"c{k}" for k in range(len(docs.columns))]
    text = f"c{docs.columns.index(text_col)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, text, STEP):
                prints = [fingerprint((t or "").encode()) for t in part.column(text).to_pylist()]
                t1 = np.array([p[0] for p in prints], np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(t1), pa.array([p[1] for p in prints], pa.int64()), pa.array(_has(bits.value, t1))], names=[*names, "t1", "t2", "maybe"])

    fields = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema.fields))
    return arrow_map(docs.toDF(*names), run, f"{fields}, t1 long, t2 long, maybe boolean")


def _covered(spans: DataFrame) -> DataFrame:
    """t1, t2, gone, runs: symbols covered by the spans of each text, and maximal runs of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [merged([(x["start"], x["stop"]) for x in s]) for s in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("t1"), batch.column("t2"), pa.array([sum(b - a for a, b in r) for r in runs], pa.int64()), pa.array([len(r) for r in runs], pa.int64())], names=["t1", "t2", "gone", "runs"])

    return arrow_map(spans, run, "t1 long, t2 long, gone long, runs long")


def digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", params: Params = Params(), passages: Params = PASSAGES) -> DataFrame:
    """A row for each document: ``id_col``, n_bytes, n_removed, n_spans, kept_sha256, and
    passage_words, n_passages.

    Every byte covered by a string of ``params.length`` bytes that also starts anywhere
    else is removed; strings are judged on the input.  Null, empty and shorter texts
    lose nothing.  Repeated rows are copies of each other.  Very long texts are read
    whole.  An empty table gives no rows; other columns, whatever their names, are not read.
    passage_words and n_passages tell of words what n_removed and n_spans tell of bytes,
    for strings of ``passages.length`` words; nothing is removed for them.
    """
    _, in_words = text_spans(docs, id_col=id_col, text_col=text_col, params=passages)
    in_words = materialize(_covered(in_words).select("t1", "t2", F.col("gone").alias("passage_words"), F.col("runs").alias("n_passages")), "op10-passages")
    marked, spans = repeats(docs, id_col=id_col, text_col=text_col, params=params)
    spans = materialize(spans.withColumnsRenamed({"f1": "t1", "f2": "t2"}), "op10-spans")
    texts = _affected(docs.select(docs[text_col].alias("text")), spans, "text").filter("maybe").select("t1", "t2", F.col("c0").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data, s = t.encode(), merged([(x["start"], x["stop"]) for x in s])
                rows.append((sum(b - a for a, b in s), len(s), hashlib.sha256(cut_out(data, s)).hexdigest()))
            cols = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("t1"), batch.column("t2"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True))], names=["t1", "t2", "gone", "runs", "kept"])

    cut = arrow_map(texts.join(spans, ["t1", "t2"]).select("t1", "t2", "text", "spans"), run, "t1 long, t2 long, gone long, runs long, kept string")
    out = marked.join(cut, ["t1", "t2"], "left").join(in_words, ["t1", "t2"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    pick = lambda copied, some, none: F.when(F.col("copied"), copied).when(F.col("gone").isNotNull(), some).otherwise(none)
    zero = F.lit(0).cast("long")
    return out.select(
        F.col("id").alias(id_col), "n_bytes", pick(F.col("n"), F.col("gone"), zero).alias("n_removed"), pick(F.lit(1).cast("long"), F.col("runs"), zero).alias("n_spans"), pick(F.lit(empty), F.col("kept"), F.col("sha")).alias("kept_sha256"),
        F.coalesce("passage_words", zero).alias("passage_words"), F.coalesce("n_passages", zero).alias("n_passages"),
    )


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", params: tuple[Params, ...] = (Params(),), keep_first: bool = False) -> DataFrame:
    """The documents without what any of ``params`` finds repeated, all columns kept.

    All strings are judged on the input.  A character that a cut divides goes whole; cut
    words go with the white space behind them.  With ``keep_first`` one occurrence of
    each repeated string stays, and copies of whole texts are no repeats of each other.
    Documents without repeats, null and empty texts are returned unchanged; repeated rows
    are copies; very long texts are read whole; columns may have any names; an empty
    table stays empty.
    """
    found = None
    for p in params:
        _, spans = text_spans(docs, id_col=id_col, text_col=text_col, params=p, keep_first=keep_first)
        none = F.lit(None).cast("array<struct<start: long, stop: long>>")
        spans = spans.select("t1", "t2", *[F.col("spans").alias(c) if p.words == w else none.alias(c) for c, w in (("bytes", False), ("words", True))])
        found = spans if found is None else found.unionByName(spans)
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    spans = materialize(found.groupBy("t1", "t2").agg(flat("bytes"), flat("words")), "op10-spans")
    known = _affected(docs, spans, text_col)
    names = [f"c{k}" for k in range(len(docs.columns))]
    text = f"c{docs.columns.index(text_col)}"
    clean = known.filter("not maybe").select(*names)
    joined = known.filter("maybe").join(spans, ["t1", "t2"], "left").select(*names, "bytes", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for t, *both in zip(batch.column(text).to_pylist(), batch.column("bytes").to_pylist(), batch.column("words").to_pylist(), strict=True):
                by_byte, by_word = ([(x["start"], x["stop"]) for x in s or []] for s in both)
                if by_byte or by_word:
                    data = t.encode()
                    t = cut_out(data, merged(by_byte + word_bytes(data, merged(by_word)))).decode("utf-8", "ignore")
                texts.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text else batch.column(c) for c in names], names=names)

    fields = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema.fields))
    return clean.unionByName(arrow_map(joined, run, fields)).toDF(*docs.columns)
