"""N-gram Jaccard join by prefix trees, with the linked documents' components.

A document's set holds the 64-bit hashes of its distinct word shingles.  Equal sets are
one class from the start.  A class whose set has n members can be linked only if it
shares at least ceil(t n) of them, so with n - ceil(t n) + 1 members that no other class
has it is settled.  That test runs twice: over the least hashes of every class (cheap,
settles most), then over all members of the unsettled ones.  The rest is put in the
global order - rare members first - and two classes can only be linked when they share
a member of their prefixes; classes joined by such members form a family.

Within a family the sets are stored as a trie, commonest members first, so that like
sets share a path.  All probes of a block go down the trie together, their overlaps are
counted once for each shared edge, and a subtree is left when the members that remain in
it cannot lift an overlap to the bound.  Large families are cut into blocks by length
and hash, and pairs of blocks are tasks of their own: every pair is still compared, but
no task holds more than two blocks.  Tasks return the links as a spanning forest, never
all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, coded, hashed, materialize, mixed, release, steps, words_of
from tessera.llm.components import components

BLOCK_SETS, BLOCK_MEMBERS = 512, 150_000  # of one block
SALTS = 32
MOST_BITS = 1 << 26  # of the filter that spares settled documents a second reading (8 MB)


@dataclass(frozen=True)
class Params:
    shingle: int = 4
    percent: int = 85  # links from this Jaccard similarity, in hundredths


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Of each text: the sorted distinct hashes of its k-word shingles.

    With fewer words the whole sequence is the only shingle; without words there is none.
    """
    words, ends = words_of(texts)
    codes, distinct = coded(words)
    h = hashed(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    rolled = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for i in range(k):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(rolled)]
    rolled = mixed(rolled).view(np.int64)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for at in range(a, b):
                whole = mixed(whole * np.uint64(0xC2B2AE3D27D4EB4F) + h[at : at + 1])
            out.append(whole.view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def _fingerprint(members: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_digest(members.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _prefix(n, percent: int):
    """n - ceil(t n) + 1, for numbers, arrays and columns."""
    return n - (n * percent + 99) // 100 + 1


def _least_kept(n: int, percent: int) -> int:
    """How many of its n members a class keeps in the first reading.

    Members that a linked class has but didn't keep count as its own there.  By the sizes
    of both and their least overlap they, and those it has alone, stay below the prefix's
    length: with half of it rounded down, a class of prefix 2 can be settled wrongly.
    """
    return min(n, (3 * _prefix(n, percent) + 1) // 2 + 4)


def _sets(docs: DataFrame, params: Params, lowest: bool, bits: np.ndarray | None = None) -> DataFrame:
    """row, id, n, f1, f2, members of each document; only the least members with ``lowest``,
    only documents that ``bits`` may hold (by the hash of their id)."""
    id_type = docs.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            if bits is not None:
                at = filter_places(batch.column("key").to_numpy(zero_copy_only=False), len(bits) * 64)
                held = np.all([bits[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1) for p in at], axis=0)
                batch = batch.filter(pa.array(held.astype(bool)))
            for part in steps(batch, "text"):
                sets = shingle_sets(part.column("text"), params.shingle)
                n = np.array([len(s) for s in sets], np.int64)
                rows = part.column("row").to_pylist()
                # sets without members belong to no class; a value of the row's own keeps them apart
                prints = [_fingerprint(s if len(s) else np.array([r, -1])) for s, r in zip(sets, rows, strict=True)]
                if lowest:
                    sets = [s[: _least_kept(len(s), params.percent)] for s in sets]
                ends = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
                members = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), pa.array(n), pa.array([f[0] for f in prints], pa.int64()), pa.array([f[1] for f in prints], pa.int64()), members], names=["row", "id", "n", "f1", "f2", "members"])

    return arrow_map(docs, run, f"row long, id {id_type}, n long, f1 long, f2 long, members array<long>")


def filter_places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    k = keys.astype(np.int64).view(np.uint64)
    return [(k % np.uint64(bits)).astype(np.int64), (mixed(k) % np.uint64(bits)).astype(np.int64)]


def _filter_bits(keys: DataFrame, count: int) -> np.ndarray:
    """A Bloom filter of the keys: 16 bits for each, ``MOST_BITS`` at most."""
    bits = 1 << 16
    while bits < min(16 * count, MOST_BITS):
        bits *= 2

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in filter_places(batch.column(0).to_numpy(zero_copy_only=False), bits):
                yield pa.RecordBatch.from_arrays([pa.array(p)], names=["place"])

    words = arrow_map(keys, places, "place long").groupBy(F.shiftright("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("ones")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["ones"].to_numpy(np.int64).view(np.uint64)
    return out


def trie_links(sets: list[np.ndarray], probes: np.ndarray, stored: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs (probe, stored) whose Jaccard similarity reaches ``percent``, as numbers of ``sets``.

    The stored sets form a trie, path by path of their sorted sequences; the overlap of
    every probe with a path is kept as one array and goes on to the subtrees.
    """
    size = np.array([len(s) for s in sets], np.int64)
    members, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.flatnonzero(count > 1)  # members of one set alone add to no overlap
    rank = np.full(len(members), -1, np.int64)
    rank[common[np.lexsort((members[common], -count[common]))]] = np.arange(len(common))
    split = np.split(rank[code], np.cumsum(size)[:-1])
    paths = [np.sort(r[r >= 0]) for r in split]
    has = np.zeros((len(common), len(probes)), np.uint8)
    for k, x in enumerate(probes):
        has[paths[x], k] = 1
    order = sorted(stored, key=lambda y: paths[y].astype(">u4").tobytes())
    seq, sizes = [paths[y] for y in order], size[order]
    shared = np.zeros(len(order) + 1, np.int64)  # shared[i]: length of the path common to i - 1 and i
    for i in range(1, len(order)):
        m = min(len(seq[i - 1]), len(seq[i]))
        differ = np.flatnonzero(seq[i - 1][:m] != seq[i][:m])
        shared[i] = differ[0] if len(differ) else m
    found = []
    todo = [(0, len(order), 0, np.arange(len(probes)), np.zeros(len(probes), np.int64))]
    while todo:
        lo, hi, depth, who, overlap = todo.pop()
        stop = len(seq[lo]) if hi - lo == 1 else int(shared[lo + 1 : hi].min())
        if stop > depth:
            overlap = overlap + has[np.ix_(seq[lo][depth:stop], who)].sum(axis=0, dtype=np.int64)
        n = size[probes[who]]
        if hi - lo == 1:
            y = order[lo]
            for k in np.flatnonzero(overlap * (100 + percent) >= percent * (n + sizes[lo])):
                if probes[who[k]] != y:
                    found.append((int(probes[who[k]]), int(y)))
            continue
        # the best any set below can do: all that remains of the longest path, against the smallest set
        longest = max(len(seq[i]) for i in range(lo, hi)) - stop
        alive = (overlap + longest) * (100 + percent) >= percent * (n + sizes[lo:hi].min())
        if not alive.any():
            continue
        who, overlap = who[alive], overlap[alive]
        cuts = [lo, *(i for i in range(lo + 1, hi) if shared[i] == stop), hi]
        todo += [(a, b, stop, who, overlap) for a, b in zip(cuts, cuts[1:], strict=False)]
    return found


def spanning(links: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """The links that first join two parts."""
    parent = list(range(n))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in links:
        x, y = top(a), top(b)
        if x != y:
            parent[x] = y
            out.append((a, b))
    return out


def _family_links(families: DataFrame, params: Params) -> DataFrame:
    """a, b: links between classes, from family, class, n, members."""
    # a link's sizes are less than a band apart, so its bands are equal or neighbours
    band = F.floor(F.log("n") / F.log(F.lit(100 / (params.percent - 1)))).cast("int")
    light = families.select("family", "class", "n").withColumns({"band": band, "salt": F.pmod(F.xxhash64("class"), F.lit(SALTS)).cast("int")})
    sizes = light.groupBy("family", "band").agg(F.sum("n").alias("members"), F.count("*").alias("sets"))
    whole = sizes.groupBy("family").agg(((F.sum("members") <= BLOCK_MEMBERS) & (F.sum("sets") <= BLOCK_SETS)).alias("small"))
    sizes = sizes.withColumn("blocks", F.greatest(F.ceil(F.col("members") / BLOCK_MEMBERS), F.ceil(F.col("sets") / BLOCK_SETS)).cast("int")).join(whole, "family")
    after = sizes.select("family", (F.col("band") - 1).alias("band"), F.col("blocks").alias("blocks_after"))
    before = sizes.select("family", (F.col("band") + 1).alias("band"), F.col("blocks").alias("blocks_before"))
    sizes = sizes.join(after, ["family", "band"], "left").join(before, ["family", "band"], "left").drop("members", "sets")
    # a small family is one task; of a large one the rows are dealt over salts, without their members
    one = lambda c, n: F.when(F.col("small"), n).otherwise(F.coalesce(c, F.lit(0))).alias(c)
    sizes = sizes.select("family", "band", "small", one("blocks", 1), one("blocks_after", 0), one("blocks_before", 0), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = light.join(sizes, ["family", "band", "salt"]).withColumn("band", F.expr("if(small, 0, band)")).withColumn("block", F.pmod(F.xxhash64("class"), "blocks").cast("int"))
    none = F.array().cast("array<int>")
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(none)
    task = lambda b1, i, b2, j, side: F.struct(b1.cast("int").alias("b1"), i.alias("i"), b2.cast("int").alias("b2"), j.alias("j"), F.lit(side).alias("side"))
    b, i = F.col("band"), F.col("block")
    tasks = F.concat(
        F.transform(F.filter(upto("blocks"), lambda j: j >= i), lambda j: task(b, i, b, j, 0)),
        F.transform(F.filter(upto("blocks"), lambda j: j < i), lambda j: task(b, j, b, i, 1)),
        F.transform(upto("blocks_after"), lambda j: task(b, i, b + 1, j, 0)),
        F.transform(upto("blocks_before"), lambda j: task(b - 1, j, b, i, 1)),
    )
    dealt = rows.select("family", "class", F.explode(tasks).alias("task")).select("family", "class", "task.*").join(families.select("class", "members"), "class")
    percent = params.percent

    def join(group: pa.Table) -> pa.Table:
        names, side = group["class"].to_numpy(), group["side"].to_numpy()
        lists = group["members"].combine_chunks()
        flat, ends = lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
        sets = [flat[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)]
        if side.any():
            links = trie_links(sets, np.flatnonzero(side == 0), np.flatnonzero(side == 1), percent) if not side.all() else []
        elif group["b1"][0] == group["b2"][0] and group["i"][0] == group["j"][0]:
            links = trie_links(sets, np.arange(len(sets)), np.arange(len(sets)), percent)
        else:  # the other block is empty
            links = []
        kept = spanning(links, len(sets))
        return pa.table({"a": pa.array([names[x] for x, _ in kept], pa.int64()), "b": pa.array([names[y] for _, y in kept], pa.int64())})

    return dealt.groupBy("family", "b1", "i", "b2", "j").applyInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", params: Params = Params()) -> DataFrame:
    """A row for each document: ``id_col``, n_shingles, component_id.

    component_id: the least id that is reachable by links, the document's own included;
    equal sets are linked.  Null and empty texts have no shingle and are linked with
    nothing.  Repeated rows are kept and share a component.  Very long texts are compared
    whole.  An empty table gives no rows; other columns are not read.  Members are 64-bit
    hashes: two different shingles count as one with a chance of 2**-64 for each pair.
    A null id is an id like others.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    rows = rows.select("id", "text", F.monotonically_increasing_id().alias("row"), F.xxhash64("id").alias("key"))
    meta = materialize(_sets(rows, params, lowest=True), "op8-low")
    classes = meta.filter("n > 0").groupBy("f1", "f2").agg(F.max("n").alias("n"), F.min("row").alias("class"), F.min("id").alias("least_id"))
    classes = materialize(classes, "op8-classes")
    p = F.expr(f"n - (n * {params.percent} + 99) div 100 + 1")
    # members of one class alone, among the least hashes of all
    own = meta.filter("n > 0").select(F.explode("members").alias("h"), "f1").groupBy("h").agg(F.min("f1").alias("f1"), F.max("f1").alias("other")).filter("f1 = other")
    own = own.groupBy("f1").agg(F.count("*").alias("own"))
    unsettled = classes.join(own, "f1", "left").filter(F.coalesce("own", F.lit(0)) < p).select("f1", "f2", "class", "least_id")
    unsettled = materialize(unsettled, "op8-unsettled")
    bits = _filter_bits(unsettled.select(F.xxhash64("least_id").alias("key")), unsettled.count())
    again = _sets(rows, params, lowest=False, bits=bits)
    sets = again.join(unsettled, ["f1", "f2"]).filter(F.col("id").eqNullSafe(F.col("least_id"))).dropDuplicates(["f1", "f2"]).select("class", "n", "members")
    sets = materialize(sets, "op8-sets")
    release(unsettled)
    members = sets.select("class", "n", F.explode("members").alias("h"))
    df = members.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    mine = members.join(df, "h").groupBy("class", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("shared"))
    open_ = p - (F.col("n") - F.size("shared"))  # prefix members that others have too
    prefix = mine.withColumn("open", open_.cast("int")).filter("open > 0").select("class", F.explode(F.slice("shared", F.lit(1), F.col("open"))).alias("x")).select("class", F.col("x.h").alias("h"))
    prefix = materialize(prefix, "op8-prefix")
    center = prefix.groupBy("h").agg(F.min("class").alias("center"), F.count("*").alias("size")).filter("size > 1")
    families = components(prefix.join(center, "h").filter("class <> center").select("class", "center").distinct(), "class", "center")
    families = materialize(sets.join(families.select(F.col("node").alias("class"), F.col("root").alias("family")), "class"), "op8-families")
    release(prefix)
    release(sets)
    links = materialize(_family_links(families, params), "op8-links")
    release(families)
    roots = components(links, "a", "b").select(F.col("node").alias("class"), "root")
    joined = classes.join(roots, "class", "left").select("f1", "f2", "least_id", F.coalesce("root", "class").alias("root"))
    least = joined.groupBy("root").agg(F.min("least_id").alias("component"))
    of = joined.join(least, "root").select("f1", "f2", "component")
    out = meta.select("id", "n", "f1", "f2").join(of, ["f1", "f2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
