"""Sharding by a k-d tree over document metadata.

Each document is a point: size (logarithmic), source, language.  A node that is to
become k leaves is split along its widest dimension at the weighted median (the
kl / k quantile of the bytes, kl = k // 2), until every leaf has the target bytes.

The medians are found distributedly: all nodes of a level sum their bytes by 1,024 bins
of the key range, and only the bin that holds the quantile is refined, until a cut is
within ``TOLERANCE`` of its target.  The driver sees at most shards x 1,024 sums a pass.
Documents of equal text share their coordinates and stay in one shard.  Only a group
with more bytes than a whole shard's share is dealt into parts, and cuts may divide it.
Where such a group keeps the widest dimension's cut over ``BALANCED`` off its target, the
other dimensions are tried too and the nearest cut is taken.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import materialize, release

OVERHEAD = 16  # bytes of a row beside its text
BINS = 1024
SUBS = 1024  # parts that a large group of equal texts is dealt into
TOLERANCE = 0.0005  # of a shard's bytes
BALANCED = 0.02  # of a shard's bytes
DIMENSIONS = ("size_at", "source_at", "lang_at")


@dataclass
class Node:
    first: int  # leaf numbers first .. first + leaves - 1
    leaves: int
    dimension: str = ""
    cut: int = 0
    left: "Node | None" = None
    right: "Node | None" = None


def _place(node: Node) -> Column:
    """The number of the node (or leaf) that a row falls into."""
    if node.left is None:
        return F.lit(node.first)
    return F.when(F.col(node.dimension) < F.lit(node.cut), _place(node.left)).otherwise(_place(node.right))


def _split_level(items: DataFrame, root: Node, todo: list[Node], widths: dict[str, int], goal: float) -> None:
    placed = items.withColumn("node", _place(root))
    found = placed.groupBy("node").agg(F.sum("bytes").alias("bytes"), *[f(d).alias(f"{d}_{f.__name__}") for d in DIMENSIONS for f in (F.min, F.max)])
    state, wanted = {}, {n.first for n in todo}
    for r in found.collect():
        if r["node"] not in wanted:
            continue
        # the upper bits of a key are the coordinate; its lower ones only break ties
        spread = {d: ((r[f"{d}_max"] >> 31) - (r[f"{d}_min"] >> 31)) / max(1, widths[d]) for d in DIMENSIONS}
        others = sorted(DIMENSIONS, key=lambda x: -spread[x])
        ends = {d: (r[f"{d}_min"], r[f"{d}_max"]) for d in DIMENSIONS}
        d = others.pop(0)
        state[r["node"]] = {"d": d, "lo": ends[d][0], "hi": ends[d][1], "bytes": r["bytes"], "below": 0, "others": others, "ends": ends, "cuts": []}
    for n in todo:
        if n.first not in state:  # no rows: any cut will do
            state[n.first] = {"d": DIMENSIONS[0], "lo": 0, "hi": 0, "bytes": 0, "below": 0, "cut": 0}
        s = state[n.first]
        s["want"] = s["bytes"] * (n.leaves // 2) / n.leaves
    while open_ := {k: s for k, s in state.items() if "cut" not in s}:
        for s in open_.values():
            s["width"] = (s["hi"] - s["lo"]) // BINS + 1
        if len(open_) == 1:
            (k, s), = open_.items()
            rows = placed.filter(F.col("node") == k).withColumns({"dimension": F.lit(s["d"]), "low": F.lit(s["lo"]).cast("long"), "width": F.lit(s["width"]).cast("long")})
        else:  # one row for each node of the level, fewer than the shards: small whatever the input
            asked = items.sparkSession.createDataFrame([(k, s["d"], s["lo"], s["width"]) for k, s in open_.items()], "node int, dimension string, low long, width long")
            rows = placed.join(F.broadcast(asked), "node")
        key = F.coalesce(*[F.when(F.col("dimension") == d, F.col(d)) for d in DIMENSIONS])
        rows = rows.withColumn("key", key).filter("key >= low").withColumn("bin", F.expr("(key - low) div width")).filter(F.col("bin") < BINS)
        sums: dict[int, dict[int, int]] = {}
        for r in rows.groupBy("node", "bin").agg(F.sum("bytes").alias("bytes")).collect():
            sums.setdefault(r["node"], {})[r["bin"]] = r["bytes"]
        for k, s in open_.items():
            below = s["below"]
            for b in sorted(sums[k]):
                if below + sums[k][b] >= s["want"]:
                    break
                below += sums[k][b]
            # candidates: before and after bin b; finer if both are off and the bin can be divided
            before, after = s["want"] - below, below + sums[k][b] - s["want"]
            if min(before, after) <= TOLERANCE * goal or s["width"] == 1:
                s["cuts"].append((min(before, after), s["d"], s["lo"] + s["width"] * (b + (after < before))))
                if min(before, after) > BALANCED * goal and s["others"]:
                    s["d"], s["below"] = s["others"].pop(0), 0
                    s["lo"], s["hi"] = s["ends"][s["d"]]
                else:
                    _, s["d"], s["cut"] = min(s["cuts"], key=lambda x: x[0])  # of equal ones the widest dimension's
            else:
                s["below"], s["lo"] = below, s["lo"] + s["width"] * b
                s["hi"] = s["lo"] + s["width"] - 1
    for n in todo:
        s, k = state[n.first], n.leaves // 2
        n.dimension, n.cut = s["d"], s["cut"]
        n.left, n.right = Node(n.first, k), Node(n.first + k, n.leaves - k)


def grow_tree(items: DataFrame, shards: int) -> Node:
    """The tree over rows of bytes and keys (``DIMENSIONS``)."""
    root = Node(0, shards)
    total = items.agg(F.sum("bytes").alias("bytes"), *[(F.max(F.shiftright(d, 31)) - F.min(F.shiftright(d, 31))).alias(d) for d in DIMENSIONS]).first()
    widths, goal = {d: total[d] or 0 for d in DIMENSIONS}, (total["bytes"] or 0) / shards
    level = [root]
    while todo := [n for n in level if n.leaves > 1]:
        _split_level(items, root, todo, widths, goal)
        level = [x for n in todo for x in (n.left, n.right)]
    return root


def shard(docs: DataFrame, *, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """Put every row into a shard: ``id_col``, size, text_crc32, shard, slot.

    size: UTF-8 bytes of the text plus 16.  slot: 0, 1, ... without gaps in each shard,
    by id within buckets of rows.  Null and empty texts have size 16 and count as equal;
    null source or language is a coordinate of its own.  Repeated rows are kept, each in
    a slot of its own.  Very long texts weigh what they weigh: a row is never divided.
    Equal texts share a shard unless together they exceed a shard's share of the bytes.
    Ties of a coordinate are ordered by a hash of the text.  An empty table gives no
    rows.  Other columns, whatever their names, are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    named = lambda c: F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.shiftright(F.crc32(F.col(c)), 1))
    meta = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[source_col].cast("string").alias("source"), docs[lang_col].cast("string").alias("lang")).select(
        "id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("hash"), F.pmod(F.xxhash64("id"), F.lit(SUBS)).cast("int").alias("sub"), named("source").alias("source"), named("lang").alias("lang"),
    )
    meta = materialize(meta, "op6-meta")
    group = ["hash", "crc", "size"]
    parts = meta.groupBy(*group, "sub").agg(F.sum("size").alias("bytes"), F.min("source").alias("source"), F.min("lang").alias("lang"))
    whole = parts.groupBy(*group).agg(F.sum("bytes").alias("all_bytes"), F.min("source").alias("source"), F.min("lang").alias("lang"))
    most = (meta.agg(F.sum("size")).first()[0] or 0) / shards
    items = parts.drop("source", "lang").join(whole, group)
    # 62-bit keys: 31 bits of coordinate, 20 of the text's hash, 11 of the part of a large group
    tie = F.expr("shiftright(hash, 44) & 1048575") * 2048 + F.when(F.col("all_bytes") > most, F.col("sub")).otherwise(0)
    size_at = F.floor(F.log2("size") * (1 << 24)).cast("long")  # log2 < 64 fits 31 bits
    key = lambda at: F.shiftleft(at.cast("long"), 31) + tie
    items = items.select(*group, "sub", "bytes", key(size_at).alias("size_at"), key(F.col("source")).alias("source_at"), key(F.col("lang")).alias("lang_at"))
    items = materialize(items, "op6-items")
    root = grow_tree(items, shards)
    placed = meta.join(items.select(*group, "sub", _place(root).alias("shard")), [*group, "sub"])
    placed = materialize(placed.select("id", "size", "crc", "shard"), "op6-placed")
    release(items)
    buckets = max(1, meta.count() // (shards * 1000))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(buckets)))
    sizes = placed.groupBy("shard", "bucket").count()
    before = sizes.withColumn("before", F.sum("count").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("count")).drop("count")
    numbered = placed.withColumn("nth", F.row_number().over(W.partitionBy("shard", "bucket").orderBy("id")) - 1)
    return numbered.join(before, ["shard", "bucket"]).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("nth")).cast("long").alias("slot"))
