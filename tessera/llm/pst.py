"""Language-model scoring by a probabilistic suffix tree over words.

The root is the add-one unigram model of all training tokens.  Level by level, a context
(the last d words) becomes a candidate when its share of the training tokens is
``Params.context`` or more and its suffix is in the tree; it is kept when its next-word
distribution diverges from its suffix's (a Kullback-Leibler test on explicit next words).
The explicit counts are discounted and the freed mass is spread as the suffix's
distribution over the other words, so every state's probabilities sum to 1.  A token is
scored by the longest kept suffix of its history.

What can be large stays distributed: word counts are a table, and words outside the
frequent ones are scored by a join with it.  What is broadcast has a bound that doesn't
depend on the input: at most 1 / ``frequent`` words and 1 / ``joint`` explicit next words
for each level.  Tasks sum counts before the shuffle, so a hot word costs a row a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, coded, materialize, steps, words_of

END = ""  # no word is empty
HELD = 600_000  # partial counts a task holds before it sums them


@dataclass(frozen=True)
class Params:
    depth: int = 5
    frequent: float = 5e-7  # least share of the tokens of a word that the tree knows
    context: float = 1e-5  # least share of a context
    joint: float = 1e-6  # least share of a context with an explicit next word
    discount: float = 0.5
    nats: float = 0.005  # least divergence of a kept context
    evidence: float = 20.0  # least divergence times count, in nats


@dataclass
class Level:
    keys: np.ndarray  # sorted: suffix's number in the level below * contexts + word before it
    spread: np.ndarray  # log10 of the factor on the suffix's probability of other words
    next_keys: np.ndarray  # sorted: context's number * frequent + next word
    next_logp: np.ndarray


@dataclass
class Tree:
    tokens: int
    distinct: int
    words: pa.Array  # frequent ones, commonest first
    counts: np.ndarray
    contexts: int  # the first so many words can stand in a context
    levels: list[Level] = field(default_factory=list)

    def __post_init__(self):
        self.base = np.log10((self.counts + 1) / (self.tokens + self.distinct + 1))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Ids of all words and ends (-1: not frequent), the offsets of texts, the words (ends not among them)."""
        words, ends = words_of(texts)
        codes, distinct = coded(words)
        known = pc.fill_null(pc.index_in(distinct, self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        own = known[codes] if len(codes) else np.zeros(0, np.int64)
        offsets = ends + np.arange(len(ends))
        out = np.empty(len(own) + len(ends) - 1, np.int64)
        last = offsets[1:] - 1
        is_end = np.zeros(len(out), bool)
        is_end[last] = True
        out[~is_end] = own
        end = pc.index(self.words, pa.scalar(b"", pa.large_binary())).as_py()
        out[last] = end
        return out, offsets, words

    def states(self, ids: np.ndarray, offsets: np.ndarray, depth: int) -> list[np.ndarray]:
        """For each level up to ``depth``, the number of each token's context (-1: none)."""
        place = np.arange(len(ids)) - np.repeat(offsets[:-1], np.diff(offsets))
        state, out = np.zeros(len(ids), np.int64), []
        for d in range(1, depth + 1):
            before = np.full(len(ids), -1, np.int64)
            before[d:] = ids[:-d] if d <= len(ids) else before[d:]
            ok = (place >= d) & (before >= 0) & (before < self.contexts) & (state >= 0)
            state = np.where(ok, find(self.levels[d - 1].keys, state * self.contexts + before), -1)
            out.append(state)
        return out

    def log10p(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 probability of each token; of one that isn't frequent, without its root part."""
        out = np.where(ids >= 0, self.base[ids], 0.0) if len(self.base) else np.zeros(len(ids))
        for level, state in zip(self.levels, self.states(ids, offsets, len(self.levels)), strict=True):
            at = np.flatnonzero(state >= 0)
            s, w = state[at], ids[at]
            k = np.where(w >= 0, find(level.next_keys, s * len(self.words) + w), -1)
            out[at] = np.where(k >= 0, level.next_logp[k] if len(level.next_logp) else 0, level.spread[s] + out[at])
        return out


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def _summed(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by("k").aggregate([("n", "sum")]).rename_columns(["k", "n"])


def _counts(parts: Iterator[pa.Table], cast: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Partial counts (k, n), summed whenever many are held."""
    held: list[pa.Table] = []
    for t in parts:
        held.append(t)
        if sum(x.num_rows for x in held) > HELD:
            held = [_summed(held)]
            if held[0].num_rows > HELD // 2:
                yield from _cast(held.pop(), cast)
    if held:
        yield from _cast(_summed(held), cast)


def _cast(t: pa.Table, kind: pa.DataType) -> list[pa.RecordBatch]:
    return t.set_column(0, "k", t["k"].cast(kind)).to_batches(max_chunksize=100_000)


def word_counts(train: DataFrame) -> DataFrame:
    """word, n of all training tokens; the end of a text is the empty word."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in batches:
            for part in steps(batch, "text"):
                words, ends = words_of(part.column("text"))
                codes, distinct = coded(words)
                k = pa.concat_arrays([distinct.cast(pa.large_binary()), pa.array([b""], pa.large_binary())])
                yield pa.table({"k": k, "n": np.append(np.bincount(codes, minlength=len(distinct)), len(ends) - 1)})

    rows = arrow_map(train.select("text"), lambda b: _counts(tables(b), pa.string()), "k string, n long")
    return rows.groupBy(F.col("k").alias("word")).agg(F.sum("n").alias("n"))


def _level_counts(train: DataFrame, tree: Tree, depth: int, candidates: np.ndarray | None, params: Params) -> list[tuple[int, int]]:
    """Counts of (candidate context, next frequent word) that reach ``joint``, as (key, n).

    ``candidates``: sorted keys of the level's contexts (None: every context word).
    """
    shared = train.sparkSession.sparkContext.broadcast((tree, candidates))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        tree, keys = shared.value
        for batch in batches:
            for part in steps(batch, "text"):
                ids, offsets, _ = tree.ids(part.column("text"))
                below = tree.states(ids, offsets, depth - 1)[-1] if depth > 1 else np.zeros(len(ids), np.int64)
                before = np.full(len(ids), -1, np.int64)
                before[depth:] = ids[:-depth]
                place = np.arange(len(ids)) - np.repeat(offsets[:-1], np.diff(offsets))
                ok = (place >= depth) & (before >= 0) & (before < tree.contexts) & (below >= 0) & (ids >= 0)
                at = np.flatnonzero(ok)
                state = below[at] * tree.contexts + before[at]
                if keys is not None:
                    state = find(keys, state)
                    at, state = at[state >= 0], state[state >= 0]
                k, n = np.unique(state * len(tree.words) + ids[at], return_counts=True)
                yield pa.table({"k": k, "n": n})

    rows = arrow_map(train.select("text"), lambda b: _counts(tables(b), pa.int64()), "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    return [(r["k"], r["n"]) for r in rows.filter(F.col("n") >= _least(tree.tokens, params.joint)).collect()]


def _least(tokens: int, share: float) -> float:
    return max(2.0, share * tokens)


def keep_level(tree: Tree, keys: np.ndarray, totals: np.ndarray, joint: list[tuple[int, int]], params: Params) -> Level:
    """The candidates (``keys``, counted ``totals`` times) that pass the divergence test."""
    n_words = len(tree.words)
    k = np.array(sorted(joint), np.int64).reshape(-1, 2)
    owner, word, count = k[:, 0] // n_words, k[:, 0] % n_words, k[:, 1]
    # log10 of the suffix's probability of each explicit next word
    parent = tree.base[word] if len(word) else np.zeros(0)
    if tree.levels:
        chain, node = [], keys[owner] // tree.contexts
        for level in reversed(tree.levels):
            chain.append((level, node))
            node = level.keys[node] // tree.contexts
        for level, node in reversed(chain):
            at = find(level.next_keys, node * n_words + word)
            parent = np.where(at >= 0, level.next_logp[at] if len(level.next_logp) else 0, level.spread[node] + parent)
    p = (count - params.discount) / np.maximum(totals[owner], 1)
    told = np.abs(np.log10(p) - parent) > np.log10(1.2)  # others are left to the suffix
    owner, word, p, parent = owner[told], word[told], p[told], parent[told]
    mass, left = np.bincount(owner, p, len(keys)), np.bincount(owner, 10**parent, len(keys))
    spread = np.log10(np.maximum(1 - mass, 1e-12) / np.maximum(1 - left, 1e-12))
    nats = np.log(10) * (np.bincount(owner, p * (np.log10(p) - parent), len(keys)) + (1 - mass) * spread)
    kept = (nats >= params.nats) & (nats * totals >= params.evidence)
    number = np.cumsum(kept) - 1
    own = kept[owner]
    return Level(keys[kept], spread[kept], number[owner[own]] * n_words + word[own], np.log10(p[own]))


def fit(train: DataFrame, *, text_col: str = "text", params: Params = Params()) -> tuple[Tree, DataFrame]:
    """The tree of the training texts (null: empty), and the table of word counts.

    Repeated rows count as often as they are there.  Words of one count are numbered in
    their order; a context at a threshold is in.  Without rows the tree has the root alone.
    """
    train = train.select(train[text_col].alias("text"))
    table = materialize(word_counts(train), "op3-words")
    total = table.agg(F.sum("n").alias("tokens"), F.count("*").alias("distinct")).first()
    tokens, distinct = total["tokens"] or 0, total["distinct"]
    frequent = table.filter((F.col("n") >= _least(tokens, params.frequent)) | (F.col("word") == END)).toPandas()  # 1 / frequent rows at most
    frequent = frequent.sort_values(["n", "word"], ascending=[False, True])
    if not len(frequent):
        frequent.loc[0] = [END, 0]
    counts = frequent["n"].to_numpy(np.int64)
    # the end of a text is no context: histories don't cross texts, so it never stands in one
    tree = Tree(tokens, distinct, pa.array([w.encode() for w in frequent["word"]], pa.large_binary()), counts, int((counts >= _least(tokens, params.context)).sum()))
    keys, totals, candidates = np.arange(tree.contexts), counts[: tree.contexts], None
    for d in range(1, params.depth + 1):
        if not len(keys) or not tokens:
            break
        joint = _level_counts(train, tree, d, candidates, params)
        level = keep_level(tree, keys, totals, joint, params)
        tree.levels.append(level)
        # a longer context: a kept one with a word before it; its count is that of (word, ... next)
        keys, totals = _longer(tree, keys, joint, d, params)
        candidates = keys
    return tree, table


def _longer(tree: Tree, keys: np.ndarray, joint: list[tuple[int, int]], depth: int, params: Params) -> tuple[np.ndarray, np.ndarray]:
    """Candidates of the next level and their counts, from the counts of this one."""
    n_words = len(tree.words)
    least, found = _least(tree.tokens, params.context), {}
    for k, n in joint:
        owner, word = divmod(k, n_words)
        if n < least or word >= tree.contexts:
            continue
        # words oldest first: the context's, then the word that followed it
        path, key = [], int(keys[owner])
        for below in [*reversed(tree.levels[: depth - 1])]:
            path.append(key % tree.contexts)
            key = int(below.keys[key // tree.contexts])
        path.append(key % tree.contexts)
        history = [*path, word]  # oldest ... newest
        state = 0
        for d, w in enumerate(reversed(history[1:])):
            at = int(find(tree.levels[d].keys, np.array([state * tree.contexts + w]))[0])
            if at < 0:
                state = -1
                break
            state = at
        if state >= 0:
            found[state * tree.contexts + history[0]] = n
    ordered = sorted(found)
    return np.array(ordered, np.int64), np.array([found[k] for k in ordered], np.int64)


def score(docs: DataFrame, tree: Tree, table: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text: ``id_col``, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts are the end alone.  With no training tokens every token has the
    probability 1.  Very long texts are scored whole; repeated rows are scored each; an
    empty table gives no rows.  Other columns, whatever their names, are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            for part in steps(batch, "text"):
                ids, offsets, words = tree.ids(part.column("text"))
                logp = tree.log10p(ids, offsets)
                known = ids >= 0
                base = np.where(known, tree.base[ids], 0.0)
                sums = lambda x: np.add.reduceat(x, offsets[:-1])  # noqa: E731  every text has its end, so no range is empty
                n = part.num_rows
                seen = known & (tree.counts[ids] > 0)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.array(np.diff(offsets)), pa.array(sums(seen.astype(np.int64))), pa.array(sums(base)), pa.array(sums(logp))], names=names)
                # words that aren't frequent, counted for each text
                doc = np.repeat(np.arange(n), np.diff(offsets))
                is_end = np.zeros(len(ids), bool)
                is_end[offsets[1:] - 1] = True
                rare = np.flatnonzero(~known[~is_end])
                if len(rare):
                    codes, distinct = coded(words.take(pa.array(rare)))
                    k, c = np.unique(doc[~is_end][rare] * len(distinct) + codes, return_counts=True)
                    d, w = k // len(distinct), k % len(distinct)
                    for i in range(0, len(k), 100_000):
                        s = slice(i, i + 100_000)
                        at = pa.array(d[s])
                        none = pa.nulls(len(at))
                        yield pa.RecordBatch.from_arrays([part.column("row").take(at), none.cast(part.column("id").type), distinct.take(pa.array(w[s])).cast(pa.string()), pa.array(c[s]), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.float64()), none.cast(pa.float64())], names=names)

    names = ["row", "id", "word", "n", "n_tokens", "n_known", "base", "score"]
    rows = arrow_map(docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("id"), docs[text_col].alias("text")), run, f"row long, id {id_type}, word string, n long, n_tokens long, n_known long, base double, score double")
    rows = materialize(rows, "op3-rows")
    whole = rows.filter("word is null").select("row", "id", "n_tokens", "n_known", "base", "score")
    total = F.lit(float(tree.tokens + tree.distinct + 1))
    part = F.col("n") * F.log10((F.coalesce("count", F.lit(0)) + 1) / total)
    rare = rows.filter("word is not null").select("row", "word", "n").join(table.withColumnRenamed("n", "count"), "word", "left")
    rare = rare.select("row", F.lit(None).cast(id_type).alias("id"), F.lit(None).cast("long").alias("n_tokens"), F.when(F.col("count") > 0, F.col("n")).otherwise(0).alias("n_known"), part.alias("base"), part.alias("score"))
    return whole.unionByName(rare).groupBy("row").agg(F.first("id", True).alias(id_col), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.lit(tree.tokens).cast("long").alias("train_tokens"), F.sum("base").alias("base_score"), F.sum("score").alias("score")).drop("row")
