"""Benchmark decontamination: BM25 inverted index of the test items, block-max WAND.

The items are indexed with impacts divided by the item's own full score, so one
threshold holds for all: a passage that contains a whole item scores 1 for it.  Every
document is read as passages of 2 L words, L words apart, where L is the longest item
of the whole set: each occurrence of an item lies whole inside a passage.  A passage is a query.

Two exact bounds come before the search.  Each item's commonest terms, up to a share of
the threshold, are non-essential: without a term of the rest no passage can reach the
threshold, so only passages with enough essential weight are searched at all.  The
search is block-max WAND and returns every item at or above the threshold.  A found item
counts as a leak when enough word n-grams of both its question and its answer are in the
passage.

The index is broadcast when the items have ``INDEX_WORDS`` words at most (counted);
larger sets are searched slice by slice, with the statistics of the whole set.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NOT_ALNUM, arrow_map, steps, words_of

INDEX_WORDS = 2_000_000
K1, B = 1.2, 0.75
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")  # punctuation that a page glues to a word doesn't count


@dataclass(frozen=True)
class Params:
    threshold: float = 0.6  # share of an item's full score
    spared: float = 0.4  # share of the threshold that non-essential terms may hold
    ngram: int = 5
    overlap: float = 0.8  # share of the question's and of the answer's n-grams
    block: int = 32  # postings of a block
    least: int = 32  # words of L at least


def words(text: str | None) -> list[bytes]:
    return [w.lower() for w in WORD.findall((text or "").encode())]  # bytes.lower: A-Z only


def question_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The answer is the last line, or the last sentence of a single line; the rest is the question.

    With one sentence only, both are the whole item.
    """
    text = text.strip()
    head, _, tail = text.rpartition("\n")
    if not head:
        cut = max((m.end() for m in re.finditer(r"[.!?]\s", text)), default=0)
        head, tail = text[:cut], text[cut:]
    q, a = words(head), words(tail)
    return (q, a) if q and a else (q or a,) * 2


def ngrams(w: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    """The word n-grams; of fewer words, the sequence itself."""
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def overlap(part: list[bytes], passage: list[bytes], n: int) -> float:
    grams = ngrams(part, min(n, len(part)))
    return len(grams & ngrams(passage, min(n, len(part)))) / len(grams) if grams else 0.0


class BlockMaxIndex:
    """Postings in item order, cut into blocks that know their largest impact."""

    def __init__(self, items: list[tuple[int, str]], df: dict[bytes, int], n_items: int, mean_words: float, params: Params = Params(), longest: int = 0):
        self.params = params
        self.ids = [i for i, _ in items]
        self.parts = [question_answer(t) for _, t in items]
        postings: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        essential: dict[bytes, list[int]] = defaultdict(list)
        self.spared = np.zeros(len(items))  # weight of each item's non-essential terms
        self.longest = longest  # words of the longest item, which may be in another slice
        for at, (_, text) in enumerate(items):
            w = words(text)
            self.longest = max(self.longest, len(w))
            tf: dict[bytes, int] = defaultdict(int)
            for x in w:
                tf[x] += 1
            norm = K1 * (1 - B + B * len(w) / max(mean_words, 1e-9))
            impact = {x: math.log(1 + (n_items - df[x] + 0.5) / (df[x] + 0.5)) * c * (K1 + 1) / (c + norm) for x, c in tf.items()}
            full = sum(impact.values())
            for x, v in impact.items():
                postings[x].append((at, v / full))
            for x in sorted(impact, key=lambda x: (-df[x], len(x), x)):
                if self.spared[at] + impact[x] / full <= params.spared * params.threshold:
                    self.spared[at] += impact[x] / full
                else:
                    essential[x].append(at)
        self.terms = {x: (np.array([p[0] for p in ps]), np.array([p[1] for p in ps])) for x, ps in postings.items()}
        self.block_max = {x: np.maximum.reduceat(w, np.arange(0, len(w), params.block)) for x, (_, w) in self.terms.items()}
        self.top = {x: float(w.max()) for x, (_, w) in self.terms.items()}
        # essential terms as arrays: term k has the items and weights of start[k] : start[k + 1]
        names = sorted(essential)
        self.names = pa.array(names, pa.large_binary())
        self.start = np.append(0, np.cumsum([len(essential[x]) for x in names])).astype(np.int64)
        self.e_items = np.array([i for x in names for i in essential[x]], np.int64)
        weight = {x: dict(zip(*(y.tolist() for y in self.terms[x]), strict=True)) for x in names}
        self.e_weights = np.array([weight[x][i] for x in names for i in essential[x]])

    def search(self, terms: set[bytes], threshold: float) -> list[tuple[int, float]]:
        """Every item (number, score) whose terms among ``terms`` weigh ``threshold`` or more."""
        size = self.params.block
        lists = [[0, x, *self.terms[x]] for x in sorted(terms) if x in self.terms]  # place, term, items, weights
        found, eps = [], 1e-9
        while True:
            lists = sorted((c for c in lists if c[0] < len(c[2])), key=lambda c: c[2][c[0]])
            bound, pivot = 0.0, -1
            for k, c in enumerate(lists):
                bound += self.top[c[1]]
                if bound >= threshold - eps:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = lists[pivot][2][lists[pivot][0]]
            while pivot + 1 < len(lists) and lists[pivot + 1][2][lists[pivot + 1][0]] == item:
                pivot += 1
            for c in lists[: pivot + 1]:  # shallow move to the block that may hold the item
                if c[2][c[0]] < item:
                    c[0] = int(np.searchsorted(c[2], item))
            at_item = [c for c in lists[: pivot + 1] if c[0] < len(c[2])]
            blocks = sum(self.block_max[c[1]][c[0] // size] for c in at_item)
            if blocks < threshold - eps:
                # no item before the next block end (or the next list's item) can reach it
                limits = [c[2][min(len(c[2]) - 1, (c[0] // size + 1) * size - 1)] + 1 for c in at_item]
                limits += [lists[pivot + 1][2][lists[pivot + 1][0]]] if pivot + 1 < len(lists) else []
                beyond = max(item + 1, min(limits, default=item + 1))
                for c in at_item:
                    if c[2][c[0]] < beyond:
                        c[0] = int(np.searchsorted(c[2], beyond))
                continue
            score = sum(float(c[3][c[0]]) for c in at_item if c[2][c[0]] == item)
            if score >= threshold - eps:
                found.append((int(item), score))
            for c in at_item:
                if c[2][c[0]] == item:
                    c[0] += 1


def _passages(index: BlockMaxIndex, texts: pa.Array) -> Iterator[tuple[int, int, int, float, float, float]]:
    """Leaks in these texts: text number, first word of the passage, item number, score, overlaps."""
    p = index.params
    stride = max(p.least, index.longest)
    tokens, ends = words_of(texts, NOT_ALNUM)
    codes = pc.index_in(tokens, index.names)
    at = np.flatnonzero(codes.is_valid().to_numpy(zero_copy_only=False))
    if not len(at):
        return
    terms = codes.take(pa.array(at)).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.searchsorted(ends, at, side="right") - 1
    chunk = (at - ends[doc]) // stride
    n = index.start[terms + 1] - index.start[terms]
    row = np.repeat(np.arange(len(at)), n)
    post = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + index.start[terms][row]
    item, weight = index.e_items[post], index.e_weights[post]
    last = np.maximum(0, -(-(np.diff(ends)) // stride) - 2)[doc]  # the last passage of each text
    # a word lies in the passage that begins with its chunk and in the one before
    both = [(np.minimum(chunk, last)[row], np.ones(len(row), bool)), (chunk[row] - 1, (chunk[row] >= 1) & (chunk[row] - 1 < np.minimum(chunk, last)[row]))]
    d = np.concatenate([doc[row][ok] for _, ok in both])
    c = np.concatenate([x[ok] for x, ok in both])
    i = np.concatenate([item[ok] for _, ok in both])
    v = np.concatenate([weight[ok] for _, ok in both])
    order = np.lexsort((i, c, d))
    d, c, i, v = d[order], c[order], i[order], v[order]
    new = np.append(True, (np.diff(d) != 0) | (np.diff(c) != 0) | (np.diff(i) != 0))
    first = np.flatnonzero(new)
    reach = np.add.reduceat(v, first) + index.spared[i[first]] >= p.threshold - 1e-9
    for x, y in sorted({(int(x), int(y)) for x, y in zip(d[first][reach], c[first][reach], strict=True)}):
        start = ends[x] + y * stride
        passage = tokens.slice(start, min(2 * stride, ends[x + 1] - start)).to_pylist()
        for k, score in index.search(set(passage), p.threshold):
            q, a = (overlap(part, passage, p.ngram) for part in index.parts[k])
            if q >= p.overlap and a >= p.overlap:
                yield x, y * stride, k, score, q, a


def _index(benchmark: DataFrame, part: int, parts: int, df: DataFrame, n_items: int, mean_words: float, longest: int, params: Params) -> BlockMaxIndex:
    items = benchmark.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == part)
    own = items.select(F.explode("words").alias("word")).distinct()
    counts = {bytes(r["word"].encode()): r["df"] for r in df.join(own, "word", "left_semi").collect()}
    rows = [(r["item"], r["text"]) for r in items.select("item", "text").orderBy("item", "text").collect()]
    return BlockMaxIndex(rows, counts, n_items, mean_words, params, longest)


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", params: Params = Params()) -> DataFrame:
    """Every document and benchmark item that it contains: ``id_col``, ``item_col``,
    first_word (of the best passage), score, question_overlap, answer_overlap, n_passages.

    Null and empty texts, and items without words, match nothing; an empty benchmark or
    table gives no rows.  Very long texts are searched whole.  Of passages with the same
    best score the first counts.  Rows of one id are one document: their passages count
    together, repeated rows too; a null id is an id.  Other columns, whatever their
    names, are not read.  The slices of a large index change no row.
    """
    types = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    lower = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = F.filter(F.split(lower, "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"), lambda w: w != "")
    items = benchmark.select(benchmark[item_col].alias("item"), benchmark[item_text_col].alias("text")).filter("item is not null and text is not null").distinct().withColumn("words", split).filter(F.size("words") > 0)
    sizes = items.agg(F.count("*").alias("n"), F.sum(F.size("words")).alias("words"), F.max(F.size("words")).alias("longest")).first()
    n_items, total, longest = sizes["n"], sizes["words"] or 0, sizes["longest"] or 0
    parts = max(1, -(-total // INDEX_WORDS))
    df = items.select("item", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).filter("text is not null")
    found = None
    for part in range(parts if n_items else 1):
        shared = docs.sparkSession.sparkContext.broadcast(_index(items, part, parts, df, n_items, total / max(1, n_items), longest, params))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for piece in steps(batch, "text"):
                    made = list(_passages(index, piece.column("text"))) if index.ids else []
                    if made:
                        x, first, k, score, q, a = zip(*made, strict=True)
                        yield pa.RecordBatch.from_arrays([piece.column("id").take(pa.array(x)), pa.array([index.ids[j] for j in k], item_type), *map(pa.array, (first, score, q, a))], names=names)

        item_type = pa.int64() if types[1] == "bigint" else pa.int32() if types[1] == "int" else pa.string()
        names = ["id", "item", "first_word", "score", "question_overlap", "answer_overlap"]
        here = arrow_map(rows, run, f"id {types[0]}, item {types[1]}, first_word long, score double, question_overlap double, answer_overlap double")
        found = here if found is None else found.unionByName(here)
    best = F.max_by(F.struct("first_word", "score", "question_overlap", "answer_overlap"), F.struct("score", -F.col("first_word")))
    return found.groupBy("id", "item").agg(best.alias("b"), F.count("*").alias("n_passages")).select(F.col("id").alias(id_col), F.col("item").alias(item_col), "b.*", "n_passages")
