"""Language identification of code-switched text by a linear-chain CRF over words.

Every word is an observation with affix, character n-gram and lexicon features (hashed
into ``BUCKETS``); the labels are the languages, with learned transitions.  Words are
labelled by forward-backward, so a run of foreign words inside a text is found; the
text's language is the one with the largest mean marginal over its words with letters.

Fitting uses a bounded sample of labelled rows: about ``per_language`` texts of each
language, chosen by hash, ``window`` words of each, joined to sequences of several
languages so that transitions are learned.  Parts of the sample are fitted in tasks of
their own and the weights averaged.  Prediction is one narrow pass over all whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, coded, hashed, mixed, steps, text_bytes, words_of

BUCKETS = 1 << 15
PARTS = 4
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
STEP = 1 << 20
REMEMBERED = 150_000  # words whose emissions a task holds; only speed depends on it


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each word's UTF-8 bytes, and the n+1 offsets of the words' features.

    The word itself, its two- and three-byte n-grams with both word ends (so affixes of
    one and two bytes), and its first and last three bytes.
    """
    raw, offsets = text_bytes(words)
    n, lengths = len(words), np.diff(offsets)
    padded = np.full(len(raw) + 2 * n, 1, np.uint64)  # byte 1 before, byte 2 after each word
    begins = offsets[:-1] + 2 * np.arange(n)
    inner = np.ones(len(padded), bool)
    inner[begins] = inner[begins + lengths + 1] = False
    padded[inner] = raw
    padded[begins + lengths + 1] = 2
    owner = np.repeat(np.arange(n), lengths + 2)
    two = padded[:-1] * np.uint64(256) + padded[1:]
    ok2 = owner[:-1] == owner[1:]
    three = two[:-1] * np.uint64(256) + padded[2:]
    ok3 = owner[:-2] == owner[2:]
    long = np.flatnonzero(lengths >= 3)
    four = lambda at: two[at] * np.uint64(65536) + two[at + 2]
    keys = np.concatenate([hashed(words), two[ok2], three[ok3] + (np.uint64(2) << np.uint64(40)), four(begins[long]) + (np.uint64(3) << np.uint64(40)), four(begins[long] + lengths[long] - 2) + (np.uint64(4) << np.uint64(40))])
    owners = np.concatenate([np.arange(n), owner[:-1][ok2], owner[:-2][ok3], long, long])
    order = np.argsort(owners, kind="stable")
    return (mixed(keys[order]) % np.uint64(BUCKETS)).astype(np.int64), np.append(0, np.cumsum(np.bincount(owners, minlength=n))).astype(np.int64)


def has_letter(words: pa.Array) -> np.ndarray:
    raw, offsets = text_bytes(words)
    ascii_letter = ((raw | 32) >= 97) & ((raw | 32) <= 122) & (raw < 128)
    count = lambda x: np.diff(np.append(0, np.cumsum(x))[offsets])
    out = count(ascii_letter) > 0
    for i in np.flatnonzero(~out & (count(raw > 127) > 0)):
        out[i] = any(map(str.isalpha, words[int(i)].as_py().decode("utf-8", "replace")))
    return out


@dataclass
class CrfModel:
    labels: list[str]
    weights: np.ndarray  # BUCKETS x labels
    transitions: np.ndarray  # from x to
    lexicon: pa.Array  # words
    lexicon_label: np.ndarray
    lexicon_weights: np.ndarray  # labels: weight of "the lexicon says so"

    def emissions(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the labels for each word (0 for one without letters), and whether it has a letter."""
        if not len(distinct):
            return np.zeros((0, len(self.labels)), np.float32), np.zeros(0, bool)
        letters = has_letter(distinct)
        flat, ends = word_features(distinct)
        out = np.stack([np.add.reduceat(self.weights[:, k][flat], ends[:-1]) for k in range(len(self.labels))], axis=1)
        said = in_lexicon(distinct, self.lexicon, self.lexicon_label)
        at = np.flatnonzero(said >= 0)
        out[at, said[at]] += self.lexicon_weights[said[at]]
        out[~letters] = 0
        return out.astype(np.float32), letters


class Emissions:
    """Emissions of words, remembered for a task's later texts."""

    def __init__(self, crf: CrfModel):
        self.crf = crf
        self.forget()

    def forget(self) -> None:
        self.words = pa.array([], pa.large_binary())
        self.scores, self.letters = self.crf.emissions(self.words)

    def of(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > REMEMBERED:
            self.forget()
        at = pc.fill_null(pc.index_in(distinct, self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = len(self.words) + np.arange(len(new))
            fresh = distinct.take(pa.array(new))
            scores, letters = self.crf.emissions(fresh)
            self.words = pa.concat_arrays([self.words, fresh])
            self.scores, self.letters = np.concatenate([self.scores, scores]), np.append(self.letters, letters)
        return self.scores[at], self.letters[at]


def in_lexicon(words: pa.Array, lexicon: pa.Array, label: np.ndarray) -> np.ndarray:
    """The lexicon's label of each word, or -1."""
    at = pc.fill_null(pc.index_in(words, lexicon), -1).to_numpy(zero_copy_only=False)
    return np.where(at >= 0, label[at] if len(label) else -1, -1)


def packing(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Time-major order of sequences, longest first.

    Returns the order of the sequences, the number of them alive at each time, and for
    each packed row the place of its word in the concatenated sequences.
    """
    order = np.argsort(-lengths, kind="stable")
    ordered = lengths[order]
    starts = (np.cumsum(lengths) - lengths)[order]
    alive = np.searchsorted(-ordered, -np.arange(ordered[0] if len(ordered) else 0), side="left")
    rank = np.arange(alive.sum()) - np.repeat(np.cumsum(alive) - alive, alive)
    return order, alive, starts[rank] + np.repeat(np.arange(len(alive)), alive)


def marginals(scores: np.ndarray, transitions: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over packed rows: label marginals, and summed pair marginals.

    Probabilities are scaled to sum 1 at each time, so long sequences don't underflow.
    """
    e = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float32) + np.float32(1e-30)
    a = np.exp(transitions - transitions.max()).astype(np.float32) + np.float32(1e-30)
    ends = np.cumsum(alive)
    starts = ends - alive
    forward = np.empty_like(e)
    for t in range(len(alive)):
        row = e[starts[t] : ends[t]]
        if t:
            row = row * (forward[starts[t - 1] : starts[t - 1] + alive[t]] @ a)
        forward[starts[t] : ends[t]] = row / row.sum(axis=1, keepdims=True)
    out = forward  # turned into marginals in place, from the end
    pairs = np.zeros_like(a)
    beta = None
    for t in range(len(alive) - 1, -1, -1):
        n = alive[t]
        back = np.ones((n, e.shape[1]), np.float32)
        if t + 1 < len(alive):
            inner = e[starts[t + 1] : ends[t + 1]] * beta
            m = alive[t + 1]
            f = out[starts[t] : starts[t] + m]
            back[:m] = inner @ a.T
            z = (f * back[:m]).sum(axis=1, keepdims=True)
            pairs += a * ((f / z).T @ inner)
            back[:m] /= back[:m].sum(axis=1, keepdims=True)
        beta = back
        row = out[starts[t] : ends[t]] * back
        out[starts[t] : ends[t]] = row / row.sum(axis=1, keepdims=True)
    return out, pairs


def fit_part(words: list[list[bytes]], labels: np.ndarray, n_labels: int, lexicon: dict[bytes, int], *, epochs: int = 4, rate: float = 0.3, l2: float = 1e-4, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adagrad on the CRF likelihood of one part's sequences of joined segments."""
    rng = np.random.default_rng(seed)
    w, tr, lx = np.zeros((BUCKETS, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)
    gw, gt, gl = np.full_like(w, 1e-2), np.full_like(tr, 1.0), np.full_like(lx, 1.0)
    known: dict[bytes, int] = {}
    segments = []
    for text, y in zip(words, labels, strict=True):
        for i in range(0, len(text), 20):
            ids = []
            for x in text[i : i + 20]:
                ids.append(known.setdefault(x, len(known)))
            segments.append((ids, int(y)))
    if not segments:
        return w, tr, lx
    distinct = pa.array(list(known), pa.large_binary())
    flat, ends = word_features(distinct)
    owner = np.repeat(np.arange(len(known)), np.diff(ends))
    lettered = has_letter(distinct)
    flat, owner = flat[lettered[owner]], owner[lettered[owner]]
    said = np.array([lexicon.get(x, -1) for x in known])
    for _ in range(epochs):
        order = rng.permutation(len(segments))
        # sequences of one to three segments
        cuts = np.cumsum(rng.integers(1, 4, len(order)))
        sequences = [order[a:b] for a, b in zip(np.append(0, cuts), cuts, strict=False) if a < len(order)]
        for i in range(0, len(sequences), 64):
            batch = sequences[i : i + 64]
            ids = [np.concatenate([segments[k][0] for k in s]) for s in batch]
            gold = np.concatenate([np.repeat([segments[k][1] for k in s], [len(segments[k][0]) for k in s]) for s in batch])
            lengths = np.array([len(x) for x in ids])
            _, alive, place = packing(lengths)
            at = np.concatenate(ids)
            used, where = np.unique(at, return_inverse=True)
            mask = np.isin(owner, used)
            f, o = flat[mask], np.searchsorted(used, owner[mask])
            scores = np.zeros((len(used), n_labels))
            np.add.at(scores, o, w[f])
            lex = np.flatnonzero(said[used] >= 0)
            scores[lex, said[used][lex]] += lx[said[used][lex]]
            m, pairs = marginals(scores[where[place]], tr, alive)
            wrong = m.astype(np.float64)
            wrong[np.arange(len(place)), gold[place]] -= 1
            per_word = np.zeros((len(used), n_labels))
            np.add.at(per_word, where[place], wrong)
            gradient = np.zeros((len(f), n_labels))
            gradient[:] = per_word[o]
            rows, back = np.unique(f, return_inverse=True)
            total = np.zeros((len(rows), n_labels))
            np.add.at(total, back, gradient)
            total += l2 * w[rows]
            gw[rows] += total**2
            w[rows] -= rate * total / np.sqrt(gw[rows])
            last = np.cumsum(lengths) - 1
            inner = np.ones(len(gold), bool)
            inner[last] = False
            seen = np.zeros_like(tr)
            k = np.flatnonzero(inner)
            np.add.at(seen, (gold[k], gold[k + 1]), 1)
            d = pairs - seen
            gt += d**2
            tr -= rate * d / np.sqrt(gt)
            d = np.zeros(n_labels)
            np.add.at(d, said[used][lex], per_word[lex, said[used][lex]])
            gl += d**2
            lx -= rate * d / np.sqrt(gl)
    return w, tr, lx


def fit(rows: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 600, window: int = 120) -> CrfModel | None:
    """Fit on the rows with a text and a language; None if there are none.

    ``per_language``: expected texts of each language in the sample (fewer if there are
    fewer); ``window``: words taken of each, from a place given by its hash.
    """
    have = rows.select(rows[id_col].cast("string").alias("id"), rows[text_col].alias("text"), rows[lang_col].cast("string").alias("lang")).filter("text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in have.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return None
    labels = sorted(counts)
    share = F.lit(0.0)
    for lang in labels:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / counts[lang]))).otherwise(share)
    sample = have.withColumn("dice", F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) / (1 << 30)).filter(F.col("dice") < share)
    n = len(labels)

    def windows(texts: pd.Series, ids: pd.Series) -> list[list[bytes]]:
        out = []
        for text, i in zip(texts, ids, strict=True):
            w = WORD.findall(text.encode().lower())  # of bytes, lower() is A-Z only
            start = zlib.crc32(str(i).encode()) % max(1, len(w) - window + 1)
            out.append(w[start : start + window])
        return out

    def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            for w, lang in zip(windows(b["text"], b["id"]), b["lang"], strict=True):
                seen.update((x.decode(), lang) for x in w)
        yield pd.DataFrame([(w, lang, c) for (w, lang), c in seen.items()], columns=["word", "lang", "n"])

    tallies = sample.select("id", "text", "lang").mapInPandas(count_words, "word string, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n")).filter("n >= 3").collect()
    by_word: dict[str, dict[str, int]] = defaultdict(dict)
    for r in tallies:
        by_word[r["word"]][r["lang"]] = r["n"]
    lexicon = {w.encode(): labels.index(max(c, key=lambda k: (c[k], k))) for w, c in by_word.items() if max(c.values()) >= 0.7 * sum(c.values())}

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        w, tr, lx = fit_part(windows(pdf["text"], pdf["id"]), np.array([labels.index(x) for x in pdf["lang"]]), n, lexicon)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "w": [w.astype(np.float32).tobytes()], "tr": [tr.astype(np.float32).tobytes()], "lx": [lx.astype(np.float32).tobytes()]})

    def train_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        for _, part in pd.concat(held).groupby("part") if held else ():
            yield train(part)

    dealt = sample.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")).select("part", "id", "text", "lang").repartitionByRange(PARTS, "part")  # ranges, so that no two parts share a task
    parts = dealt.mapInPandas(train_parts, "part int, w binary, tr binary, lx binary").orderBy("part").collect()
    mean = lambda k, *shape: np.mean([np.frombuffer(p[k], np.float32).reshape(shape) for p in parts], axis=0)
    return CrfModel(labels, mean("w", BUCKETS, n), mean("tr", n, n), pa.array(list(lexicon), pa.large_binary()), np.array(list(lexicon.values()), np.int64), mean("lx", n))


def predict(docs: DataFrame, model: CrfModel | None, *, id_col: str = "doc_id", text_col: str = "text", spans: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Label every whole text: ``id_col``, ``keep`` columns, lang_pred, score.

    score: the mean marginal of the predicted language over the words with letters (0 to
    1; ties go to the first language in order).  Null, empty and letter-free texts, and
    all texts without a model, are ``und`` with score 0.  With ``spans``, also the runs
    of words of one language (array of first, last, lang).  Very long texts are labelled
    whole; repeated rows alike; an empty table gives no rows.  Columns that aren't kept are
    not read; to keep one with the name of a result is an error.
    """
    keep = keep or []
    if clash := {"lang_pred", "score", *["spans"] * spans} & {id_col, *keep}:
        raise ValueError(f"kept columns have names of the result: {sorted(clash)}")
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    span_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("lang", pa.string())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x labels weights and the sample's lexicon

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        known = Emissions(crf) if crf is not None else None
        for batch in batches:
            for part in steps(batch, "__text", STEP):
                langs, scores, runs = ["und"] * part.num_rows, np.zeros(part.num_rows), [[] for _ in range(part.num_rows)]
                if crf is not None:
                    words, ends = words_of(part.column("__text"))
                    codes, distinct = coded(words)
                    emissions, letters = known.of(distinct)
                    lengths = np.diff(ends)
                    some = np.flatnonzero(lengths)
                    if len(some):
                        order, alive, place = packing(lengths[some])
                        m, _ = marginals(emissions[codes[place]], crf.transitions, alive)
                        weighty = letters[codes]
                        packed_doc = np.empty(len(codes), np.int64)
                        packed_doc[:] = np.repeat(some, lengths[some])
                        docs_at, heavy = packed_doc[place], weighty[place]
                        sums = np.stack([np.bincount(docs_at[heavy], m[heavy, k], part.num_rows) for k in range(m.shape[1])], axis=1)
                        n = np.bincount(docs_at[heavy], minlength=part.num_rows)
                        for i in np.flatnonzero(n):
                            k = int(sums[i].argmax())
                            langs[i], scores[i] = crf.labels[k], min(1.0, max(0.0, sums[i, k] / n[i]))
                        if spans:
                            best = np.empty(len(codes), np.int64)
                            best[place] = m.argmax(axis=1)
                            for i in some:
                                b = best[ends[i] : ends[i + 1]]
                                cut = np.append(0, np.flatnonzero(np.diff(b)) + 1)
                                runs[i] = [{"first": int(x), "last": int(y) - 1, "lang": crf.labels[b[x]]} for x, y in zip(cut, np.append(cut[1:], len(b)), strict=True)]
                made = [*(part.column(f"k{j}") for j in range(len(kept))), pa.array(langs, pa.string()), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(made + ([pa.array(runs, span_type)] if spans else []), names=names)

    kept = [id_col, *keep]
    names = [f"k{j}" for j in range(len(kept))] + ["lang_pred", "score"] + ["spans"] * spans
    schema = ", ".join([f"k{j} {types[c]}" for j, c in enumerate(kept)] + ["lang_pred string, score double"] + ["spans array<struct<first: long, last: long, lang: string>>"] * spans)
    rows = docs.select(*[docs[c].alias(f"k{j}") for j, c in enumerate(kept)], docs[text_col].alias("__text"))
    return arrow_map(rows, run, schema).toDF(*kept, "lang_pred", "score", *["spans"] * spans)


def fold(docs: DataFrame, parts: int, id_col: str = "doc_id"):
    """crc32 of the id as text, modulo ``parts`` (a null id is in part 0)."""
    return F.coalesce(F.pmod(F.crc32(docs[id_col].cast("string")), F.lit(parts)), F.lit(0))
