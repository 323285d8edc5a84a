"""Operators 3 and 9: suffix-tree scores and language labels."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import catalog, crf_langid, pst, pst_tables

rng = random.Random(11)
EN, DE = ["the cat", "house of", "and water", "walking the", "other thing"], ["der hund", "und das", "haus ist", "nicht schön", "über straße"]


def text(parts, n):
    return " ".join(rng.choice(parts) for _ in range(n))


def test_suffix_tree_base_and_sums(spark):
    texts = [None, "", "A b a B", *(text(EN if i % 2 else DE, rng.randint(1, 30)) for i in range(120)), "a b a b", "zz yy"]
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    train = docs.filter("doc_id % 3 <> 0")
    tree, counts = pst.fit(train, params=pst.Params(depth=2, context=0.01, joint=0.001, frequent=0.01, nats=0.001, evidence=1.0))
    assert len(tree.levels) == 2 and len(tree.levels[0].keys)
    got = {r["doc_id"]: r for r in pst.score(docs, tree, counts).collect()}
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), ""]
    c = Counter(x for i, t in enumerate(texts) if i % 3 for x in tokens(t))
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        w = tokens(t)
        assert math.isclose(got[i]["base_score"], sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
    assert sum(r["score"] - r["base_score"] for i, r in got.items() if i % 3 == 0) > 0
    # every state is a distribution: all known words and one for the unknown sum to 1
    words = list(tree.words.to_pylist())
    full = sorted(c, key=lambda x: x.encode() not in words)
    for history in (["the"], ["of", "the"], ["der"], ["zz"], []):
        seqs = [" ".join([*history, w]) if w else " ".join(history) for w in full]
        total = 0.0
        for w, s in zip(full, seqs, strict=True):
            ids, offsets, _ = tree.ids(pa.array([s]))
            lp = tree.log10p(ids, offsets)
            at = len(history)
            total += 10 ** (lp[at] + (0 if ids[at] >= 0 else math.log10((c[w] + 1) / (n + v + 1))))
        ids, offsets, _ = tree.ids(pa.array([" ".join([*history, "never-seen"])]))
        total += 10 ** (tree.log10p(ids, offsets)[len(history)] + math.log10(1 / (n + v + 1)))
        assert math.isclose(total, 1, abs_tol=1e-6), (history, total)
    empty, none = pst.fit(docs.limit(0))
    assert pst.score(docs, empty, none).filter("score <> 0").count() == 0
    assert pst.score(docs.limit(0), tree, counts).count() == 0


def brute_tree(texts, p):
    """Kept contexts (newest word last) with their explicit next words' log10 probabilities and the factor of others."""
    seqs = [[*re.findall(r"[^\x20\x09-\x0D]+", t.lower()), ""] for t in texts]
    single = Counter(w for s in seqs for w in s)
    tokens = sum(single.values())
    least = lambda share: max(2.0, share * tokens)
    known = {w for w, n in single.items() if n >= least(p.frequent) or not w}
    capable = {w for w in known if single[w] >= least(p.context)}
    base = {w: math.log10((single[w] + 1) / (tokens + len(single) + 1)) for w in single}
    kept = {}

    def log10p(context, w):
        if not context:
            return base[w]
        following, other = kept[context]
        return following[w] if w in following else other + log10p(context[1:], w)

    for d in range(1, p.depth + 1):
        pairs, here = Counter(), {}
        for s in seqs:
            for i in range(d, len(s)):
                context = tuple(s[i - d : i])
                if s[i] in known and set(context) <= capable and (d == 1 or context[1:] in kept):
                    pairs[context, s[i]] += 1
        if d == 1:
            candidates = {(w,): single[w] for w in capable}
        else:  # counted where the context's last word followed the others, in a state of the level below
            candidates = {c: n for c, n in followed.items() if n >= least(p.context) and set(c) <= capable and c[1:] in kept}
        for c, total in candidates.items():
            explicit = {w: (n - p.discount) / total for (x, w), n in pairs.items() if x == c and n >= least(p.joint)}
            explicit = {w: q for w, q in explicit.items() if abs(math.log10(q) - log10p(c[1:], w)) > math.log10(1.2)}
            mass, left = sum(explicit.values()), sum(10 ** log10p(c[1:], w) for w in explicit)
            other = math.log10(max(1 - mass, 1e-12) / max(1 - left, 1e-12))
            nats = math.log(10) * (sum(q * (math.log10(q) - log10p(c[1:], w)) for w, q in explicit.items()) + (1 - mass) * other)
            if nats >= p.nats and nats * total >= p.evidence:
                here[c] = ({w: math.log10(q) for w, q in explicit.items()}, other)
        followed = {(*x, w): n for (x, w), n in pairs.items() if n >= least(p.joint) and x in candidates}
        kept |= here
    return kept


def test_suffix_tree_by_brute_force(spark):
    r = random.Random(21)
    words = [f"w{k}" for k in range(12)]
    texts = []
    for _ in range(150):
        t = [r.choice(words)]
        while len(t) < r.randint(5, 40):  # the next word hangs on the last one to three
            k = r.choice((1, 1, 2, 3))
            t.append(words[(sum(int(w[1:]) for w in t[-k:]) * 5 + r.choice((0, 0, 0, 1))) % 12] if r.random() < 0.8 else r.choice(words))
        texts.append(" ".join(t))
    params = pst.Params(depth=3, frequent=0.001, context=0.003, joint=0.0008, nats=0.01, evidence=3.0)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    tree, _ = pst.fit(docs, params=params)
    names = [w.decode() for w in tree.words.to_pylist()]
    got, below = {}, {0: ()}
    for level in tree.levels:
        here = {i: (names[k % tree.contexts], *below[k // tree.contexts]) for i, k in enumerate(level.keys.tolist())}
        for i, c in here.items():
            own = level.next_keys // len(names) == i
            got[c] = ({names[k % len(names)]: v for k, v in zip(level.next_keys[own].tolist(), level.next_logp[own].tolist(), strict=True)}, level.spread[i])
        below = here
    want = brute_tree(texts, params)
    assert got.keys() == want.keys() and {len(c) for c in want} == {1, 2, 3}
    for c, (following, other) in want.items():
        assert got[c][0].keys() == following.keys() and math.isclose(got[c][1], other, abs_tol=1e-9)
        assert all(math.isclose(got[c][0][w], v, abs_tol=1e-9) for w, v in following.items())


def brute_scores(train, texts, p):
    """Base and tree log10 probabilities of each text by dictionaries of all contexts; the words that are known."""
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")), ""]
    seqs = [split(t) for t in train]
    single = Counter(w for s in seqs for w in s)
    total = math.log10(sum(single.values()) + len(single) + 1)
    kept = {}

    def log10p(context, w):
        if not context:
            return math.log10(single[w] + 1) - total
        if context not in kept:
            return log10p(context[1:], w)
        following, other = kept[context]
        return following[w] if w in following else other + log10p(context[1:], w)

    for d in range(1, p.depth + 1):
        counts, here = {}, {}
        for s in seqs:
            for i in range(d, len(s)):
                counts.setdefault(tuple(s[i - d : i]), Counter())[s[i]] += 1
        for c, following in counts.items():
            n = sum(following.values())
            if n < p.least or (d > 1 and c[1:] not in kept):
                continue
            explicit = {w: (k - p.discount) / n for w, k in following.items() if k >= p.least}
            explicit = {w: q for w, q in explicit.items() if abs(math.log10(q) - log10p(c[1:], w)) > math.log10(1.2)}
            mass, left = sum(explicit.values()), sum(10 ** log10p(c[1:], w) for w in explicit)
            other = math.log10(max(1 - mass, 1e-12) / max(1 - left, 1e-12))
            nats = math.log(10) * (sum(q * (math.log10(q) - log10p(c[1:], w)) for w, q in explicit.items()) + (1 - mass) * other)
            if nats >= p.nats and nats * n >= p.evidence:
                here[c] = ({w: math.log10(q) for w, q in explicit.items()}, other)
        kept |= here

    def longest(history, w):
        d = 0  # the suffixes of a kept context are kept
        while d < min(p.depth, len(history)) and tuple(history[len(history) - d - 1 :]) in kept:
            d += 1
        return log10p(tuple(history[len(history) - d :]), w)

    out = [(sum(math.log10(single[w] + 1) - total for w in s), sum(longest(s[:i], s[i]) for i in range(len(s))), sum(single[w] > 0 for w in s)) for s in map(split, texts)]
    return out, Counter(map(len, kept))


def chained(r, n):
    words = [f"w{k}" for k in range(12)]
    t = [r.choice(words)]
    while len(t) < n:  # the next word hangs on the last one to three
        k = r.choice((1, 1, 2, 3))
        t.append(words[(sum(int(w[1:]) for w in t[-k:]) * 5 + r.choice((0, 0, 0, 1))) % 12] if r.random() < 0.8 else r.choice(words))
    return " ".join(t)


@pytest.mark.parametrize(("least", "head"), [(1, 1.0), (2, 0.003), (2, 0.0)])
def test_suffix_tree_tables_by_brute_force(spark, least, head):
    """Whether a value is broadcast or joined, the scores are those of dictionaries of every context."""
    r = random.Random(22)
    texts = [None, "", "w1", "W1 w2 unseen w3", *(chained(r, r.randint(5, 40)) for _ in range(120))]
    texts += [" ".join(f"rare{i}" for i in range(9))] * 4 + ["rare1 rare2 rare3 rare4 w1 rare5", "unseen2"]
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    docs = docs.union(docs.filter("doc_id = 5"))
    params = pst_tables.Params(depth=4, least=least, nats=0.01, evidence=3.0, head=head, rounds=2)
    model = pst_tables.fit(docs.filter("doc_id % 7 <> 3"), params=params)
    train = [t for i, t in enumerate(texts) if i % 7 != 3] + [texts[5]] * (5 % 7 != 3)
    want, sizes = brute_scores(train, texts, params)
    assert {1, 2, 3} <= set(sizes)
    got = pst_tables.score(docs, model).collect()
    assert sorted(g["doc_id"] for g in got) == sorted([*range(len(texts)), 5])
    for g in got:
        base, own, known = want[g["doc_id"]]
        assert math.isclose(g["base_score"], base, rel_tol=1e-9) and math.isclose(g["score"], own, rel_tol=1e-9), g
        assert g["n_known"] == known
    none = pst_tables.fit(docs.limit(0), params=params)
    assert pst_tables.score(docs, none).filter("score <> 0 or base_score <> 0 or n_known <> 0").count() == 0
    assert pst_tables.score(docs.limit(0), model).count() == 0


def test_suffix_tree_levels_are_arrays_by_bucket(spark, monkeypatch):
    """Dealt to several tasks the scores are the same, and no table of a level has a row for each pair."""
    r = random.Random(23)
    texts = [chained(r, r.randint(5, 40)) for _ in range(150)] + ["", None, "unseen"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    params = pst_tables.Params(depth=3, nats=0.01, evidence=3.0, head=0.01, part=500)
    rows, write = {}, pst_tables.materialize

    def counted(df, label):
        out = write(df, label)
        rows[label] = out.count()
        return out

    monkeypatch.setattr(pst_tables, "materialize", counted)
    model = pst_tables.fit(docs.filter("doc_id % 5 <> 0"), params=params)
    got = pst_tables.score(docs, model).collect()
    want, _ = brute_scores([t for i, t in enumerate(texts) if i % 5], texts, params)
    assert model.parts > 3 and len(got) == len(texts)
    assert all(math.isclose(g["score"], want[g["doc_id"]][1], rel_tol=1e-9) and math.isclose(g["base_score"], want[g["doc_id"]][0], rel_tol=1e-9) for g in got)
    # of each task that counts, a row for each bucket and kind at most
    assert rows["op3-level3"] <= 4 * model.parts * model.parts and rows["op3-level3"] < pst_tables._size(model.lookup, "key") / 2


def test_suffix_tree_words_are_kept_once_for_many_steps(spark):
    """A row of numbered texts covers many steps, so the hashes of its words are written once and not for each step."""
    texts = [" ".join(f"w{(i * j) % 700}" for i in range(300_000)) for j in (1, 3, 11)] + [None, "w1 w2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = pst_tables._tokens(docs).collect()
    assert len(rows) == 1 and len(rows[0]["own"]) == 8 * 701
    own, codes, lengths = next(pst_tables._numbers(iter([pa.RecordBatch.from_pylist([r.asDict() for r in rows])])))
    assert sorted(lengths.tolist()) == [1, 3, 300_001, 300_001, 300_001]
    want = Counter(int(pst_tables._hashed(pa.array([w.encode()], pa.large_binary()))[0]) for w in set(" ".join(t or "" for t in texts).split()) | {""})
    assert want.keys() == set(own.tolist()) and np.bincount(codes).tolist() == sorted(np.bincount(codes).tolist(), reverse=True)


def test_suffix_tree_levels_and_scores_take_turns(spark, monkeypatch):
    """What a level shuffles and what a part of the texts joins have a bound for each token; the scores are the same."""
    r = random.Random(24)
    texts = [chained(r, r.randint(5, 40)) for _ in range(120)] + ["", None, "unseen"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    params = pst_tables.Params(depth=3, nats=0.01, evidence=3.0, head=0.01, part=500, rounds=1, turn=0.3, joined=0.5)
    labels, write = Counter(), pst_tables.materialize

    def counted(df, label):
        labels[label] += 1
        return write(df, label)

    monkeypatch.setattr(pst_tables, "materialize", counted)
    model = pst_tables.fit(docs.filter("doc_id % 5 <> 0"), params=params)
    got = pst_tables.score(docs, model).collect()
    want, _ = brute_scores([t for i, t in enumerate(texts) if i % 5], texts, params)
    assert labels["op3-level1"] == 4 and labels["op3-level2"] > 1 and labels["op3-rows"] > 1 and len(got) == len(texts)
    assert all(math.isclose(g["score"], want[g["doc_id"]][1], rel_tol=1e-9) and math.isclose(g["base_score"], want[g["doc_id"]][0], rel_tol=1e-9) for g in got)


def test_keys_in_order_and_their_hashes():
    r = np.random.default_rng(5)
    for keys in (r.integers(0, 1 << 63, 5000).astype(np.uint64), r.integers(0, 40, 5000).astype(np.uint64), np.zeros(0, np.uint64), np.ones(1, np.uint64)):
        assert (pst_tables._order(keys) == np.argsort(keys, kind="stable")).all()
        index = pst_tables.Index(held := keys[pst_tables._order(pst_tables._turned(keys))])
        assert (held[index.find(keys)] == keys).all() and (index.find(np.array([1 << 63], np.uint64)) == -1).all()
        bucket = (keys % np.uint64(7)).astype(np.int64)
        order = pst_tables._side_by_side(bucket, keys, pst_tables.mixed(keys))
        assert sorted(order.tolist()) == list(range(len(keys))) and (np.diff(bucket[order]) >= 0).all()
    # keys of one bucket have their highest bits in common, and are found as fast
    near = r.integers(0, 1 << 40, 20_000).astype(np.uint64)
    index = pst_tables.Index(near[pst_tables._order(pst_tables._turned(near))])
    assert np.diff(index.start).max() < 20
    words = [b"\0", b"a", b"ab", b"ba", b"b\0", b"x" * 300, b"x" * 300 + b"y", b"x" * 299 + b"yx", b"x" * 301]
    found = pst_tables._hashed(pa.array([*words, b""], pa.large_binary()))
    assert len(set(found.tolist())) == 10 and found[-1] == pst_tables.END and 0 not in found
    assert (pst_tables._hashed(pa.array(words, pa.large_binary()).slice(3)) == found[3:9]).all()


def test_suffix_tree_query_keeps_what_a_share_would_drop(spark, tmp_path):
    """Three copies of a passage count, however many other tokens there are."""
    passage = " ".join(f"p{i}" for i in range(30))
    train = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = next(i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(train[0], "x y " * 300_000), *((i, passage) for i in [*train[1:4], held])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in catalog.op3_suffix_tree(spark, str(tmp_path)).collect()}
    assert got[held]["held_out"] and got[held]["score"] == pytest.approx(got[train[1]]["score"])
    assert got[held]["score"] > got[held]["base_score"] / 2


def test_forward_backward_by_brute_force():
    r = np.random.default_rng(1)
    lengths = np.array([3, 0, 1, 5])
    scores, trans = r.normal(size=(9, 3)), r.normal(size=(3, 3))
    some = np.flatnonzero(lengths)
    _, alive, place = crf_langid.packing(lengths[some])
    packed, _ = crf_langid.marginals(scores[place], trans, alive)
    m = np.empty_like(packed)
    m[place] = packed
    at = 0
    for n in lengths[some]:
        want = np.zeros((n, 3))
        for path in np.ndindex(*[3] * n):
            w = math.exp(sum(scores[at + i, y] for i, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:], strict=False)))
            for i, y in enumerate(path):
                want[i, y] += w
        assert np.allclose(m[at : at + n], want / want.sum(axis=1, keepdims=True), atol=1e-4)
        at += n


def test_language_id_held_out_and_edges(spark):
    rows = [(i, text(EN if i % 2 else DE, 12), "en" if i % 2 else "de") for i in range(120)]
    rows += [(200, None, "en"), (201, "", "en"), (202, "123 --- 456", "de"), (203, text(EN, 20) + " " + text(DE, 5), None), (204, "the " * 20000, None), (204, "the " * 20000, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    held = crf_langid.fold(docs, 5) == 0
    model = crf_langid.fit(docs.filter(~held))
    got = {r["doc_id"]: r for r in crf_langid.predict(docs, model, spans=True).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows if i < 120)
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (200, 201, 202)] == [("und", 0.0)] * 3
    assert got[203]["lang_pred"] == got[204]["lang_pred"] == "en" and [s["lang"] for s in got[203]["spans"]] == ["en", "de"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert crf_langid.predict(docs, model).count() == len(rows)
    with pytest.raises(ValueError):
        crf_langid.predict(docs, model, keep=["score"])
    assert crf_langid.fit(docs.filter("false")) is None
    assert {r["lang_pred"] for r in crf_langid.predict(docs, None).collect()} == {"und"}
    assert crf_langid.predict(docs.limit(0), model).count() == 0


def test_gradient_by_differences():
    """Label marginals less the gold labels are the gradient of the negative log-likelihood."""
    r = np.random.default_rng(3)
    scores, trans, gold = r.normal(size=(5, 3)), r.normal(size=(3, 3)), [0, 2, 2, 1, 0]

    def loss(s, t):
        paths = [sum(s[i, y] for i, y in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:], strict=False)) for p in np.ndindex(*[3] * 5)]
        own = sum(s[i, y] for i, y in enumerate(gold)) + sum(t[a, b] for a, b in zip(gold, gold[1:], strict=False))
        return np.logaddexp.reduce(paths) - own

    m, pairs = crf_langid.marginals(scores, trans, np.ones(5, int))
    m, seen = m.astype(float), np.zeros((3, 3))
    m[np.arange(5), gold] -= 1
    np.add.at(seen, (gold[:-1], gold[1:]), 1)
    for k in np.ndindex(5, 3):
        d = np.zeros((5, 3))
        d[k] = 1e-5
        assert math.isclose(m[k], (loss(scores + d, trans) - loss(scores - d, trans)) / 2e-5, abs_tol=1e-4)
    for k in np.ndindex(3, 3):
        d = np.zeros((3, 3))
        d[k] = 1e-5
        assert math.isclose(pairs[k] - seen[k], (loss(scores, trans + d) - loss(scores, trans - d)) / 2e-5, abs_tol=1e-4)
