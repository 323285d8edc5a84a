"""Operators 6, 7, 8 and 10 and the pipeline, against brute force on small tables."""

import hashlib
import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tessera.llm import bpe, decontaminate, jaccard_join, kdshard, suffix_dedup
from tessera.llm.components import components

rng = random.Random(2)
WORDS = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 8))) for _ in range(400)]


def text(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    base = [text(rng.randint(20, 120)) for _ in range(40)]
    out = list(base)
    for b in base[:12]:  # near copies with a few words changed
        for k in range(rng.randint(1, 6)):
            w = b.split()
            for _ in range(k):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            out.append(" ".join(w))
    passage = text(90)
    out += [f"{text(20)} {passage} {text(25)}" for _ in range(6)]
    out += [base[0]] * 5 + ["one", "one", "One two", "a b c", "a b c", None, "", " \n", "x" * 1500, "ab" * 700, base[3].upper()]
    return out


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", f"s{i % 3}", len(t or ""), "z") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, row string")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_components(texts, k, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    top = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = top[a], top[b]
            top = [min(x, y) if t in (x, y) else t for t in top]
    return [len(s) for s in sets], top


@pytest.mark.parametrize(("k", "percent", "block"), [(4, 85, 512), (5, 80, 512), (4, 60, 3)])
def test_jaccard_components(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    texts = corpus()
    docs = docs_of(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs, params=jaccard_join.Params(k, percent)).collect()}
    sizes, tops = brute_components(texts, k, percent)
    assert got == {i: (n, t) for i, (n, t) in enumerate(zip(sizes, tops, strict=True))}


def test_jaccard_of_short_texts_less_a_word_at_either_end(spark):
    texts = []
    for n in range(4, 17):
        for cut in (slice(1, None), slice(0, -1)):
            for _ in range(4):
                words = [f"w{len(texts)}x{i}" for i in range(n)]
                texts += [" ".join(words), " ".join(words[cut])]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs_of(spark, texts)).collect()}
    sizes, tops = brute_components(texts, 4, 85)
    assert got == {i: (n, t) for i, (n, t) in enumerate(zip(sizes, tops, strict=True))}


@pytest.mark.parametrize("percent", [60, 80, 85, 90, 99])
def test_jaccard_first_reading_settles_no_linked_class(percent):
    kept = [jaccard_join._least_kept(n, percent) for n in range(301)]
    for a in range(1, 301):
        for b in range(a * percent // 100, min(301, a * 100 // percent + 1)):
            overlap = -(-percent * (a + b) // (100 + percent))
            if overlap <= min(a, b) and kept[b] < b:
                # of a: the members that b hasn't, and those that b has and didn't keep
                assert kept[a] - kept[b] + b - overlap < jaccard_join._prefix(a, percent), (a, b)


def test_jaccard_empty_and_repeated(spark):
    docs = docs_of(spark, ["a b c d e", None])
    assert jaccard_join.near_duplicates(docs.limit(0)).count() == 0
    twice = jaccard_join.near_duplicates(docs.union(docs)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in twice) == [(0, 2, 0), (0, 2, 0), (1, 0, 1), (1, 0, 1)]


def test_jaccard_of_long_texts(spark):
    long = text(40_000).split()
    near = [*long[:15_000], "zz", *long[15_001:]]
    docs = docs_of(spark, [" ".join(x) for x in (long, near, long[:20_000], near)])
    assert sorted((r["doc_id"], r["component_id"]) for r in jaccard_join.near_duplicates(docs).collect()) == [(0, 0), (1, 0), (2, 2), (3, 0)]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5), (1, 2)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{k: 1 for k in (1, 2, 3, 7, 8, 9)}, 20: 20, 21: 20, **{k: 100 for k in range(100, 141)}}


def brute_repeats(texts, n):
    data, seen = [(t or "").encode() for t in texts], defaultdict(int)
    for d in data:
        for i in range(len(d) - n + 1):
            seen[d[i : i + n]] += 1
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - n + 1):
            if seen[d[i : i + n]] > 1:
                gone[i : i + n] = True
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        out.append((len(d), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "most"), [(400, 20_000), (60, 20_000), (60, 3)])
def test_suffix_dedup(spark, length, most):
    texts = corpus()
    got = suffix_dedup.digest(docs_of(spark, texts), params=suffix_dedup.Params(length, most)).collect()
    want = brute_repeats(texts, length)
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]], r["doc_id"]


def test_suffix_dedup_edges(spark):
    docs = docs_of(spark, [None, "", "x" * 450])
    assert suffix_dedup.digest(docs.limit(0)).count() == 0
    both = suffix_dedup.digest(docs.union(docs)).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in both) == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 450), (2, 450)]


def test_maximal_groups_by_brute_force():
    r = random.Random(4)
    for trial in range(400):
        m, width = r.randint(2, 14), 1 + trial % 2
        draw = lambda: b"".join(r.choice((b"a" * width, b"b" * width)) for _ in range(r.randint(0, 9)))  # noqa: E731, B023
        right, left = [draw() for _ in range(m)], [draw() for _ in range(m)]
        side = r.randint(0, 9)
        both = lambda strings, who: min(suffix_dedup.common(strings[who[0]], strings[i]) for i in who) // width  # noqa: E731, B023
        want = set()
        for i in range(m):
            for b in range(len(left[i]) // width + 1):
                for a in range(len(right[i]) // width + 1):
                    same = [j for j in range(m) if left[j][: b * width] == left[i][: b * width] and right[j][: a * width] == right[i][: a * width]]
                    if len(same) > 1 and a + b >= side and (both(left, same), both(right, same)) == (b, a):
                        want.add((tuple(same), b, a))
        got = [(tuple(sorted(members)), b, a) for members, b, a in suffix_dedup.maximal_groups(right, left, side, width)]
        assert len(got) == len(set(got)) and set(got) == want


def brute_words(texts, n):
    """Of each text, whether each word lies in a string of n words that also starts elsewhere."""
    words, seen = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for t in texts], defaultdict(int)
    for w in words:
        for i in range(len(w) - n + 1):
            seen[tuple(w[i : i + n])] += 1
    out = []
    for w in words:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("most", [20_000, 3])
def test_repeated_words(spark, most):
    texts = corpus() + [base := text(70), base.upper().replace(" ", "  "), " ".join("ab" for _ in range(200)), f"{text(9)} {base} {text(9)}"]
    docs = docs_of(spark, texts)
    want = brute_words(texts, 51)
    params = suffix_dedup.Params(51, most, True)
    for r in suffix_dedup.digest(docs, passages=params).collect():
        gone = want[r["doc_id"]]
        assert (r["passage_words"], r["n_passages"]) == (gone.sum(), (np.diff(np.append(0, gone.astype(int))) == 1).sum()), r["doc_id"]
    for r in suffix_dedup.remove_repeats(docs, params=(params,)).collect():
        old, gone = texts[r["doc_id"]], want[r["doc_id"]]
        assert r["text"] == old if not gone.any() else r["text"].split() == [w for w, g in zip(old.split(), gone, strict=True) if not g]


def test_one_occurrence_stays(spark):
    texts = [t for t in corpus() if t] + [f"{text(3)} {'xyz ' * 300}"]
    texts = list(dict.fromkeys(texts))  # no copies of whole texts
    docs = docs_of(spark, texts).withColumnsRenamed({"row": "c0", "source": "spans"})
    for most in (20_000, 3):
        params = suffix_dedup.Params(51, most, True)
        kept = {r["doc_id"]: r["text"] for r in suffix_dedup.remove_repeats(docs, params=(params,), keep_first=True).collect()}
        before, after = ({tuple(w[i : i + 5]) for t in ts for w in [lower(t).split()] for i in range(len(w) - 4)} for ts in (texts, kept.values()))
        assert len(before - after) < 0.1 * len(before)  # but for those that hang over a cut
        assert sum(map(len, kept.values())) < sum(map(len, texts))
        passage = next(iter({t[-400:-100] for t in texts if "xyz" not in t and sum(t[-400:-100] in u for u in texts) > 3}), None)
        assert passage is None or sum(passage in t for t in kept.values()) >= 1


@pytest.mark.parametrize("most", [20_000, 3])
def test_repeat_groups(spark, most):
    texts = [t for t in corpus() if t]
    params = suffix_dedup.Params(60, most)
    rows = suffix_dedup.repeat_groups(docs_of(spark, texts), params=params).collect()
    groups, covered = defaultdict(set), defaultdict(set)
    for r in rows:
        data = texts[r["doc_id"]].encode()[r["start"] : r["stop"]]
        groups[r["group"]].add((r["doc_id"], r["start"], data))
        covered[r["doc_id"]] |= set(range(r["start"], r["stop"]))
        assert len(data) == r["stop"] - r["start"] >= 60
    for r in rows:
        assert r["n_occurrences"] == len(groups[r["group"]]) > 1
    for members in groups.values():  # all occurrences of the string, and no other string
        strings = {data for _, _, data in members}
        assert len(strings) == 1
        string = next(iter(strings))
        at = {(i, m.start()) for i, t in enumerate(texts) for m in re.finditer(b"(?=" + re.escape(string) + b")", t.encode())}
        assert {(i, a) for i, a, _ in members} == at
    for i, (_, gone, _, _) in enumerate(brute_repeats(texts, 60)):
        assert len(covered[i]) == gone


def test_wand_by_brute_force():
    r = random.Random(3)
    vocabulary = [f"w{i}".encode() for i in range(60)]
    weights = [1 / (j + 1) for j in range(60)]
    for n in (1, 5, 80, 200):
        items = [(i, b" ".join(r.choices(vocabulary, weights, k=r.randint(1, 20))).decode()) for i in range(n)]
        df = defaultdict(int)
        for _, t in items:
            for w in set(decontaminate.words(t)):
                df[w] += 1
        index = decontaminate.BlockMaxIndex(items, df, n, sum(len(decontaminate.words(t)) for _, t in items) / n, decontaminate.Params(block=r.choice([2, 4, 32])))
        for _ in range(40):
            terms, least = set(r.choices(vocabulary, weights, k=r.randint(1, 40))), r.choice([0.3, 0.6, 0.9])
            want = defaultdict(float)
            for x in terms & index.terms.keys():
                for i, w in zip(*index.terms[x], strict=True):
                    want[int(i)] += w
            assert sorted((i, round(s, 6)) for i, s in index.search(terms, least)) == sorted((i, round(s, 6)) for i, s in want.items() if s >= least - 1e-9)


def test_leaks(spark, monkeypatch):
    items = [text(rng.randint(6, 50)) + ".\n" + text(rng.randint(1, 9)) for _ in range(30)] + ["", None, "one two three"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    texts, want = [], set()
    for i in range(60):
        if i % 3 == 0:
            texts.append(f"{text(rng.randint(0, 300))} {items[i // 3]}%% {text(rng.randint(0, 200))}")
            want.add((i, i // 3))
        else:
            texts.append(text(rng.randint(1, 300)))
    texts += [None, "", items[4], items[4]]
    want |= {(62, 4), (63, 4)}
    docs = docs_of(spark, texts)
    found = []
    for words in (decontaminate.INDEX_WORDS, 300):  # one slice of the index, or several
        monkeypatch.setattr(decontaminate, "INDEX_WORDS", words)
        found.append(sorted(map(tuple, decontaminate.leaks(docs, bench).collect())))
        assert {r[:2] for r in found[-1]} == want
    assert found[0] == found[1]  # whole rows
    long = f"{text(30_000)} {items[7]} {text(30_000)}"
    more = spark.createDataFrame([(None, items[5], "x"), (1, long, "x"), (1, long, "x"), (2, None, None)], "doc_id long, text string, item_id string")
    rows = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(more, bench).collect()}
    assert set(rows) == {(None, 5), (1, 7)} and rows[1, 7]["first_word"] > 29_000
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.leaks(docs.limit(0), bench).count() == 0


def test_sharding(spark):
    texts = corpus() + [text(rng.randint(1, 60)) for _ in range(1500)]
    out = kdshard.shard(docs_of(spark, texts), shards=7).toPandas()
    assert sorted(out["doc_id"]) == list(range(len(texts))) and set(out["shard"]) == set(range(7))
    assert list(out.sort_values("doc_id")["size"]) == [len((t or "").encode()) + 16 for t in texts]
    for _, s in out.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
    bytes_ = out.groupby("shard")["size"].sum()
    assert bytes_.max() - bytes_.min() < 0.05 * bytes_.mean()
    hot = kdshard.shard(docs_of(spark, ["same text"] * 700 + texts[:300]), shards=5).toPandas()
    assert hot.groupby("shard")["size"].sum().max() < 1.2 * hot["size"].sum() / 5
    assert kdshard.shard(docs_of(spark, texts).limit(0), shards=3).count() == 0
    assert sorted(r["slot"] for r in kdshard.shard(docs_of(spark, [None]).union(docs_of(spark, [None])), shards=1).collect()) == [0, 1]


def test_sharding_tree_by_brute_force(spark):
    r, shards = random.Random(9), 11
    rows = [(r.randint(1, 300), *((r.randint(0, top) << 31) + r.getrandbits(31) for top in (1000, 3, 40))) for _ in range(600)]
    items = spark.createDataFrame(rows, "bytes long, size_at long, source_at long, lang_at long")
    names = ["bytes", *kdshard.DIMENSIONS]
    widths = [max(x[k] >> 31 for x in rows) - min(x[k] >> 31 for x in rows) for k in (1, 2, 3)]
    goal = sum(x[0] for x in rows) / shards
    leaves = []

    def check(node, rows):
        if node.left is None:
            return leaves.append(node.first)
        spread = [(max(x[k] >> 31 for x in rows) - min(x[k] >> 31 for x in rows)) / widths[k - 1] for k in (1, 2, 3)]
        k = names.index(node.dimension)
        want = sum(x[0] for x in rows) * (node.leaves // 2) / node.leaves
        below = np.append(0, np.cumsum([x[0] for x in sorted(rows, key=lambda x: x[k])]))
        left = [x for x in rows if x[k] < node.cut]
        assert abs(sum(x[0] for x in left) - want) <= max(np.abs(below - want).min(), kdshard.TOLERANCE * goal)  # its weighted median
        off = {j: np.abs(np.append(0, np.cumsum([x[0] for x in sorted(rows, key=lambda x: x[j])])) - want).min() for j in (1, 2, 3)}
        assert spread[k - 1] == max(spread) or off[1 + int(np.argmax(spread))] > kdshard.BALANCED * goal  # the widest dimension
        check(node.left, left)
        check(node.right, [x for x in rows if x[k] >= node.cut])

    check(kdshard.grow_tree(items, shards), rows)
    assert leaves == list(range(shards))


def test_sharding_keeps_equal_texts_together(spark):
    texts = ["same text " * 9] * 60 + ["another one " * 8] * 40 + [text(rng.randint(5, 60)) for _ in range(400)] + [None, "", None]
    docs = spark.createDataFrame([(i % 450, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", i, i) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, shard long, hash long")
    out = kdshard.shard(docs, shards=6).toPandas()
    assert len(out) == len(texts)
    share = out["size"].sum() / 6
    groups = out.groupby("text_crc32").agg({"size": "sum", "shard": "nunique"})
    assert groups["size"].max() < share and (groups["shard"] == 1).all()
    alone = kdshard.shard(docs_of(spark, ["same text"] * 900 + texts[-90:]), shards=6).toPandas()
    same = alone[alone["text_crc32"] == alone["text_crc32"].mode()[0]]
    assert same["size"].sum() > alone["size"].sum() / 6 and same["shard"].nunique() > 1  # more than a shard's share
    assert alone.groupby("shard")["size"].sum().max() < 1.2 * alone["size"].sum() / 6


def test_pipeline_stages_by_brute_force(spark, tmp_path):
    texts = corpus() + ["123 456 --- 789"]
    short = " ".join(f"k{i}" for i in range(55))  # over 50 words in fewer than 400 bytes
    texts += [f"{text(30)} {short} {text(20)}" for _ in range(2)]
    items = [text(30) + ".\n" + text(8) for _ in range(4)]
    texts += [f"{text(40)} {items[1]} {text(30)}"]
    docs = docs_of(spark, texts).withColumnRenamed("row", "score")  # an extra column whose name clashes
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    step = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        step[name] = docs.toPandas()
    columns = ["doc_id", "text", "lang", "source", "n_chars", "score"]
    assert all(list(step[n].columns) == columns for n, _ in corpus_pipeline.STAGES[:-1])
    first = step["language_id"]
    assert set(first["doc_id"]) == {i for i, t in enumerate(texts) if re.search(r"[^\W\d_]", t or "")}
    ordered = first.sort_values("doc_id")
    ids, kept = list(ordered["doc_id"]), list(ordered["text"])
    _, tops = brute_components(kept, 5, 80)
    second = step["ngram_jaccard_join"].sort_values("doc_id")
    assert list(second["doc_id"]) == [ids[i] for i, t in enumerate(tops) if i == t]
    want, in_words = brute_repeats(list(second["text"]), 400), brute_words(list(second["text"]), 51)
    assert any(g.any() and not w[1] for w, g in zip(want, in_words, strict=True))  # a passage of over 50 short words
    third = dict(zip(step["suffix_array_dedup"]["doc_id"], step["suffix_array_dedup"]["text"], strict=True))
    for i, t, w, gone in zip(second["doc_id"], second["text"], want, in_words, strict=True):
        left = third.get(i, "")
        assert len(left.encode()) <= w[0] - w[1] and (w[1] or gone.any() or left == t)
        if not w[1]:
            assert left.split() == [x for x, g in zip(t.split(), gone, strict=True) if not g]
    fourth = step["benchmark_decontamination"]
    assert set(third) - set(fourth["doc_id"]) == {len(texts) - 1}
    last = step["bpe_encoding"].set_index("doc_id")
    assert set(last.index) == set(fourth["doc_id"])
    n, _, _ = bpe.coder(bpe.default_path()).encode(pa.array(list(fourth["text"])))
    assert list(last.loc[fourth["doc_id"], "n_tokens"]) == list(n)


def test_pipeline_edges(spark, tmp_path):
    spark.createDataFrame([(0, "a test question of some words.\nand its answer")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = docs_of(spark, [text(30) for _ in range(30)])
    odd = spark.createDataFrame([(None, text(20), None, None, None, None), (5, text(25), None, "s", 3, "r"), (7, text(9), "en", "s", 3, "r")], docs.schema)
    docs = docs.unionByName(odd).unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    first = corpus_pipeline.identify_language(spark, docs, str(tmp_path)).collect()
    assert len(first) == 36 and sum(r["doc_id"] is None for r in first) == 2
    second = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()
    # repeated rows became one; two texts under one id stayed
    assert len(second) == 33 and sum(r["doc_id"] is None for r in second) == 1 and sum(r["doc_id"] == 5 for r in second) == 2
