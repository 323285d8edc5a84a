"""Hand-checked task graphs, placements and generators."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.types import element, wrapped, wrapped_product
from tessera.operators import coherence, dag, generate, history, linalg, policy, ranges
from tessera.plans import array_queries

ACCESS = "task_id long, seq long, mem_id long, mode string"
#: access log, expected (task, dependency, kind)
LOGS = {
    "empty": ([], set()),
    "one task": ([(1, 1, 1, "rw")], set()),
    "diamond": ([(1, 1, 1, "w"), (2, 2, 1, "r"), (2, 2, 2, "w"), (3, 3, 1, "r"), (3, 3, 3, "w"), (4, 4, 2, "r"), (4, 4, 3, "r")], {(2, 1, "raw"), (3, 1, "raw"), (4, 2, "raw"), (4, 3, "raw")}),
    "two writers": ([(1, 1, 1, "w"), (2, 2, 1, "w")], {(2, 1, "waw")}),
    "readers then writer": ([(1, 1, 1, "w"), (2, 2, 1, "r"), (3, 3, 1, "r"), (4, 4, 1, "w")], {(2, 1, "raw"), (3, 1, "raw"), (4, 2, "war"), (4, 3, "war")}),
    "write after own read": ([(1, 1, 1, "r"), (1, 2, 1, "w")], set()),
    "read and write": ([(1, 1, 1, "rw"), (2, 2, 1, "rw"), (3, 3, 1, "r")], {(2, 1, "raw"), (3, 2, "raw")}),
}


@pytest.mark.parametrize("name", LOGS)
def test_auto_dependencies(spark, name):
    log, want = LOGS[name]
    got = dag.auto_dependencies(spark.createDataFrame(log, ACCESS)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_levels_of_five_tasks(spark):
    task = spark.createDataFrame([(n,) for n in (2, 3, 4, 5, 6)], "task_id long")
    dep = spark.createDataFrame([(4, 3), (5, 2), (5, 4), (6, 2)], "task_id long, dep_id long")
    levelled = dag.levels(task, dep)
    assert {tuple(r) for r in levelled.select("task_id", "level").collect()} == {(2, 0), (3, 0), (4, 1), (6, 1), (5, 2)}
    one = dag.parallelism(levelled).first()
    assert (one["height"], one["widest"]) == (3, 2) and one["mean_width"] == pytest.approx(5 / 3)
    assert dag.levels(task.limit(0), dep.limit(0)).count() == 0
    with pytest.raises(ValueError):
        dag.levels(task, dep.union(spark.createDataFrame([(3, 5)], dep.schema)))


def test_levels_by_brute_force(spark):
    r = random.Random(6)
    for n in (1, 45):
        edges = {(i, r.randint(max(0, i - 4), i - 1)) for i in range(1, n) for _ in range(r.choice([1, 1, 1, 2]))} | {(900 + i, 899 + i) for i in range(1, 40)} | {(3, 77)}
        ids = [*range(n), *range(900, 940), 899]
        want = {}
        for i in sorted(set(ids) | {899}):
            want[i] = max((want[d] + 1 for t, d in edges if t == i and d in want), default=0)
        task, dep = spark.createDataFrame([(i,) for i in set(ids)], "task_id long"), spark.createDataFrame([e for e in edges if e[0] in ids and (e[1] in ids or e[1] == 77)], "task_id long, dep_id long")
        assert {x["task_id"]: x["level"] for x in dag.levels(task, dep).collect()} == want
    for ring in ([(1, 3), (2, 1), (3, 2)], [(1, 3), (2, 1), (3, 2), (4, 3), (4, 2)]):
        with pytest.raises(ValueError):
            dag.levels(spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "task_id long"), spark.createDataFrame(ring, "task_id long, dep_id long"))


def test_difference_and_both_ways(spark):
    pairs = "task_id long, dep_id long"
    manual, inferred = spark.createDataFrame([(2, 1), (3, 1), (2, 1)], pairs), spark.createDataFrame([(2, 1), (3, 2)], pairs)
    assert {tuple(r) for r in dag.difference(manual, inferred).collect()} == {(3, 1, "extra"), (3, 2, "missing")}
    assert {tuple(r) for r in dag.both_ways(inferred).collect()} == {(2, 1), (1, 2), (3, 2), (2, 3)}


DEVICES = [(0, "cpu", "host"), (1, "nvidia", "a"), (2, "amd", "b"), (3, "nvidia", "c")]


def test_round_robin_goes_in_order(spark):
    task = spark.createDataFrame([(i, 7 * i % 100) for i in range(100)], "task_id long, seq long")
    device = policy.devices(spark, DEVICES)
    placed = {r["task_id"]: r["devno"] for r in policy.round_robin(task, device, buckets=8).collect()}
    ordered = [r["task_id"] for r in task.orderBy("seq").collect()]
    assert [placed[t] for t in ordered] == [i % 4 for i in range(100)]
    gpus = {r["task_id"]: r["devno"] for r in policy.round_robin(task, device, policy.GPU, buckets=8).collect()}
    assert [gpus[t] for t in ordered] == [1 + i % 3 for i in range(100)]


def test_unsupported_kernels_fall_back(spark):
    task = spark.createDataFrame([(1, "k"), (2, "none")], "task_id long, kernel string")
    able = policy.eligible(task, spark.createDataFrame([("k", 2), ("k", 3)], "kernel string, devno int"))
    assert {tuple(r) for r in policy.first(task, able).collect()} == {(1, 2), (2, 0)}
    assert {tuple(r) for r in policy.last(task, able).collect()} == {(1, 3), (2, 0)}
    assert {tuple(r) for r in policy.everywhere(task, able).collect()} == {(1, 2), (1, 3), (2, 0)}


def test_long_groups_in_ranges(spark, monkeypatch):
    r = random.Random(8)
    rows = [(i, r.randint(0, 40), r.choice([1, 1, 1, 2, None]), r.choice("r r w rw".split()), r.choice([None, 0, 1, 2, 3, 1000])) for i in range(400)]
    df = spark.createDataFrame(rows, "task_id long, seq long, mem_id long, mode string, duration long")
    for buckets in (1, 7, 256):
        monkeypatch.setattr(ranges.with_range, "__defaults__", (buckets,))
        groups = defaultdict(list)
        for x in sorted(rows, key=lambda x: (x[1], x[0])):
            groups[x[2]].append(x)
        epochs = {x["task_id"]: (x["epoch"], x["last_writer"]) for x in dag.with_epochs(df).collect()}
        nth = {x["task_id"]: x["nth"] for x in history.ranked(df, "seq", "task_id", "mem_id").collect()}
        means = {x["task_id"]: x["running_mean"] for x in history.running_mean(df, "mem_id", order="task_id").collect()}
        for g in groups.values():
            writes = []
            for k, x in enumerate(g):
                assert epochs[x[0]] == (len(writes), writes[-1] if writes else None) and nth[x[0]] == k + 1
                if x[3] != "r":
                    writes.append(x[0])
            so_far = []
            for x in sorted(g):
                so_far += [x[4]] * (x[4] is not None)
                assert means[x[0]] == (pytest.approx(sum(so_far) / len(so_far)) if so_far else None)
        assert {x["mem_id"]: x["median"] for x in history.medians(df, "duration", "mem_id").collect()} == {k: np.median([x[4] for x in g if x[4] is not None]) for k, g in groups.items()}
    assert dag.with_epochs(df.limit(0)).count() == history.running_mean(df.limit(0), "mem_id", order="seq").count() == 0


def test_medians_of_many_values(spark):
    values = np.random.default_rng(2).lognormal(size=20_001)
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(values)], "k int, v double")
    assert {x["k"]: x["median"] for x in history.medians(df, "v", "k").collect()} == pytest.approx({0: np.median(values[::2]), 1: np.median(values[1::2])}, rel=1e-12)


def test_grids_and_quantiles(spark):
    assert [linalg.grid_of(n) for n in (1, 2, 4, 5, 6, 8, 9, 12)] == [(1, 1), (1, 2), (2, 2), (1, 5), (2, 3), (2, 4), (3, 3), (3, 4)]
    cells = spark.range(400).selectExpr("id div 20 - 1 as r", "id % 20 as c")
    for n in (1, 4, 6, 7, 12):
        placed = cells.withColumn("d", linalg.block_cyclic(F.col("r"), F.col("c"), n)).collect()
        assert all((x["d"] is None) == (x["r"] < 0) for x in placed) and {x["d"] for x in placed} - {None} == set(range(n))
        at = {(x["r"], x["c"]): x["d"] for x in placed}
        p, q = linalg.grid_of(n)
        assert all(len({at[r + i, c + j] for i in range(p) for j in range(q)}) == n for r in range(13) for c in range(13))
    quantiles = spark.createDataFrame([(0.975,), (0.5,), (0.01,), (1e-6,), (0.0,)], "p double").select(generate.inverse_normal(F.col("p")).alias("z")).collect()
    assert [x["z"] for x in quantiles[:4]] == pytest.approx([1.959963984540054, 0, -2.326347874040841, -4.753424308822899], abs=1e-7) and quantiles[4]["z"] is None
    big = [(1 << 33) + 1, (1 << 33) + 3, 1]
    assert [x["v"] for x in spark.createDataFrame([(i,) for i in big], "i long").select(generate.radical_inverse(F.col("i")).alias("v")).collect()] == [2.0**-1 + 2.0**-34, 2.0**-1 + 2.0**-2 + 2.0**-34, 0.5]


def test_poisson_fit_by_newton(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 2))
    y = r.poisson(np.exp(1 + x @ [0.5, -0.3]))
    fit = history.poisson_fit(spark.createDataFrame([(int(b), *map(float, a)) for a, b in zip(x, y, strict=True)], "y long, u double, v double"), "y", "u", "v")
    design, beta = np.column_stack([np.ones(400), x]), np.zeros(3)
    for _ in range(50):
        mu = np.exp(design @ beta)
        beta = beta + np.linalg.solve(design.T @ (mu[:, None] * design), design.T @ (y - mu))
    assert fit["coefficients"] == pytest.approx(beta, abs=1e-6) and fit["n"] == 400
    assert fit["dispersion"] == pytest.approx(((y - mu) ** 2 / mu).sum() / 397, rel=1e-6)


def test_generators(spark):
    values = lambda df: [r["v"] for r in df.orderBy("i").collect()]
    assert values(generate.arithmetic(spark, 4, 3, 2)) == [3, 5, 7, 9]
    assert values(generate.fill(spark, 3, 1.5)) == [1.5] * 3
    assert values(generate.memset(spark, 2, 1)) == [0x01010101] * 2
    drawn = generate.uniform(spark, 1000, -1.0, 1.0, 5)
    ends = drawn.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    assert -1 <= ends["lo"] < ends["hi"] < 1
    assert values(drawn) == values(generate.uniform(spark, 1000, -1.0, 1.0, 5))


def test_wrapped_products_of_large_factors(spark):
    top, low = 2**63 - 1, -(2**63)
    cells = [(9_000_000, 1_200_000), (top, top), (low, low), (low, 3), (-7, 5), (0, top), (2**40 + 3, -(2**33) - 1), (None, 4)]
    kinds = {"int8": 8, "int32": 32, "uint32": 32, "uint16": 16, "int64": 64, "uint64": 64}
    a, b = F.col("a"), F.col("b")
    got = spark.createDataFrame(cells, "a long, b long").select("a", "b", wrapped(a, element("int32")).alias("one"), *[wrapped_product(element(k), a, b, F.lit(1000003)).alias(k) for k in kinds]).collect()
    for r, (x, y) in zip(got, cells, strict=True):
        fold = lambda v, bits, signed: None if v is None else (v + signed * 2 ** (bits - 1)) % 2**bits - signed * 2 ** (bits - 1)
        product = None if x is None else x * y * 1000003
        assert r["one"] == fold(x, 32, 1)
        assert [r[k] if r[k] is None else int(r[k]) for k in kinds] == [fold(product, bits, not k.startswith("u")) for k, bits in kinds.items()]


def test_wrapping_product_query_on_large_keys(spark, tmp_path):
    lines = spark.createDataFrame([(9_000_000, 1_200_000, 1, 1), (5, 7, 1, 2)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    want = {(k * p * 1000003 + 2**31) % 2**32 - 2**31 for k, p in ((9_000_000, 1_200_000), (5, 7))}
    assert {r["w"] for r in array_queries.wrapping_product(spark, str(tmp_path)).collect()} == want


def test_blocked_product_of_any_shape(spark):
    """Against numpy; stored cells as ``gemm`` has them; no group of the join beyond a lane."""
    r = np.random.default_rng(4)
    cells = lambda m: spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in np.argwhere(m)], "i long, j long, v double")
    for shape, seed in (((300, 5, 7), 0.9), ((3, 40, 300), 0.3), ((9, 9, 9), 0.1)):
        x, y = (np.round(r.normal(size=s) * 9) * (r.random(s) < seed) for s in (shape[:2], shape[1:]))
        got = {(q["i"], q["j"]): q["v"] for q in linalg.blocked_gemm(cells(x), cells(y), 4).collect()}
        assert set(got) == {(i, j) for i, j in np.argwhere((x != 0).astype(int) @ (y != 0).astype(int))}
        assert all(got[k] == (x @ y)[k] for k in got)
    assert linalg.blocked_gemm(cells(x).limit(0), cells(y), 4).count() == 0
    twice = linalg.blocked_gemm(cells(x).union(cells(x)), cells(y), 4)
    assert {(q["i"], q["j"]): q["v"] for q in twice.collect()} == {k: 2 * v for k, v in got.items()}


def test_blocked_product_deals_tall_matrices(spark):
    n, tile = 4 * linalg.LANE * 2, 2
    m = spark.range(n).select(F.col("id").alias("i"), (F.col("id") % 2).alias("j"), F.col("id").cast("double").alias("v"))
    one = spark.createDataFrame([(0, 0, 2.0), (1, 0, 2.0)], "i long, j long, v double")
    plan = linalg.blocked_gemm(m, one, tile)
    assert plan.agg(F.sum("v")).first()[0] == n * (n - 1)
    joins = [line for line in plan._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line and "tk#" in line]
    assert len(joins) == 1 and "la#" in joins[0] and "lb#" in joins[0]  # not by the inner index alone


RANGE = "id long, mem_id long, off long, size long"


def test_range_overlaps_by_brute_force(spark, monkeypatch):
    """Packs and lots of a few ranges; equal starts, offsets below zero, nulls, twins, empty ranges."""
    monkeypatch.setattr(coherence, "PACK", 3)
    monkeypatch.setattr(coherence, "LOT", 7)
    rng = random.Random(9)
    some = lambda n: [(i, rng.randrange(3), rng.choice([0, 5, rng.randrange(-40, 60)]), rng.choice([-1, 0, 1, 9, rng.randrange(40)])) for i in range(n)]
    a, b = some(150) + [(900, None, 1, 5), (901, 1, None, 5), (902, 1, 1, None), (903, 1, 3, 8), (903, 1, 3, 8), (None, 1, 3, 8)], some(130)
    want = [
        (m, i, j, max(o, p), min(o + s, p + t) - max(o, p))
        for i, m, o, s in a
        for j, n, p, t in b
        if None not in (m, o, s) and m == n and s > 0 and t > 0 and o < p + t and p < o + s
    ]
    got = coherence.range_overlaps(spark.createDataFrame(a, RANGE), spark.createDataFrame(b, RANGE), 16)
    assert got.columns == ["mem_id", "id_a", "id_b", "off", "size"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and len(want) > 500


def test_range_overlaps_take_little_disk(spark, tmp_path):
    """The pairs of dense ranges, written, take under a byte each."""
    dense = spark.range(12_000).select("id", F.lit(1).cast("long").alias("mem_id"), (F.col("id") * 7919 % 100).alias("off"), (1 + F.col("id") * 104_729 % 97).alias("size"))
    coherence.range_overlaps(dense.filter("id % 2 = 0"), dense.filter("id % 2 = 1"), 64).write.parquet(str(tmp_path / "out"))
    n = spark.read.parquet(str(tmp_path / "out")).count()
    assert n > 10_000_000 and sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < n
