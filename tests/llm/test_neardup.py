import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.llm import neardup
from blockloom.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, threshold=0.93):
    """Row by row, from the contract. Rows that repeat id and vector are one vector."""
    def unit(v):
        if v is None or not v or any(x is None for x in v):
            return None
        x = np.array(v, float)
        n = np.sqrt((x * x).sum()) if np.isfinite(x).all() else 0
        return x / n if n else None

    nodes = sorted({(i, tuple(v), l) for i, v, l in rows if i is not None and l is not None and unit(v) is not None})
    units = [unit(list(v)) for _, v, _ in nodes]
    close = [[a != b and nodes[a][2] == nodes[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold for b in range(len(nodes))] for a in range(len(nodes))]
    group = list(range(len(nodes)))
    for _ in nodes:
        for a in range(len(nodes)):
            for b in range(len(nodes)):
                if close[a][b]:
                    group[a] = group[b] = min(group[a], group[b])
    least = {g: min(nodes[k][0] for k in range(len(nodes)) if group[k] == g) for g in group}
    known = {n: (sum(close[k]), least[group[k]]) for k, n in enumerate(nodes)}
    for i, v, l in rows:
        n, c = known.get((i, tuple(v or []), l), (0, i))
        yield i, n, c, i == c


def check(spark, rows):
    d = spark.createDataFrame([(i, v, l, "x") for i, v, l in rows], SCHEMA)
    got = [tuple(r) for r in neardup.dedup_embeddings(d).collect()]
    # floats as stored
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l) for i, v, l in rows]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_groups_of_all_kinds(spark):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for size, spread in [(40, 0.02), (30, 0.2), (25, 0.28), (20, 0.35), (1, 0)] + [(1, 0)] * 60:
        center = rng.normal(size=12)
        for _ in range(size):
            v = center + spread * rng.normal(size=12)
            rows.append((n * 7 % 1009, (v * rng.uniform(0.1, 9)).tolist(), n % 2))
            n += 1
    rows += [(2000 + k, rows[3][1], rows[3][2]) for k in range(70)]  # copies of one vector
    check(spark, rows)


def test_nulls_zeros_and_repeats(spark):
    v, w = [1.0, 0.0, 0.5], [1.0, 0.01, 0.5]
    nan, inf = float("nan"), float("inf")
    rows = [(1, v, 0), (2, w, 0), (3, v, 1), (4, v, None), (5, None, 0), (6, [0.0, 0.0, 0.0], 0), (7, [nan, 1.0, 1.0], 0), (8, [inf, 1.0, 1.0], 0), (9, [None, 1.0, 1.0], 0), (10, [], 0), (11, [1.0, 0.0], 0), (2, w, 0), (None, v, 0), (12, [-1.0, 0.0, -0.5], 0)]
    check(spark, rows)
    check(spark, [(1, v, 0), (1, [0.0, 1.0, 0.0], 0), (1, [0.0, 1.0, 0.1], 0)])
    assert neardup.dedup_embeddings(spark.createDataFrame([], SCHEMA)).collect() == []


def test_blocks_of_components(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PART", 16)
    monkeypatch.setattr(neardup, "BLOCK", 64)
    rng = np.random.default_rng(5)
    check(spark, [(i, (np.ones(8) + 0.12 * rng.normal(size=8)).tolist(), 0) for i in range(150)])


def test_passes_grow_with_the_input():
    assert neardup.passes_for(10) == neardup.passes_for(32) == 4
    assert neardup.passes_for(1000) < neardup.passes_for(100_000) < neardup.passes_for(10**8)


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(-50, 50, (60, 2))] + [(k, k + 1) for k in range(1000, 1040)] + [(-(1 << 62), 1 << 62)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    d = spark.createDataFrame([*edges, (None, 3), (7, 7)], "a long, b long")
    assert {r.node: r.root for r in components(d).collect()} == root


def test_components_with_a_hot_node(spark, monkeypatch):
    monkeypatch.setattr("blockloom.llm.components.HOT_LEAST", 20)
    d = spark.range(1, 600).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") - 1).alias("a"), F.col("id").alias("b"))
    got = components(d).collect()
    assert len(got) == 600 and {r.root for r in got} == {0}
    assert components(d.limit(0)).collect() == []


def cone(rng, rows, planted, common):
    """Unit vectors of mean cosine `common`, and for some of them a partner at cosine 0.94."""
    axis = np.eye(64)[0]
    x = rng.normal(size=(rows, 64))
    x[:, 0] = 0
    x = common**0.5 * axis + (1 - common) ** 0.5 * x / np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.normal(size=(planted, 64))
    away -= (away * x[:planted]).sum(axis=1, keepdims=True) * x[:planted]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    return np.concatenate([x, 0.94 * x[:planted] + (1 - 0.94**2) ** 0.5 * away])


@pytest.mark.parametrize("whole", [4096, 10])
def test_pairs_among_vectors_with_a_common_direction(spark, monkeypatch, whole):
    monkeypatch.setattr(neardup, "WHOLE", whole)
    x = cone(np.random.default_rng(6), 6000, 200, 0.6)
    d = spark.createDataFrame([(i, v.tolist(), 0, "x") for i, v in enumerate(x)], SCHEMA)
    got = {r.vec_id: r.component_id for r in neardup.dedup_embeddings(d).collect()}
    found = np.mean([got[6000 + i] == got[i] for i in range(200)])
    assert found == 1 if whole > 10 else found > 0.97


def test_blocks_of_whole_groups(spark, monkeypatch):
    monkeypatch.setattr(neardup, "WHOLE", 40)
    monkeypatch.setattr(neardup, "CHUNK", 7)
    rng = np.random.default_rng(8)
    check(spark, [(i, (np.ones(8) + 0.3 * rng.normal(size=8)).tolist(), i % 2) for i in range(150)])


@pytest.mark.parametrize("whole", [4096, 100])
@pytest.mark.parametrize("common", [0.0, 0.8])
def test_groups_of_any_size_miss_nothing(spark, monkeypatch, whole, common):
    """Few passes and narrow windows lose pairs; what is left apart is compared, in small groups and large ones."""
    monkeypatch.setattr(neardup, "WHOLE", whole)
    x = cone(np.random.default_rng(9), 1500, 150, common)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    d = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = {r.vec_id: tuple(r)[1:] for r in neardup.dedup_embeddings(d, neighbours=2, miss=0.9).collect()}
    u = np.float32(x).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    close = u @ u.T >= 0.93
    np.fill_diagonal(close, False)
    group = np.arange(len(u))
    for _ in range(20):
        group = np.minimum(group, np.where(close, group, len(u)).min(axis=1))
    assert got == {i: (int(n), int(g), i == g) for i, (n, g) in enumerate(zip(close.sum(axis=1), group, strict=True))}


def test_small_groups_go_by_passes(spark, monkeypatch):
    """With all else taken away, the passes alone find the links of a small group."""
    monkeypatch.setattr(neardup, "rest_links", lambda apart, groups, threshold: apart.select(F.col("c").alias("a"), F.col("c").alias("b")).limit(0))
    rng = np.random.default_rng(10)
    check(spark, [(i, (rng.normal(size=6) if i % 3 else np.ones(6) + 0.01 * i * np.eye(6)[0]).tolist(), i % 2) for i in range(30)])
