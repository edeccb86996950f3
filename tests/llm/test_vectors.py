import numpy as np
import pytest

from sedira.llm import neardup_vectors as nv
from sedira.llm.common import Scratch, components


def brute(x, t):
    u = [None if v is None or not len(v) or any(c is None for c in v) or not np.isfinite(v).all() or not np.any(v) else np.array(v, float) / np.linalg.norm(np.array(v, float)) for v in x]
    n, at = np.zeros(len(x), int), list(range(len(x)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(x)):
        for j in range(i):
            if u[i] is not None and u[j] is not None and len(u[i]) == len(u[j]) and u[i] @ u[j] >= t:
                n[i] += 1
                n[j] += 1
                a, b = root(i), root(j)
                at[max(a, b)] = min(a, b)
    return n, [root(i) for i in range(len(x))]


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates(spark, small, monkeypatch):
    if small:  # leaves, tiles and lists that overflow
        monkeypatch.setattr(nv, "LEAF", 16)
        monkeypatch.setattr(nv, "LEAF_MOST", 60)
        monkeypatch.setattr(nv, "TILE", 16)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((200, 24)).astype(np.float32)
    crowd = base[0] + 0.12 * rng.standard_normal((60, 24)).astype(np.float32)
    pairs = base[1:30] + 0.15 * rng.standard_normal((29, 24)).astype(np.float32)
    x = [v.tolist() for v in np.concatenate([base, crowd, pairs, base[:5]])]
    x += [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [None] + [1.0] * 23, [1.0, 0.0], [2.0, 0.0]]
    df = spark.createDataFrame([(k, v, "x") for k, v in enumerate(x)], "vec_id long, embedding array<float>, cls string").repartition(3)
    got = {r["vec_id"]: r for r in nv.near_duplicates(df, 0.95, k=8 if small else 16).collect()}
    n, root = brute([None if v is None else v if None in v else np.array(v, np.float32).tolist() for v in x], 0.95)
    assert len(got) == len(x)
    for k in range(len(x)):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (n[k], root[k], root[k] == k)
    assert n.max() > 20


def test_families_that_fill_lists(spark):
    """Each list is full of its own family; the links between the families count all the same."""
    rng = np.random.default_rng(3)
    near = lambda v, c: c * v / np.linalg.norm(v) + np.sqrt(1 - c * c) * (w := rng.standard_normal(64)) / np.linalg.norm(w)
    first = rng.standard_normal(64)
    second = near(first, 0.97)
    x = [near(c, 0.995).tolist() for c in (first, second) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nv.near_duplicates(df, 0.95).collect()}
    n, root = brute(x, 0.95)
    assert set(root) == {0} and n.min() > 40
    assert got == {k: (n[k], root[k]) for k in range(len(x))}


def test_bunches_of_hundreds(spark):
    """Two tight bunches, all of whose vectors are linked: far more links than any list holds."""
    rng = np.random.default_rng(5)
    near = lambda v, c: c * v / np.linalg.norm(v) + np.sqrt(1 - c * c) * (w := rng.standard_normal(64)) / np.linalg.norm(w)
    first = rng.standard_normal(64)
    second = near(first, 0.985)
    x = [near(c, 0.998).tolist() for c in (first, second) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>").repartition(3)
    n, root = brute(x, 0.95)
    assert set(root) == {0} and n.min() == 399
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nv.near_duplicates(df, 0.95).collect()}
    assert got == {k: (399, 0) for k in range(400)}


def test_saturated_lists_are_enlarged(spark, monkeypatch):
    """A family of 30 fills lists of 4; lists of 32 hold all its links, and the descent finds them."""
    monkeypatch.setattr(nv, "K_MOST", 64)
    seen = []
    saturated = nv.saturated
    monkeypatch.setattr(nv, "saturated", lambda lists, k, t: seen.append((k, lists)) or saturated(lists, k, t))
    rng = np.random.default_rng(8)
    x = [(np.eye(16)[0] + 0.01 * rng.standard_normal(16)).tolist() for _ in range(30)] + [rng.standard_normal(16).tolist() for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>").repartition(2)
    got = {r["vec_id"]: r["n_links"] for r in nv.near_duplicates(df, 0.95, k=4).collect()}
    assert [got[k] for k in range(30)] == [29] * 30
    assert [k for k, _ in seen] == [4, 8, 16, 32]
    assert nv.edges_of(seen[-1][1], 0.95).count() == 30 * 29


def test_double_components(spark):
    x = [[1e200, 1e200], [1e-200, 1e-200], [1.0, 1.0], [5e-324, 5e-324], [1e308, -1e308], [0.0, -0.0]]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    assert {r["vec_id"]: r["n_links"] for r in nv.near_duplicates(df).collect()} == {0: 3, 1: 3, 2: 3, 3: 3, 4: 0, 5: 0}


@pytest.mark.parametrize("blocks", [1000, 3])
def test_lone_pairs_in_heavy_leaves(spark, blocks, monkeypatch):
    """Vectors with a mean cosine of .7 crowd into few leaves; one forest has to find the lone pairs there without an audit's help."""
    monkeypatch.setattr(nv, "LEAF", 16)
    monkeypatch.setattr(nv, "LEAF_MOST", 40)
    monkeypatch.setattr(nv, "BLOCKS", blocks, raising=False)
    monkeypatch.setattr(nv, "FORESTS", 1)
    monkeypatch.setattr(nv, "MISS", 1e-5)  # of 150 pairs, none by chance
    monkeypatch.setattr(nv, "audit", lambda by, threshold: by.select(by["cls"].alias("a"), by["cls"].alias("b")).limit(0))
    rng = np.random.default_rng(6)
    u = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = u(1.5 * u(rng.standard_normal(48)) + u(rng.standard_normal((1200, 48))))
    other = rng.standard_normal((150, 48))
    other = u(other - (other * x[:150]).sum(1, keepdims=True) * x[:150])
    x = np.concatenate([x, 0.952 * x[:150] + np.sqrt(1 - 0.952**2) * other])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {r["vec_id"]: r["n_links"] for r in nv.near_duplicates(df, 0.95).collect()}
    want = (x @ x.T >= 0.95).sum(1) - 1
    assert want.max() == 1 and want.sum() == 300
    assert got == dict(enumerate(want))


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert nv.near_duplicates(df).count() == 0
    one = spark.createDataFrame([(None, None), (3, [1.0, 2.0]), (3, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert sorted((r["vec_id"] or -1, r["n_links"], r["kept"]) for r in nv.near_duplicates(one).collect()) == [(-1, 0, True), (3, 1, True), (3, 1, True)]


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(k, k + 1) for k in range(1000, 1100)]
    at = {}

    def root(i):
        while at.setdefault(i, i) != i:
            i = at[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        at[max(x, y)] = min(x, y)
    got = components(Scratch(spark), spark.createDataFrame(edges, "a long, b long")).collect()
    name = {}
    for r in got:
        assert name.setdefault(r["label"], root(r["node"])) == root(r["node"])
    assert len(set(name.values())) == len(name)
    assert {r["node"] for r in got} == {x for e in edges for x in e if e[0] != e[1]}
