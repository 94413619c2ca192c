"""Dual traversal against all pairs."""

import numpy as np
import pytest

from commutelens.llm import covertree


def brute(rows, cosine=0.98):
    """For each row: links, least id reachable, kept."""
    vectors = [None if v is None else np.array([np.nan if x is None else x for x in v], float) for _, v, _ in rows]
    good = [
        v is not None and len(v) and np.isfinite(v).all() and v.any() and label is not None
        for v, (_, _, label) in zip(vectors, rows)
    ]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and good[i] and good[j] and rows[i][2] == rows[j][2] and len(vectors[i]) == len(vectors[j]):
                a, b = vectors[i] / abs(vectors[i]).max(), vectors[j] / abs(vectors[j]).max()
                link[i, j] = a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine
    label = np.arange(n)
    while True:
        new = np.array([min(label[i], label[link[i]].min(initial=n)) for i in range(n)])
        if (new == label).all():
            break
        label = new
    least = {}
    for i, root in enumerate(label):
        ids = [rows[j][0] for j in range(n) if label[j] == root and rows[j][0] is not None]
        least[root] = min(ids) if ids else None
    return sorted(
        ((rows[i][0], int(link[i].sum()), least[label[i]], rows[i][0] is not None and rows[i][0] == least[label[i]]) for i in range(n)),
        key=str,
    )


def run(spark, rows, **how):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    got = covertree.near_dedup(table, **how).collect()
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str)


def clustered(seed, n, dims, spread, labels=2, centres=12):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    rows = []
    for k in range(n):
        v = middle[rng.integers(centres)] if k % 3 else rng.normal(size=dims)
        v = (v + rng.normal(size=dims) * spread * rng.random()) * rng.uniform(0.1, 9)
        rows.append((k, [float(x) for x in v.astype(np.float32)], int(k % 7 >= 3) if labels == 2 else 0))
    return rows


@pytest.mark.parametrize("dims,spread", [(2, 0.3), (3, 0.2), (8, 0.15), (32, 0.2)])
@pytest.mark.parametrize("tree", [8192, 40])
def test_all_pairs(spark, dims, spread, tree):
    rows = clustered(dims, 400, dims, spread)
    want = brute(rows)
    assert 50 < sum(r[1] > 0 for r in want) and len({r[2] for r in want}) > 2
    assert run(spark, rows, tree=tree) == want


def test_one_vector_holds_a_third(spark):
    rows = clustered(5, 200, 6, 0.1)
    rows += [(1000 + k, rows[1][1], rows[1][2]) for k in range(150)]
    assert run(spark, rows, tree=30) == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, v, 0), (2, v, 0), (2, v, 0), (3, v, 1), (4, v, None), (5, None, 0), (6, [0.0] * 3, 0), (7, [1.0, None, 3.0], 0),
        (8, [1.0, nan, 3.0], 0), (9, [1.0, inf, 3.0], 0), (10, [], 0), (11, [1.0, 2.0], 0), (12, [-1.0, -2.0, -3.0], 0),
        (None, v, 0), (None, [5.0, 0.0, -5.0], 0), (13, [1e-38, 2e-38, 3e-38], 0), (14, [1e38, 2e38, 3e38], 0), (15, v, 2),
    ]
    got = run(spark, rows)
    assert got == brute(rows)
    assert (4, 0, 4, True) in got and (None, 0, None, False) in got and (1, 5, 1, True) in got
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert covertree.near_dedup(table.where("false")).collect() == []
    # other columns are ignored, whatever they are called
    more = table.selectExpr("*", "1 AS node", "2 AS n", "'x' AS unit", "3 AS dims", "4 AS `a.b`")
    assert len(covertree.near_dedup(more).collect()) == len(rows)


def test_balls_hold_what_lies_below(spark):
    rng = np.random.default_rng(2)
    x = covertree.unit(np.concatenate([rng.normal(size=(300, 5)), 1 + 0.05 * rng.normal(size=(300, 5))]))
    paths = covertree.nested(x)
    for k, radius in enumerate(covertree.RADII):
        assert (np.linalg.norm(x - x[paths[:, k]], axis=1) <= radius + 1e-7).all()
        assert (paths[paths[:, k], k] == paths[:, k]).all()  # a centre is in its own ball
        if k:
            assert (paths[paths[:, k], k - 1] == paths[:, k - 1]).all()  # balls lie within balls


def test_traversal_leaves_pairs_of_balls(spark):
    """Far clusters are never compared vector by vector."""
    import pandas as pd

    rng = np.random.default_rng(4)
    middle = np.eye(6)
    x = covertree.unit(np.concatenate([m + 0.01 * rng.normal(size=(200, 6)) for m in middle]))
    tree = covertree.Tree(pd.DataFrame({"node": np.arange(len(x)), "n": 1, "unit": list(x), "path": list(covertree.nested(x))}))
    links = covertree.dual(tree, tree)
    assert (links.counts[0][:-1] == 200).all()
    assert links.found == 0 and len(tree.starts[0]) < 12
