"""Cells of the projection trees: recall, growth, windows by definition, keys that stand with several vectors."""

import numpy as np
import pytest

from siltstone.llm import embedding_dedup as E


def near_pairs(rng, n, dim, cos):
    a = rng.standard_normal((n, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rng.standard_normal((n, dim))
    side -= (side * a).sum(1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    return a, cos * a + np.sqrt(1 - cos**2) * side


@pytest.mark.parametrize("n", [50_000, 10**9])
def test_pairs_at_the_threshold_share_a_cell(n):
    cuts, trees = E.forest_size(n, E.BLOCK // 8)
    a, b = near_pairs(np.random.default_rng(5), 4000, 64, 0.95)
    assert (E.cells_of(a, cuts, trees) == E.cells_of(b, cuts, trees)).any(1).sum() >= 3998


def test_work_grows_much_less_than_with_the_square():
    rng = np.random.default_rng(6)
    work = []
    for n in (20_000, 200_000):
        cuts, trees = E.forest_size(n, E.BLOCK // 8)
        cells = E.cells_of(rng.standard_normal((n, 64)), cuts, trees)
        work.append(sum(int((np.unique(c, return_counts=True)[1] ** 2).sum()) for c in cells.T))
    assert work[1] < 25 * work[0]


def test_windows_by_definition():
    rng = np.random.default_rng(7)
    a, b = np.round(rng.standard_normal((40, 6)), 1), np.round(rng.standard_normal((55, 6)), 1)
    a[3] = a[5]
    for window in (0.05, 0.75):
        assert (E.collisions(a, b, window) == (np.abs(a[:, None] - b[None]) <= window).sum(2)).all()
        own = (np.abs(a[:, None] - a[None]) <= window).sum(2)
        np.fill_diagonal(own, 0)
        assert (E.collisions(a, None, window) == own).all()


def test_keys_that_stand_with_several_vectors(spark):
    rng = np.random.default_rng(8)
    a, b = rng.standard_normal((2, 16))
    rows = [(1, a), (1, b), (2, a + 0.01), (3, b + 0.01), (1, a), (4, rng.standard_normal(16))]
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in rows], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect())
    assert got == [(1, 2, 1, True)] * 3 + [(2, 2, 1, False), (3, 1, 1, False), (4, 0, 4, True)]
