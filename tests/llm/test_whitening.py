"""Whitening against exact fractions and numpy, tiles of several sizes, odd rows."""

from fractions import Fraction

import numpy as np
import pytest

from halogrid.llm import whitening
from halogrid.llm.common import table

SF = "/root/testdata/sf0.001"


def whole(v):
    return np.floor(1024.0 * np.asarray(v, np.float64)).astype(np.int64) + whitening.SHIFT


def exact_covariance(x):
    """The covariance as fractions."""
    n, s = len(x), [int(v) for v in x.sum(axis=0)]
    dev = [[n * int(v) - t for v, t in zip(r, s, strict=True)] for r in x]
    d = x.shape[1]
    return [[Fraction(sum(r[i] * r[j] for r in dev), n**3) for j in range(d)] for i in range(d)], dev


def plain(x, k):
    cov, dev = exact_covariance(x)
    c = np.array([[float(v) for v in r] for r in cov])
    e, v = np.linalg.eigh(c)
    e, v = e[::-1], v[:, ::-1]
    z = np.array([[float(Fraction(a, len(x))) for a in r] for r in dev])
    return c, [sum(a * a for a in r) for r in dev], z @ v[:, :k] / np.sqrt(e[:k]), e[:k] / np.trace(c)


def test_query(spark):
    x = {r.vec_id: r.embedding for r in table(spark, SF, "embeddings").collect()}
    ids = sorted(x)
    _, deviation, w, explained = plain(whole([x[i] for i in ids]), 8)
    got = whitening.op11_embedding_whitening(spark, SF).collect()
    assert len(got) == 8 * len(ids) and {r.n for r in got} == {len(ids)}
    at = {i: k for k, i in enumerate(ids)}
    mine = np.zeros_like(w)
    for r in got:
        mine[at[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == deviation[at[r.vec_id]] and abs(r.explained / explained[r.component - 1] - 1) < 1e-10 and r.identity_error < 1e-10
    sign = np.sign((mine * w).sum(axis=0))
    assert np.abs(mine - w * sign).max() < 1e-8


@pytest.mark.parametrize(("tile", "block_bytes"), [(1, 100), (3, 1 << 20), (64, 900)])
def test_tiles(spark, tile, block_bytes, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", block_bytes)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(90, 7)) @ rng.normal(size=(7, 7))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    rows = whitening.whole_vectors(df)
    x = whole(v)
    want = exact_covariance(x)[0]
    got = {}
    for r in whitening.covariance_tiles(rows, {7: (90, [int(s) for s in x.sum(axis=0)])}, tile).collect():
        for at, product in enumerate(r.products):
            a, b = divmod(at, min(tile, 7 - r.j * tile))
            got[r.i * tile + a, r.j * tile + b] = product / 90
    for i in range(7):
        for j in range(i, 7):
            assert abs(got[i, j] - float(want[i][j])) <= 1e-12 * abs(float(want[i][i] + want[j][j]))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, -1.0]), (2, None), (3, [nan, 1.0]), (4, [1.0, None]), (5, [inf, 0.0]), (6, []), (7, [1.0, 2.0, 3.0]), (8, [1e300, 0.5, 0.0]), (9, [4.0] * 300)]
    df = spark.createDataFrame([(i, v, 0, 0.0) for i, v in rows], "vec_id long, embedding array<double>, n int, w double")
    got = whitening.whiten(df, components=2).collect()
    of = lambda i: sorted((r.component, r.n) for r in got if r.vec_id == i)
    assert of(1) == [(1, 3), (1, 3), (2, 3), (2, 3)] and of(None) == [(1, 3), (2, 3)]
    assert of(7) == of(8) == [(1, 2), (2, 2)] and of(9) == [(1, 1), (2, 1)] and {r.vec_id for r in got} == {1, None, 7, 8, 9}
    # Two points span one direction, one point none.
    assert {r.whitened for r in got if r.vec_id in (7, 9) and (r.component == 2 or r.vec_id == 9)} == {0.0}
    far = next(r for r in got if r.vec_id == 8)
    a, b = (np.array(v, object) for v in ([2**52 + whitening.SHIFT, 512 + whitening.SHIFT, whitening.SHIFT], [1024 + whitening.SHIFT, 2048 + whitening.SHIFT, 3072 + whitening.SHIFT]))
    assert int(far.deviation) == int(((a - b) ** 2).sum())
    assert whitening.whiten(df.limit(0)).collect() == []
