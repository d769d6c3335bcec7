import math

import numpy as np
import pytest

from txnrules.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, key string, n int, d string, component string"


def rows(n=700, dim=9, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)) @ rng.normal(size=(dim, dim)) * 0.2 + rng.normal(size=dim)
    out = [(i, [float(x) for x in np.float32(r)]) for i, r in enumerate(v)]
    out += [(1, None), (2, []), (3, [1.0] * (dim - 1)), (4, [math.nan] + [0.0] * (dim - 1)), (5, [math.inf] + [0.0] * (dim - 1)), (6, [None] + [0.0] * (dim - 1)), (None, [0.5] * dim), (1007, [0.5] * dim), (1007, [0.5] * dim)]
    return out


def frame(spark, data, parts=3):
    return spark.createDataFrame([(i, v, "k", 1, "d", "c") for i, v in data], SCHEMA).repartition(parts)


def brute(data, dim):
    good = [(i, v) for i, v in data if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in good]
    n, s = len(x), [sum(r[d] for r in x) for d in range(dim)]
    y = [[n * r[d] - s[d] for d in range(dim)] for r in x]
    v = np.array([[sum(r[d] * r[e] for r in y) / n**3 for e in range(dim)] for d in range(dim)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:8], u.T[::-1][:8]
    return {"ids": [i for i, _ in good], "n": n, "deviation": [sum(a * a for a in r) for r in y], "whitened": np.array(y, float) / n @ u.T / np.sqrt(e), "explained": e / np.trace(v)}


def test_products_are_exact():
    rng = np.random.default_rng(2)
    for x in (rng.integers(0, 5000, (1000, 5)), rng.integers(-(2**61), 2**61, (70, 3)), np.full((64, 2), 7), rng.integers(-3, 4, (1, 4)), np.array([[0, 2**62], [1, -(2**62)], [0, 5]])):
        sums, products = W.block_totals(x.astype(np.int64))
        whole = x.astype(object)
        assert (sums == whole.sum(axis=0)).all() and (products == whole.T.dot(whole)).all()


@pytest.mark.parametrize("block", [64, W.BLOCK])
def test_query_matches_brute_force(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(W, "BLOCK", block)
    data = rows()
    frame(spark, data).write.parquet(f"{tmp_path}/embeddings.parquet")
    want = brute(data, 9)
    got = W.op12_bit_sliced_whitening(spark, str(tmp_path)).collect()
    assert len(got) == 8 * want["n"] and {r.n for r in got} == {want["n"]} and {r.component for r in got} == set(range(1, 9))
    assert {r.identity_error for r in got}.pop() < 1e-9
    for c in range(1, 9):
        mine = {r.vec_id: r for r in got if r.component == c}
        whitened = np.array([mine[i].whitened for i in want["ids"]])
        sign = np.sign(whitened @ want["whitened"][:, c - 1])
        assert np.allclose(whitened, sign * want["whitened"][:, c - 1], atol=1e-8)
        assert [mine[i].deviation for i in want["ids"]] == want["deviation"] and np.isclose(mine[0].explained, want["explained"][c - 1])


def test_degenerate_tables(spark):
    same = frame(spark, [(i, [0.25, 0.5, 1.0]) for i in range(5)])
    got = W.whiten(same, W.fit(same)).collect()
    assert len(got) == 15 and {(r.whitened, r.explained, r.deviation) for r in got} == {(None, 0.0, 0)} and W.identity_error(same, W.fit(same)) is None
    flat = frame(spark, [(i, [float(i % 7), 2.0 * (i % 7), 3.0]) for i in range(50)])
    model = W.fit(flat)
    assert model.usable.tolist() == [True, False, False] and W.identity_error(flat, model) < 1e-9
    huge = frame(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])])
    assert {(r.key, r.deviation) for r in W.whiten(huge, W.fit(huge)).collect()} == {(1, None), (2, None), (3, 3072**2)}
    assert W.fit(frame(spark, [(1, None), (2, [])])) is None and W.fit(spark.createDataFrame([], SCHEMA)) is None
    mixed = frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0, 4.0]), (3, [3.0, 2.0, 1.0]), (4, [5.0])])
    assert {r.key for r in W.whiten(mixed, W.fit(mixed)).collect()} == {2, 3}
