import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.functions import numeric, scaling
from lexmill.operators.distributed import pack_buckets

X = [0.5, -1.25, 3.0, 2.0]


def run(spark, f, x=X):
    return spark.createDataFrame([(x,)], "x array<double>").select(f(F.col("x")).alias("y")).first()["y"]


def test_vector_kernels(spark):
    x = np.array(X)
    e = np.exp(x - x.max())
    assert run(spark, numeric.softmax) == pytest.approx(e / e.sum())
    assert run(spark, numeric.softmax, [1000.0, 1001.0]) == pytest.approx([1 / (1 + math.e), math.e / (1 + math.e)])
    assert run(spark, numeric.log_softmax) == pytest.approx(np.log(e / e.sum()))
    assert run(spark, lambda c: numeric.cross_entropy(c, F.lit(2))) == pytest.approx(-np.log(e / e.sum())[2])
    assert run(spark, numeric.rmsnorm) == pytest.approx(x / np.sqrt((x * x).mean() + 1e-5))
    assert run(spark, lambda c: numeric.top_k_mask(c, 2)) == [None, None, 3.0, 2.0]
    angles = 3 / 10000 ** (np.arange(0, 4, 2) / 4)
    z = (x[0::2] + 1j * x[1::2]) * np.exp(1j * angles)
    assert run(spark, lambda c: numeric.rope(c, F.lit(3.0))) == pytest.approx(np.stack((z.real, z.imag), 1).ravel())


def test_attention_matches_dense(spark):
    rng = np.random.default_rng(0)
    q, k, v = (rng.normal(size=(5, 4)) for _ in range(3))
    rows = [(1, i, q[i].tolist(), k[i].tolist(), v[i].tolist()) for i in range(5)]
    t = spark.createDataFrame(rows, "seq long, pos long, q array<double>, k array<double>, v array<double>")
    s = np.where(np.tril(np.ones((5, 5), bool)), q @ k.T / 2, -np.inf)
    p = np.exp(s - s.max(1, keepdims=True))
    want = p / p.sum(1, keepdims=True) @ v
    for r in numeric.attention(t, t).collect():
        assert r.out == pytest.approx(want[r.pos])
        assert r.lse == pytest.approx(np.log(np.exp(s[r.pos]).sum()))


def test_learning_rate_schedule(spark):
    got = [r.lr for r in spark.range(25).select(numeric.cosine_lr(F.col("id"), 1.0, 0.1, 7, 21).alias("lr")).collect()]
    assert got[0] == 0 and got[7] == 1.0 and got[14] == pytest.approx(0.55) and got[21:] == [0.1] * 4


def test_scaling_fit_recovers_constants(spark):
    k = scaling.fit(scaling.isoflop_points(spark))
    for name, want in scaling.PUBLISHED.items():
        assert k[name] == pytest.approx(want, rel=2e-3)
    c = spark.range(1).select(*(v.alias(n) for n, v in scaling.optimal(F.lit(1e19)).items())).first()
    assert (c.n_opt, c.d_opt, c.l_opt) == pytest.approx((9.40e8, 1.774e9, 5.6222), rel=1e-3)
    best = spark.range(1).select(scaling.true_optimal(F.lit(1e19))["l_opt"].alias("l")).first().l
    assert best == pytest.approx(5.6179, rel=1e-4)
    assert scaling.fit(scaling.isoflop_points(spark).limit(0), rounds=1) == scaling.CHINCHILLA


def test_bucket_packing():
    assert pack_buckets([(0, 4), (1, 4), (2, 4), (3, 9)], 8) == [(0, 0), (1, 0), (2, 1), (3, 2)]
    assert pack_buckets([(0, 100)], 8) == [(0, 0)]
