"""Networks: gradients against differences, residual kinds, posteriors against direct integration, null features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitframe.operators import posterior, score


def network(r, sizes, kinds=True):
    out = []
    for k, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False)):
        layer = {"w": r.normal(size=(a, b)) / np.sqrt(a)}
        if k < len(sizes) - 2:
            layer |= {"gain": r.uniform(0.5, 1.5, b), "shift": r.normal(size=b)}
            if kinds and a != b:
                layer["project"] = r.normal(size=(a, b)) / np.sqrt(a)
        else:
            layer["b"] = r.normal(size=b)
        out.append(layer)
    return out


@pytest.mark.parametrize("hyper", [False, True])
@pytest.mark.parametrize("sizes", [(5, 3), (5, 8, 3), (6, 8, 8, 8, 8, 4), (6, 6, 6, 6, 6, 2)])
@pytest.mark.parametrize("kinds", [False, True])
def test_gradient_equals_differences(hyper, sizes, kinds):
    r = np.random.default_rng(len(sizes))
    layers, x = network(r, sizes, kinds), r.normal(size=(30, sizes[0]))
    got, step = score.gradient(x, layers, hyper), 1e-6
    for k in range(sizes[0]):
        move = np.zeros(sizes[0])
        move[k] = step
        want = (score.forward(x + move, layers, hyper).mean(axis=1) - score.forward(x - move, layers, hyper).mean(axis=1)) / (2 * step)
        close = np.abs(got[:, k] - want) < 1e-5
        assert close.mean() > 0.96  # but where a unit turns on within the step


def test_hyper_residual_by_hand():
    r = np.random.default_rng(3)
    layers, x = network(r, (4, 4, 4, 4, 2)), r.normal(size=(7, 4))

    def block(v, layer):
        y = v @ layer["w"]
        y = (y - y.mean(axis=1, keepdims=True)) / np.sqrt(y.var(axis=1, keepdims=True) + 1e-5)
        return np.maximum(y * layer["gain"] + layer["shift"], 0)

    a = block(x, layers[0]) + x
    b = block(a, layers[1]) + a + x
    c = block(b, layers[2]) + b + (x + a) / 2
    assert np.allclose(score.forward(x, layers, True), c @ layers[3]["w"] + layers[3]["b"])


def test_null_features(spark):
    layers = [{"w": np.array([[1.0], [2.0]])}]
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [3.0, 4.0])], "id int, x array<double>")
    for n in (1, 4):
        got = {r["id"]: r for r in score.score_gradient(score.score(df.repartition(n), "x", layers), "x", layers).collect()}
        assert {i: r["quantiles"] for i, r in got.items()} == {0: [5.0], 1: None, 2: None, 3: [11.0]} and got[1]["gradient"] is None and got[3]["gradient"] == [1.0, 2.0]
    assert score.score(df.where("id in (1, 2)"), "x", layers).where("quantiles is null").count() == 2
    with pytest.raises(Exception, match="differ in length"):
        score.score(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], df.schema).coalesce(1), "x", layers).collect()


def test_posterior_of_quantiles():
    r = np.random.default_rng(0)
    q = np.sort(np.maximum(r.normal(size=(200, 9)), -0.2), axis=1)
    got, at = posterior.of_quantiles(q[:, r.permutation(9)], np.linspace(0.001, 0.999, 200)), posterior.levels(9)
    u = (np.arange(200_000) + 0.5) / 200_000
    for i in range(200):
        whole = np.interp(u, at, q[i])
        assert abs(got["mean"][i] - whole.mean()) < 1e-4 and abs(got["tercile_1"][i] - np.interp(1 / 3, at, q[i])) < 1e-9
        assert abs(got["sample"][i] - np.interp(np.linspace(0.001, 0.999, 200)[i], at, q[i])) < 1e-9
        if (np.diff(q[i]) > 0).all() and q[i, 0] <= 1e-4 < q[i, -1]:
            assert abs(got["pop"][i] - (1 - np.interp(1e-4, q[i], at))) < 1e-9


def test_posterior_of_density():
    r = np.random.default_rng(0)
    edges, logits = np.concatenate(([0], np.logspace(-4, 2, 128))), r.normal(size=(50, 128)) * 3
    draws = r.uniform(size=50)
    got = posterior.of_density(logits, edges, draws)
    for i in range(50):
        p = np.exp(logits[i]) / np.exp(logits[i]).sum()
        cdf = np.concatenate(([0], np.cumsum(p)))
        assert abs(got["mean"][i] - (p * (edges[1:] + edges[:-1]) / 2).sum()) < 1e-9 and abs(got["pop"][i] - (1 - p[0])) < 1e-9
        for k, u in (("tercile_1", 1 / 3), ("tercile_2", 2 / 3), ("sample", draws[i])):
            assert abs(got[k][i] - np.interp(u, cdf, edges)) < 1e-6


def test_draws_follow_the_distribution(spark):
    u = np.array([r[0] for r in spark.range(20_000).select(posterior.level_of(F.col("id"))).collect()])
    assert 0 < u.min() and u.max() < 1 and abs(np.sort(u) - (np.arange(20_000) + 0.5) / 20_000).max() < 0.02
