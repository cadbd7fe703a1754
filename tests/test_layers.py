"""Numeric primitives against plain loops and their defining properties."""

import math

import numpy as np

from lodestone.functions import layers

RNG = np.random.default_rng(4)


def test_activations_against_plain_formulas():
    x = np.array([-800.0, -3.0, -0.5, 0.0, 0.5, 3.0, 800.0])
    plain = lambda f: [f(float(v)) for v in x]
    assert np.allclose(layers.sigmoid(x), plain(lambda v: 1 / (1 + math.exp(-v)) if v > -700 else 0.0))
    assert np.allclose(layers.silu(x), plain(lambda v: v / (1 + math.exp(-v)) if v > -700 else 0.0))
    assert np.allclose(layers.gelu(x), plain(lambda v: v * 0.5 * (1 + math.erf(v / 2**0.5))))
    assert np.allclose(layers.elu_plus_one(x), plain(lambda v: v + 1 if v > 0 else math.exp(v)))


def test_norms():
    x = RNG.normal(size=(2, 5, 8)) * 7 + 3
    assert np.allclose((layers.rms_norm(x, eps=0) ** 2).mean(-1), 1)
    assert np.allclose(layers.layer_norm(x).mean(-1), 0) and np.allclose(layers.layer_norm(x).std(-1), 1)
    assert np.allclose(layers.sum_norm(np.abs(x)).sum(-1), 1)
    w, g = RNG.normal(size=8), RNG.normal(size=8)
    assert np.allclose(layers.rms_norm(x, w, g), layers.rms_norm(x) * w / (1 + np.exp(-g)))
    assert np.allclose(layers.layer_norm(x, w, g), layers.layer_norm(x) * w + g)
    assert np.allclose(np.linalg.norm(layers.l2_norm(x), axis=-1), 1) and (layers.l2_norm(np.zeros(3)) == 0).all()


def test_convolution_against_a_loop():
    for width in (1, 3, 4):
        x, w, b = RNG.normal(size=(2, 7, 3)), RNG.normal(size=(3, width)), RNG.normal(size=3)
        want = np.zeros_like(x)
        for n in range(2):
            for t in range(7):
                for c in range(3):
                    want[n, t, c] = b[c] + sum(w[c, j] * x[n, t + j - width // 2, c] for j in range(width) if 0 <= t + j - width // 2 < 7)
        assert np.allclose(layers.short_convolution(x, w, b, activate=False), want)
        assert np.allclose(layers.short_convolution(x, w, b), want / (1 + np.exp(-want)))


def test_delta_rule_against_a_loop_and_is_causal():
    steps, d = 9, 4
    q, k, v = RNG.normal(size=(3, 2, steps, d))
    beta, fast, slow = RNG.random((3, 2, steps))
    got = layers.delta_rule(q, k, v, beta, fast, slow)
    unit = lambda a: a / np.linalg.norm(a)
    for h in range(2):
        own = [v[h, t] * beta[h, t] for t in range(steps)]
        near = lambda i, j: -beta[h, i] * float(unit(k[h, i]) @ unit(k[h, j])) if j < i else 0.0
        for t in range(steps):
            fixed = [own[i] + sum((near(i, j) + sum(near(i, m) * near(j, m) for m in range(steps))) * own[j] for j in range(i)) for i in range(t + 1)]
            look = [float(unit(q[h, t]) @ unit(k[h, i])) for i in range(t + 1)]
            want = 0.1 * fast[h, t] * sum(a * b for a, b in zip(look, own)) + 0.9 * slow[h, t] * sum(a * b for a, b in zip(look, fixed))
            assert np.allclose(got[h, t], want)
    later = v.copy()
    later[:, 5:] += 1
    assert np.allclose(layers.delta_rule(q, k, later, beta, fast, slow)[:, :5], got[:, :5])
