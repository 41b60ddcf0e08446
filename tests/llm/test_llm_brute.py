"""Plain-Python references of the toxicity classifier (features, learner) and of the quality classifier (bins, risk)."""

import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa

from tessera.llm import textbatch as tb
from tessera.llm import quality, toxicity

M = 1 << 64


def mixed(h):
    for _ in range(2):
        h ^= h >> 32
        h = h * 0xD6E8FEB86659FD93 % M
    return h ^ h >> 32


def poly(data):
    return sum((b + 1) * pow(int(tb._BASE), i, M) for i, b in enumerate(data)) % M


def reference(text):
    """Coordinates of a text: words, pairs at distance one and two, grams inside words."""
    words = [w.lower().encode() for w in re.split(r"[\x00-/:-@\[-`{-\x7f]+", text or "") if w]
    words = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
    h = [mixed((poly(w) + len(w)) % M) for w in words]
    out = set(h)
    for gap in (1, 2):
        out |= {mixed((a * 3 + b * 0x2545F4914F6CDD1D + gap) % M) for a, b in zip(h, h[gap:])}
    for size in toxicity.GRAMS:
        out |= {mixed((poly(w[i:i + size]) + 100 + size) % M) for w in words for i in range(len(w) - size + 1)}
    return {x >> 44 for x in out}


def test_features_match_plain_python():
    rng = random.Random(3)
    texts = ["".join(rng.choice(["idiot", "Über", "a", " ", " ", "-", "x1", "\n", "日本", "SCUM", ".", "scheiss"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    texts = [t.replace("Ü", "ü") for t in texts] + [None, "", "one", "a b c"]
    doc, at = toxicity.present(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert set(at[doc == i].tolist()) == reference(t)


def test_ftrl_matches_a_loop_over_dicts():
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 40, rng.integers(1, 9))) * 1_001 for _ in range(300)]
    labels = np.array([float(0 in r or 5_005 in r) for r in rows])
    bias, at, weights = toxicity.ftrl(rows, labels)
    z, n = {}, {}

    def weight(i):
        a = z.get(i, 0.0)
        a = math.copysign(max(abs(a) - (0.0 if i == "bias" else toxicity.L1), 0.0), a)
        return -a / ((toxicity.BETA + math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for r, y in zip(rows, labels):
            held = [*r.tolist(), "bias"]
            w = {i: weight(i) for i in held}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - y
            for i in held:
                more = n.get(i, 0.0) + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(more) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA * w[i]
                n[i] = more
    want = {i: weight(i) for i in z if i != "bias" and weight(i)}
    assert np.isclose(bias, weight("bias")) and at.tolist() == sorted(want) and np.allclose(weights, [want[i] for i in sorted(want)])
    assert want and len(want) < len(z) - 1  # L1 leaves some out


def test_training_holds_the_sample_once():
    """What comes to the training task is kept in one copy; order and choice of coordinates are those of the whole table."""
    rng = np.random.default_rng(8)
    made = [(str(i), i % 2, np.unique(rng.integers(0, 40_000, 9_000)).astype("<u4")) for i in range(1_200)]
    made += [("rare", 1, np.array([5, 700_000], "<u4")), ("none", 0, np.zeros(0, "<u4"))]

    def batches():
        for at in range(0, len(made), 100):
            ids, labels, rows = zip(*made[at:at + 100])
            yield pa.RecordBatch.from_pydict({"_id": pa.array(ids), "_y": pa.array(labels, pa.int32()), "_f": pa.array([r.tobytes() for r in rows], pa.binary())})

    tracemalloc.start()
    rows, labels = toxicity.gathered(batches())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.6 * sum(r.nbytes for _, _, r in made)
    order = np.argsort(tb.mix(np.array([toxicity.hash_of(i) for i, _, _ in made], np.uint64)), kind="stable")
    often = np.bincount(np.concatenate([r for _, _, r in made]), minlength=toxicity.DIMS) >= toxicity.MIN_TEXTS
    assert labels.tolist() == [made[i][1] for i in order]
    assert all(np.array_equal(r, made[i][2][often[made[i][2]]]) for r, i in zip(rows, order)) and len(rows) == len(made)
    rows, labels = toxicity.gathered(iter(()))
    assert rows == [] and labels.tolist() == []


def test_pu_gradient_is_the_slope_of_the_non_negative_risk(monkeypatch):
    """Against finite differences, where the risk of negatives is positive and where it is not."""
    rng = np.random.default_rng(7)
    width = len(quality.FEATURES)
    p, u = rng.normal(0.5, 1, (60, width)), rng.normal(0, 1.5, (90, width))
    seen = []
    real = quality.descend
    monkeypatch.setattr(quality, "descend", lambda gradient, size, decay: (seen.append(gradient), real(gradient, size, decay))[1])
    model = quality.train(p, u)
    gradient, prior = seen[-1], model["prior"]
    bp, bu = quality.binned(p, model["edges"]), quality.binned(u, model["edges"])

    def parts(w):
        zp = [sum(w[i] for i in row) + w[-1] for row in bp.tolist()]
        zu = [sum(w[i] for i in row) + w[-1] for row in bu.tolist()]
        plus = lambda z: math.log1p(math.exp(-z))
        minus = lambda z: math.log1p(math.exp(z))
        mean = lambda f, zs: sum(map(f, zs)) / len(zs)
        return prior * mean(plus, zp), mean(minus, zu) - prior * mean(minus, zp)

    regimes = set()
    for shift in (0.0, 4.0, -4.0):
        w = rng.normal(0, 0.3, len(model["w"]))
        for b in range(bp.shape[1]):
            w[bp[:, b]] += shift / bp.shape[1]
        positive = parts(w)[1] >= 0
        regimes.add(positive)
        objective = (lambda w: sum(parts(w))) if positive else (lambda w: -parts(w)[1])
        g = gradient(w)
        for i in [*rng.choice(len(w) - 1, 25, replace=False), len(w) - 1]:
            up, down = w.copy(), w.copy()
            up[i] += 1e-5
            down[i] -= 1e-5
            assert abs(g[i] - (objective(up) - objective(down)) / 2e-5) < 1e-6
    assert True in regimes


def test_bins_match_plain_python():
    rng = np.random.default_rng(9)
    width = len(quality.FEATURES)
    x, edges = rng.integers(-3, 4, (40, width)) / 2, np.sort(rng.integers(-2, 3, (width, quality.BINS)) / 2, axis=1)
    got = quality.binned(x, edges)
    assert got.tolist() == [[sum(e <= v for e in edges[j]) + j * (quality.BINS + 1) for j, v in enumerate(row)] for row in x.tolist()]
